"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is a stream of words: its documents in keyed hash order, cut into blocks of equal width. A target
becomes an exact quota of blocks. The quotas of all sources sit at the root of a binary tree over the output
shards; a node draws the left child's share of each source without replacement (multivariate hypergeometric,
keyed by the node), so every shard ends with its exact number of blocks and the sources in random proportion
around the target. A keyed permutation of the blocks of a source says which block lies at which draw; the draws
of a shard are a range of it, so shards are disjoint and no block is drawn more often than once an epoch. Inside
a shard the pieces follow a keyed hash.

What the driver holds is the plan: one row per source and at most ``PLAN_CELLS`` counts (sources x shards); the
number of shards gives way to that bound. Widths grow so that all quotas together stay below ``MOST_BLOCKS``.

Rows are numbered in the order of the streams, so that pieces find their document whatever its key.

Defined results: NULL text has 0 words and is never drawn; NULL is a source of its own, the last in order;
repeated rows are separate documents; an empty table gives an empty mix; other columns are carried
along unread, but those with the names of ``ADDED`` are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundix.llm.running import running_totals
from abundix.llm.skew import with_facts
from abundix.llm.words import mix64, ranges, small_batches, word_slices
from abundix.session import cut_lineage

PLAN_CELLS = 1 << 22
MOST_SOURCES = 1 << 16
MOST_BLOCKS = 500_000_000
LEAST_BLOCKS = 256
ADDED = ("source_size", "target", "taken", "shard", "epoch", "block", "first_word", "n_words", "slot", "places", "__before", "__row", "__one")
ROW = "__row"


def cycled_weights(sources: list[str | None]) -> list[float]:
    """3, 1, 2, 3, 1, 2, ... in the order of the sources."""
    return [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sources))]


def with_word_counts(df: DataFrame, text: str, name: str) -> DataFrame:
    """The table with the number of words of ``text`` in place of it."""
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in (text, name)]
    rows = df.select(*kept, F.col(text).alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [w.counts for w in word_slices(batch.column("__text"))]
            sizes = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(sizes, pa.int64())], names=[*kept, name])

    return rows.mapInArrow(count, rows.drop("__text").schema.add(name, "long"))


def capped_shares(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is cut goes to the others by weight."""
    targets = [0.0] * len(sizes)
    open_ = [i for i, n in enumerate(sizes) if n > 0 and weights[i] > 0]
    left = float(total)
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if level * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = level * weights[i]
            break
        for i in full:
            targets[i] = most * sizes[i]
            left -= targets[i]
        open_ = [i for i in open_ if targets[i] == 0.0]
    return targets


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard (shards x sources), by the splitting tree."""
    total = int(quotas.sum())
    ends = [total * (k + 1) // shards for k in range(shards)]
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    waiting = [(0, shards, quotas.astype(np.int64))]
    while waiting:
        low, high, held = waiting.pop()
        if high - low == 1:
            out[low] = held
            continue
        middle = (low + high) // 2
        wanted = ends[middle - 1] - (ends[low - 1] if low else 0)
        draw = np.random.Generator(np.random.Philox(key=[seed, (low << 32) | high]))
        left = draw.multivariate_hypergeometric(held, wanted, method="marginals")
        waiting += [(low, middle, left), (middle, high, held - left)]
    return out


def permuted(values: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..size-1 for each value: four Feistel rounds, walked until inside."""
    half = np.array([max(1, (max(int(n) - 1, 1).bit_length() + 1) // 2) for n in np.unique(sizes)], dtype=np.uint64)
    half = half[np.searchsorted(np.unique(sizes), sizes)]
    out = values.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        bits, key = half[todo], keys[todo]
        mask = (np.uint64(1) << bits) - np.uint64(1)
        left, right = out[todo] >> bits, out[todo] & mask
        for turn in range(4):
            left, right = right, left ^ (mix64(right + key, turn) & mask)
        out[todo] = (left << bits) | right
        todo = todo[out[todo] >= sizes[todo].astype(np.uint64)]
    return out.astype(np.int64)


@dataclass
class Plan:
    """What a task needs to know of each source, in the order of the sources."""

    names: list[str | None]
    sizes: np.ndarray
    base: np.ndarray
    targets: np.ndarray
    width: np.ndarray
    blocks: np.ndarray
    quotas: np.ndarray
    ends: np.ndarray
    seed: int

    def draws(self, source: np.ndarray, block: np.ndarray, epoch: int) -> np.ndarray:
        """Place of each block in the draws of its source."""
        key = mix64(np.uint64(self.seed) + source.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(epoch), 7)
        return epoch * self.blocks[source] + permuted(block, self.blocks[source], key)

    def shard(self, source: np.ndarray, draw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(draw), dtype=np.int32)
        for s in np.unique(source):
            here = source == s
            out[here] = np.searchsorted(self.ends[:, s], draw[here], side="right")
        return out

    def scan(self, batches: Iterator[pa.RecordBatch], source_column: str, size_column: str, whole: bool):
        """For each batch: the rows as numbers, and one entry for each block that a row reaches into."""
        index = {name: i for i, name in enumerate(self.names)}
        for batch in batches:
            source = np.array([index[s] for s in batch.column(source_column).to_pylist()], dtype=np.int64)
            size = batch.column(size_column).fill_null(0).to_numpy()
            start = batch.column("__before").to_numpy() - self.base[source]
            first = np.minimum(start // self.width[source], self.blocks[source] - 1)
            last = first if whole else np.where(size > 0, (start + size - 1) // self.width[source], first)
            row = np.repeat(np.arange(len(size)), last - first + 1)
            block = ranges(first, last - first + 1)
            low = np.maximum(block * self.width[source[row]], start[row])
            high = np.minimum((block + 1) * self.width[source[row]], (start + size)[row])
            if whole:
                low, high = start[row], (start + size)[row]
            yield batch, source, size, start, row, block, low, high


class Mix:
    """A planned mix of the rows of ``docs``; nothing is drawn before one of its tables is read.

    ``weigh`` gets the sources in code-point order (NULL last) and returns their weights. ``share`` of all words
    is handed out, no source gets more than ``most_repeats`` times its words. With ``whole_documents`` a document
    follows the block in which it begins; otherwise blocks cut documents at word borders.
    """

    def __init__(
        self,
        docs: DataFrame,
        weigh: Callable[[list[str | None]], list[float]],
        *,
        size: str = "size",
        source: str = "source",
        key: str = "doc_id",
        share: float = 1.5,
        most_repeats: float = 2.0,
        block_words: int = 256,
        shard_words: int = 1 << 22,
        whole_documents: bool = False,
        seed: int = 20,
    ):
        docs = docs.drop(*[c for c in ADDED if c not in (size, source, key)])
        self.columns = docs.columns
        self.size, self.source, self.whole = size, source, whole_documents
        order = [F.col(source).asc_nulls_last(), F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.col(key), F.col(size)]
        numbered = docs.withColumn("__one", F.lit(1).cast("long"))
        self.rows = running_totals(numbered, order, {"__before": size, ROW: "__one"})[0].drop("__one")
        sums = self.rows.groupBy(source).agg(F.sum(size).alias("n")).limit(MOST_SOURCES + 1).collect()
        if len(sums) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources: mix groups of sources instead")
        sums = sorted(((r[source], int(r["n"] or 0)) for r in sums), key=lambda x: (x[0] is None, x[0] or ""))
        names, sizes = [s for s, _ in sums], [n for _, n in sums]
        total = sum(sizes)
        targets = capped_shares(sizes, list(weigh(names)), share * total, most_repeats)
        most = max(block_words, -(-int(share * total + 1) // MOST_BLOCKS))
        width = np.array([max(1, min(most, n // LEAST_BLOCKS)) for n in sizes], dtype=np.int64)
        blocks = np.array([max(1, -(-n // w)) for n, w in zip(sizes, width.tolist())], dtype=np.int64)
        quotas = np.array(
            [min(int(most_repeats * b), round(t * b / n)) if n else 0 for t, b, n in zip(targets, blocks.tolist(), sizes)],
            dtype=np.int64,
        )
        shards = max(1, min(-(-int(sum(targets)) // shard_words), PLAN_CELLS // max(1, len(names))))
        ends = np.cumsum(split_quotas(quotas, shards, seed), axis=0) if names else np.zeros((1, 0), dtype=np.int64)
        self.epochs = int(np.ceil(most_repeats))
        self.plan = Plan(
            names, np.array(sizes, dtype=np.int64), np.cumsum([0, *sizes])[:-1], np.array(targets), width, blocks, quotas, ends, seed
        )

    def taken(self) -> DataFrame:
        """Every document with its source's words and target, the words that the mix takes of it, and where they lie.

        ``places`` are the document's own ``pieces()`` as (shard, slot, first_word, n_words), in the order of the mix.
        """
        plan, columns, source_name = self.plan, [*self.columns, ROW], self.source
        index = {name: i for i, name in enumerate(plan.names)}

        def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                source = np.array([index[s] for s in batch.column(source_name).to_pylist()], dtype=np.int64)
                added = [pa.array(plan.sizes[source]), pa.array(plan.targets[source])]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + added, names=[*columns, "source_size", "target"])

        schema = self.rows.drop("__before").schema.add("source_size", "long").add("target", "double")
        every = self._light().mapInArrow(describe, schema)
        own = self.pieces().groupBy(ROW).agg(
            F.sum("n_words").alias("__taken"), F.sort_array(F.collect_list(F.struct("shard", "slot", "first_word", "n_words"))).alias("__places")
        )
        found = every.join(own, ROW, "left")
        none = F.array().cast(own.schema["__places"].dataType)
        return found.select(
            *self.columns,
            "source_size",
            "target",
            F.coalesce("__taken", F.lit(0).cast("long")).alias("taken"),
            F.coalesce("__places", none).alias("places"),
        )

    def pieces(self) -> DataFrame:
        """The mix: one row for each run of words drawn, with its shard and its place in the shuffled shard."""
        plan, epochs, source_name = self.plan, self.epochs, self.source
        reading = (self.source, self.size, self.whole)
        kept = [*[c for c in self.columns if c != self.source], ROW]

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, source, size, start, row, block, low, high in plan.scan(batches, *reading):
                for epoch in range(epochs):
                    draws = plan.draws(source[row], block, epoch)
                    here = np.flatnonzero((draws < plan.quotas[source[row]]) & (high > low))
                    at = row[here]
                    columns = [batch.column(c).take(pa.array(at)) for c in kept]
                    columns += [
                        batch.column(source_name).take(pa.array(at)),
                        pa.array(plan.shard(source[at], draws[here])),
                        pa.array(np.full(len(here), epoch, dtype=np.int32)),
                        pa.array(block[here]),
                        pa.array((low - start[row])[here]),
                        pa.array((high - low)[here]),
                    ]
                    names = [*kept, "source", "shard", "epoch", "block", "first_word", "n_words"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        schema = self.rows.select(*kept, F.col(self.source).alias("source")).schema
        for name, kind in (("shard", "int"), ("epoch", "int"), ("block", "long"), ("first_word", "long"), ("n_words", "long")):
            schema = schema.add(name, {"int": "integer"}.get(kind, kind))
        drawn = self._light().mapInArrow(draw, schema)
        own = [c for c in kept if c != ROW]
        # slots count from 1 in each shard; rows are dealt to ranges of (shard, hash), as a shard may be most of the mix
        order = [F.col("shard"), F.xxhash64("source", "epoch", "block", *own), *[F.col(c) for c in (*kept, "first_word", "epoch")]]
        placed, _ = running_totals(drawn.withColumn("__one", F.lit(1)), order, {"__at": "__one"})
        placed = cut_lineage(placed)
        begin = cut_lineage(placed.groupBy("shard").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows")))
        found = with_facts(placed, begin, ["shard"], "__rows", F.hash(ROW, "block", "epoch"))
        return found.withColumn("slot", (F.col("__at") - F.col("__first") + 1).cast("int")).drop("__one", "__at", "__first")

    def _light(self) -> DataFrame:
        return self.rows.select(*self.columns, "__before", ROW)
