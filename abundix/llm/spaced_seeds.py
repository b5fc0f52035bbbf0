"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a run of words: words under a 1 must agree, words under a 0 are ignored. Hashes of all
seeds of the benchmark are joined with those of the documents; each hit fixes a diagonal, and along it the item
and the document are compared word by word. An overlap counts where ``least_words`` words in a row agree but for
``most_errors`` of them (substitutions), and is then extended over all such windows.

The masks below hit every placement of two substitutions in thirteen words. Shorter items are compared as a whole: 8
to 12 words may have one substitution, so each half is a seed (one of them has none); 5 to 7 words have one seed, all
their words, and must agree; 1 to 4 words say too little inside a text and must be all the words of a document.

Only documents with a hit in a Bloom filter of the benchmark's seeds (at most 2**28 bits, whatever the benchmark's
size) are shuffled; a fuller filter lets more documents through to the join, never fewer. Defined results: NULL texts have no words; NULL ids are kept as they are; repeated documents and
items are separate rows; an empty table on either side gives no rows; other columns are not read. Upper-case A-Z
counts as lower-case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from abundix.llm.words import Words, mix64, ranges, release, small_batches, word_slices
from abundix.session import cut_lineage

# The masks.
MASKS = ("11011111", "11110001011", "101101111", "1011010111")
LEAST_WORDS, MOST_ERRORS, LEAST_ITEM, LEAST_HALVED = 13, 2, 5, 8
MOST_BITS, BITS_EACH, PLACES = 1 << 28, 128, 6
_BASE = np.uint64(0xD6E8FEB86659FD93)
HITS = ArrayType(StructType().add("at", "long").add("hash", "long"))
FOUND = "doc_id {doc}, item_id {item}, doc_word long, item_word long, n_words long, n_agree long"


def offsets_of(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seed_hashes(hashes: np.ndarray, starts: np.ndarray, mask: str) -> np.ndarray:
    total = np.zeros(len(starts), dtype=np.uint64)
    for offset in offsets_of(mask):
        total = (total + hashes[starts + offset]) * _BASE
    return mix64(total, int(mask, 2))


def seeds(words: Words, masks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every mask at every place in its row; masks of whole short items (``=``) only where they fill it."""
    hashes, starts, keys = words.hashes(), [], []
    for mask in masks:
        whole = mask.startswith("=")
        mask = mask.removeprefix("=")
        room = np.maximum(words.counts - len(mask) + 1, 0)
        at = ranges(words.bounds[:-1], np.where(words.counts == len(mask), 1, 0) if whole else room)
        starts.append(at)
        keys.append(seed_hashes(hashes, at, mask))
    return np.concatenate(starts), np.concatenate(keys)


def item_seeds(items: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (item, key, words, at, hash), one for each seed; ``item`` numbers the rows."""
    rows = items.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__item"))
    schema = rows.select(F.col("__item").alias("item"), F.col("__key").alias("item_id")).schema
    schema = schema.add("item_words", "binary").add("hits", HITS)
    hit = pa.struct([("at", pa.int64()), ("hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_slices(batch.column("__text"), lower=True):
                part = batch.slice(words.first, words.last - words.first)
                all_hashes, packed, hits = words.hashes(), [], []
                for low, high in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
                    own, found = all_hashes[low:high], []
                    for mask, at in item_masks(high - low):
                        found += zip(at.tolist(), seed_hashes(own, at, mask).view(np.int64).tolist())
                    packed.append(own.tobytes())
                    hits.append([{"at": a, "hash": h} for a, h in found])
                yield pa.RecordBatch.from_arrays(
                    [part.column("__item"), part.column("__key"), pa.array(packed, pa.binary()), pa.array(hits, pa.list_(hit))],
                    names=["item", "item_id", "item_words", "hits"],
                )

    return cut_lineage(cut_lineage(rows).mapInArrow(run, schema))


def item_masks(n_words: int) -> list[tuple[str, np.ndarray]]:
    """The masks of an item, and the places where each lies in it."""
    if n_words >= LEAST_WORDS:
        return [(mask, np.arange(n_words - len(mask) + 1)) for mask in MASKS]
    if n_words >= LEAST_HALVED:
        half = n_words // 2
        return [("1" * half, np.array([0])), ("1" * (n_words - half), np.array([half]))]
    return [("1" * n_words, np.array([0]))] if n_words else []


def doc_masks(lengths: list[int]) -> list[str]:
    """The masks that documents need for items of these lengths."""
    out = list(MASKS)
    for n in lengths:
        if 0 < n < LEAST_ITEM:
            out.append("=" + "1" * n)
        elif n < LEAST_WORDS:
            out += [mask for mask, _ in item_masks(n)]
    # a mask for all places finds whole short texts, too
    return [m for m in dict.fromkeys(out) if not (m.startswith("=") and m[1:] in out)]


def place_of(hashes: np.ndarray, turn: int, bits: int) -> np.ndarray:
    return ((mix64(hashes, turn) if turn else hashes) & np.uint64(bits - 1)).astype(np.int64)


def seed_filter(hashes: DataFrame, n_seeds: int) -> tuple[np.ndarray, int]:
    """Bloom filter of all seed hashes, built in segments of 2**16 bits; bounded by ``MOST_BITS``."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * n_seeds - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("hash").to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([place_of(own, turn, bits) for turn in range(PLACES)]))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 16), pa.array(at)], names=["segment", "place"])

    def segment(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = np.zeros(1 << 16, dtype=np.uint8)
        own[table.column("place").to_numpy() & 0xFFFF] = 1
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["segment", "bits"])

    parts = hashes.select("hash").mapInArrow(places, "segment long, place long").distinct().groupBy("segment")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in parts.applyInArrow(segment, "segment long, bits binary").collect():
        out[row["segment"] << 13 : (row["segment"] + 1) << 13] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out, bits


def maybe_seeds(hashes: np.ndarray, known: np.ndarray, bits: int) -> np.ndarray:
    """Places of the hashes that the filter lets through."""
    left = np.arange(len(hashes))
    for turn in range(PLACES):
        place = place_of(hashes[left], turn, bits)
        left = left[((known[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1).astype(bool)]
    return left


def overlaps(doc: np.ndarray, item: np.ndarray, diagonal: int) -> list[tuple[int, int, int, int]]:
    """(doc word, item word, words, words that agree) of the overlaps on a diagonal (document minus item place)."""
    low, high = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    width = min(LEAST_WORDS, len(item))
    if high - low < width:
        return []
    if len(item) < LEAST_ITEM and len(doc) != len(item):
        return []
    errors = MOST_ERRORS if len(item) >= LEAST_WORDS else 1 if len(item) >= LEAST_HALVED else 0
    agree = doc[low + diagonal : high + diagonal] == item[low:high]
    sums = np.concatenate([[0], np.cumsum(agree)])
    good = np.flatnonzero(sums[width:] - sums[:-width] >= width - errors)
    out = []
    for run in np.split(good, np.flatnonzero(np.diff(good) > width) + 1) if len(good) else []:
        first, last = int(run[0]), int(run[-1]) + width
        inside = np.flatnonzero(agree[first:last])
        first, last = first + int(inside[0]), first + int(inside[-1]) + 1
        out.append((first + low + diagonal, first + low, last - first, int(sums[last] - sums[first])))
    return out


def contaminated(
    docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row for each overlap of a document with an item: where it lies in both, its words, and those that agree."""
    spark = docs.sparkSession
    small_batches(spark)
    indexed = item_seeds(items, item_key, item_text)
    item_hits = indexed.select("item", F.explode("hits").alias("hit")).select("item", F.col("hit.at").alias("item_at"), F.col("hit.hash").alias("hash"))
    counted = indexed.agg(F.sum(F.size("hits")), F.collect_set(F.when(F.octet_length("item_words") < 8 * LEAST_WORDS, F.octet_length("item_words") / 8))).first()
    masks = doc_masks(sorted(int(n) for n in counted[1]))
    bits, size = seed_filter(item_hits, int(counted[0] or 0))
    shared = spark.sparkContext.broadcast(bits)

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__text"))
    hit = pa.struct([("at", pa.int64()), ("hash", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for words in word_slices(batch.column("__text"), lower=True):
                at, keys = seeds(words, masks)
                found = maybe_seeds(keys, known, size)
                if len(found) == 0:
                    continue
                at, keys = at[found], keys[found].view(np.int64)
                row = np.searchsorted(words.bounds, at, side="right") - 1
                order = np.argsort(row, kind="stable")
                at, keys, row = at[order], keys[order], row[order]
                own, firsts = np.unique(row, return_index=True)
                hashes = words.hashes()
                bounds = words.bounds
                packed = [hashes[bounds[r] : bounds[r + 1]].tobytes() for r in own.tolist()]
                struct = pa.StructArray.from_arrays([pa.array(at - bounds[row]), pa.array(keys)], fields=list(hit))
                lists = pa.ListArray.from_arrays(pa.array([*firsts.tolist(), len(row)], pa.int32()), struct)
                ids = batch.column("doc_id").take(pa.array(own + words.first))
                yield pa.RecordBatch.from_arrays([ids, pa.array(packed, pa.binary()), lists], names=["doc_id", "doc_words", "hits"])
        release()

    schema = rows.select("doc_id").schema.add("doc_words", "binary").add("hits", HITS)
    hit_docs = rows.mapInArrow(search, schema).withColumn("doc", F.monotonically_increasing_id())
    hit_docs = cut_lineage(hit_docs)
    doc_hits = hit_docs.select("doc", F.explode("hits").alias("hit")).select("doc", F.col("hit.at").alias("doc_at"), F.col("hit.hash").alias("hash"))
    lines = doc_hits.join(item_hits, "hash").select("doc", "item", (F.col("doc_at") - F.col("item_at")).alias("diagonal")).distinct()
    pairs = lines.groupBy("doc", "item").agg(F.collect_list("diagonal").alias("diagonals"))
    pairs = pairs.join(indexed.select("item", "item_id", "item_words"), "item").join(hit_docs.select("doc", "doc_id", "doc_words"), "doc")
    pairs = pairs.select("doc_id", "item_id", "doc_words", "item_words", "diagonals")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, found = [], []
            for i in range(batch.num_rows):
                doc = np.frombuffer(batch.column(2)[i].as_py(), dtype=np.uint64)
                item = np.frombuffer(batch.column(3)[i].as_py(), dtype=np.uint64)
                for diagonal in sorted(batch.column(4)[i].as_py()):
                    for overlap in overlaps(doc, item, diagonal):
                        index.append(i)
                        found.append(overlap)
            columns = list(zip(*found)) or [[], [], [], []]
            at = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c, pa.int64()) for c in columns]],
                names=["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_agree"],
            )

    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")}
    return pairs.mapInArrow(verify, FOUND.format(doc=kinds["doc_id"], item=kinds["item_id"]))
