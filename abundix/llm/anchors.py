"""Substring dedup with fixed-block anchors.

With blocks of b = (width + 1) / 2 words, each window of ``width`` words holds a whole block of its document. Blocks
that do not overlap are the index, every rolling window of b words of every document probes it. A block whose
words start anywhere else is an anchor; only windows around anchors are extended, by comparing the hash of all
``width`` words, to the runs of windows whose words start elsewhere: the maximal exact repeats.

Both exchanges send packed hashes between chunks (see ``chunks``): half hashes for the anchors, whole ones with a
second, independent hash for the bucket in the extension, so no list of places of a frequent passage is ever built.

Defined results: NULL and empty texts have no words and stay empty; all places of a repeat go, the first included;
repeated rows repeat each other; overlapping places in one document count as two; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundix.llm.chunks import REQUEST, answered, bucket_count, each_chunk, is_in, repeated_keys, requests, stage_chunks, visit_chunks
from abundix.llm.words import Words, windows, word_slices
from abundix.session import cut_lineage

HALF, WHOLE = np.uint32, np.uint64


def aligned(words: Words, starts: np.ndarray, block: int) -> np.ndarray:
    """Which starts are the start of a block of their row."""
    row = np.searchsorted(words.bounds, starts, side="right") - 1
    return (starts - words.bounds[row]) % block == 0


def extended(words: Words, keys: np.ndarray, width: int, block: int, buckets: int) -> np.ndarray:
    """Starts of the windows whose first whole block is an anchor."""
    starts, rolling = windows(words.hashes(), words.bounds, block)
    own = aligned(words, starts, block)
    anchor = np.zeros(len(words.starts) + width + block, dtype=bool)
    anchor[starts[own]] = is_in(answered(rolling[own], buckets, HALF), keys)
    counts = np.maximum(words.counts - width + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    begin = words.bounds[:-1][row]
    at = begin + np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
    return at[anchor[begin + -(-(at - begin) // block) * block]]


def window_hashes(words: Words, starts: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hashes of the windows that begin at these words."""
    every, hashes = windows(words.hashes(seed), words.bounds, width, seed)
    return hashes[np.searchsorted(every, starts)]


def repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 35) -> DataFrame:
    """Per document: ``n_words``, ``n_removed``, the removed ``spans`` of words and the ``kept`` text, its words joined by spaces."""
    block = (width + 1) // 2
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    manifest = stage_chunks(rows, "__text")
    buckets = bucket_count(manifest)

    def anchors(name: str, table: pa.Table) -> Iterator[pa.RecordBatch]:
        probes, index = [], []
        for words in word_slices(table.column("__text")):
            starts, hashes = windows(words.hashes(), words.bounds, block)
            probes.append(hashes)
            index.append(hashes[aligned(words, starts, block)])
        yield from requests(name, buckets, np.concatenate(probes), np.concatenate(index), HALF)

    found = cut_lineage(repeated_keys(each_chunk(manifest, anchors, REQUEST), HALF))

    def extend(name: str, table: pa.Table, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys) == 0:
            return
        hashes, owners = [], []
        for words in word_slices(table.column("__text")):
            at = extended(words, keys, width, block, buckets)
            hashes.append(window_hashes(words, at, width, 0))
            owners.append(window_hashes(words, at, width, 1))
        whole, owner = np.concatenate(hashes), np.concatenate(owners)
        yield from requests(name, buckets, whole, whole, WHOLE, (owner, owner))

    again = cut_lineage(repeated_keys(visit_chunks(manifest, found, extend, REQUEST), WHOLE))
    span = pa.struct([("first", pa.int64()), ("last", pa.int64())])

    def cut(name: str, table: pa.Table, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        for words in word_slices(table.column("__text")):
            starts, hashes = windows(words.hashes(), words.bounds, width)
            hits = starts[is_in(hashes, keys)]
            steps = np.zeros(len(words.starts) + width + 1, dtype=np.int64)
            np.add.at(steps, hits, 1)
            np.add.at(steps, hits + width, -1)
            gone = np.cumsum(steps)[: len(words.starts)] > 0
            kept, spans, removed = [], [], []
            for i, (low, high) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())):
                own = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes().split()
                flags = gone[low:high]
                count = int(flags.sum())
                removed.append(count)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))).reshape(-1, 2).tolist() if count else []
                spans.append([{"first": a, "last": b} for a, b in edges])
                kept.append(b" ".join([w for w, f in zip(own, flags.tolist()) if not f] if count else own))
            part = table.slice(words.first, words.last - words.first)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("__key").combine_chunks(),
                    pa.array(words.counts.astype(np.int64)),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(span)),
                    pa.array(kept, pa.binary()),
                ],
                names=[key, "n_words", "n_removed", "spans", "kept"],
            )

    kind = rows.schema["__key"].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words long, n_removed long, spans array<struct<first:long,last:long>>, kept binary"
    out = visit_chunks(manifest, again, cut, schema)
    return out.withColumn("kept", F.col("kept").cast("string"))
