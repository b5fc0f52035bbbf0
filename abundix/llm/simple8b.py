"""Token ids in files of Simple-8b words, with escapes and per-block offsets.

A file holds documents in order. Ids are packed in blocks of ``BLOCK``; each 64-bit word has a 4-bit selector and as
many ids of one width as fit into 60 bits. Selector 0 is an escape: its low bits are the place of an id of more
than 60 bits in the list of the file. Blocks start on a word of their own, so any block decodes alone and all
blocks of a group decode together, one numpy step per selector. Layout, little-endian:

    words | word offset of each block (u64, n + 1) | escaped ids (u64) | ids of each document (u64)
    | document keys (i64) | key present (u8) | header of seven u64 counts | magic

Defined results: NULL text is the empty text, which is the end id alone; NULL keys come first; repeated keys stay
separate documents in the order of their texts' hashes; an empty table gives no file. Other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundix.llm import files
from abundix.llm.chunks import is_in
from abundix.llm.running import running_totals
from abundix.llm.words import ranges, word_slices
from abundix.session import cut_lineage

BLOCK = 1024
GROUP = 1024
SPARE = 60
MAGIC = b"S8BIDS01"
# Fixed values of the coding: ids per word and bits per id, for selectors 1 to 14.
SHAPES = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([1, *[n for n, _ in SHAPES], 0], dtype=np.int64)
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_SMALL = np.searchsorted(_POWERS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)
CACHED_WORDS = 1_000_000


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    out = _SMALL[np.minimum(ids, np.uint64(65535)).astype(np.int64)]
    large = ids > np.uint64(65535)
    if large.any():
        out[large] = np.searchsorted(_POWERS, ids[large], side="right")
    return out


def pack(ids: np.ndarray, escaped_before: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, number of words of each block, and escaped ids of a run of whole blocks (the last may be short)."""
    ids = ids.astype(np.uint64)
    blocks = -(-len(ids) // BLOCK)
    held = np.zeros((blocks, BLOCK), dtype=np.uint64)
    held.reshape(-1)[: len(ids)] = ids
    held = np.concatenate([held, np.zeros((blocks, SPARE), dtype=np.uint64)], axis=1)
    lengths = np.full(blocks, BLOCK)
    if blocks:
        lengths[-1] = len(ids) - (blocks - 1) * BLOCK
    bits = bit_lengths(held.reshape(-1)).reshape(held.shape)
    choice = np.where(bits > 60, 0, 14).astype(np.uint8)

    widest = {1: bits}
    for n, parts in ((2, (1, 1)), (3, (2, 1)), (4, (2, 2)), (5, (4, 1)), (6, (4, 2)), (7, (4, 3)), (8, (4, 4)), (10, (8, 2)),
                     (12, (8, 4)), (15, (8, 7)), (20, (10, 10)), (30, (15, 15)), (60, (30, 30))):
        first, rest = parts
        whole = widest[first].copy()
        np.maximum(whole[:, :-first], widest[rest][:, first:], out=whole[:, :-first])
        widest[n] = whole
    for selector, (n, width) in reversed(list(enumerate(SHAPES, 1))):
        choice[widest[n] <= width] = selector

    begins = np.zeros(held.shape, dtype=bool)
    at, live = np.zeros(blocks, dtype=np.int64), np.arange(blocks)
    while len(live):
        begins[live, at] = True
        at = at + COUNTS[choice[live, at]]
        going = at < lengths[live]
        at, live = at[going], live[going]
    block, place = np.nonzero(begins)
    chosen = choice[block, place]
    words = chosen.astype(np.uint64) << np.uint64(60)
    flat, base = held.reshape(-1), block * (BLOCK + SPARE) + place
    for selector, (n, width) in enumerate(SHAPES, 1):
        here = np.flatnonzero(chosen == selector)
        if len(here):
            spread = flat[base[here][:, None] + np.arange(n)] << (np.arange(n, dtype=np.uint64) * np.uint64(width))
            words[here] |= np.bitwise_or.reduce(spread, axis=1)
    here = np.flatnonzero(chosen == 0)
    words[here] |= np.arange(len(here), dtype=np.uint64) + np.uint64(escaped_before)
    return words, np.bincount(block, minlength=blocks), flat[base[here]]


def unpack(words: np.ndarray, counts: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """Ids of whole blocks with these numbers of words; the padding of a short last block is left in."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[selectors])
    block = np.repeat(np.arange(len(counts)), counts)
    firsts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    begin = ends - COUNTS[selectors]
    base = block * (BLOCK + SPARE) + begin - begin[firsts][block]
    out = np.zeros(len(counts) * (BLOCK + SPARE), dtype=np.uint64)
    for selector, (n, width) in enumerate(SHAPES, 1):
        here = np.flatnonzero(selectors == selector)
        if len(here):
            shifted = words[here][:, None] >> (np.arange(n, dtype=np.uint64) * np.uint64(width))
            out[base[here][:, None] + np.arange(n)] = shifted & np.uint64((1 << width) - 1)
    here = np.flatnonzero(selectors == 0)
    out[base[here]] = escaped[(words[here] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out.reshape(len(counts), BLOCK + SPARE)[:, :BLOCK].reshape(-1)


class Writer:
    """A file of packed ids, written as it grows."""

    def __init__(self, uri: str):
        self.uri, self.out = uri, files.create(uri)
        self.waiting: list[np.ndarray] = []
        self.held = self.n_ids = 0
        self.block_words: list[np.ndarray] = []
        self.escaped: list[np.ndarray] = []
        self.keys: list[int | None] = []
        self.lengths: list[np.ndarray] = []

    def add(self, keys: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
        self.keys += keys
        self.lengths.append(lengths)
        self.waiting.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= BLOCK * GROUP:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, dtype=np.uint64)
        at = 0
        while len(ids) - at >= BLOCK * GROUP or (last and at < len(ids)):
            words, counts, escaped = pack(ids[at : at + BLOCK * GROUP], sum(map(len, self.escaped)))
            self.out.write(words.astype("<u8").tobytes())
            self.block_words.append(counts)
            self.escaped.append(escaped)
            at += BLOCK * GROUP
        self.waiting, self.held = [ids[at:]], max(0, len(ids) - at)

    def close(self) -> None:
        self._flush(True)
        counts = np.concatenate(self.block_words) if self.block_words else np.zeros(0, dtype=np.int64)
        escaped = np.concatenate(self.escaped) if self.escaped else np.zeros(0, dtype=np.uint64)
        lengths = np.concatenate(self.lengths) if self.lengths else np.zeros(0, dtype=np.int64)
        present = np.array([k is not None for k in self.keys], dtype=np.uint8)
        keys = np.array([k or 0 for k in self.keys], dtype="<i8")
        offsets = np.concatenate([[0], np.cumsum(counts)])
        header = np.array([offsets[-1], len(counts), len(escaped), len(keys), self.n_ids, BLOCK, 1], dtype="<u8")
        for part in (offsets.astype("<u8"), escaped.astype("<u8"), lengths.astype("<u8"), keys, present, header):
            self.out.write(part.tobytes())
        self.out.write(MAGIC)
        self.out.close()


class Reader:
    """Any block, or all of them, of a file of packed ids."""

    def __init__(self, data):
        data = memoryview(data)
        if bytes(data[-8:]) != MAGIC:
            raise ValueError("not a file of packed ids")
        n_words, blocks, n_escaped, docs, self.n_ids, _, _ = np.frombuffer(data[-64:-8], dtype="<u8").tolist()
        at = 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.words, self.offsets = take("<u8", n_words), take("<u8", blocks + 1).astype(np.int64)
        self.escaped, self.lengths = take("<u8", n_escaped), take("<u8", docs).astype(np.int64)
        self.keys, self.present = take("<i8", docs), take("u1", docs).astype(bool)

    def blocks(self, first: int, last: int) -> np.ndarray:
        low, high = self.offsets[first], self.offsets[last]
        ids = unpack(self.words[low:high], np.diff(self.offsets[first : last + 1]), self.escaped)
        return ids[: max(0, self.n_ids - first * BLOCK)]

    def ids(self) -> np.ndarray:
        n = len(self.offsets) - 1
        parts = [self.blocks(i, min(n, i + GROUP)) for i in range(0, n, GROUP)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def texts(words: pa.Array) -> list[str]:
    """Bytes that are no UTF-8 are replaced."""
    try:
        return words.cast(pa.string()).to_pylist()
    except pa.ArrowInvalid:
        return [w.decode("utf-8", "replace") for w in words.to_pylist()]


class WordTokens:
    """Ids of words for a tokenizer that treats the words of a text one by one; each distinct word is encoded once."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model)
        self._forget()

    def _forget(self) -> None:
        self.known, self.place = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.flat, self.bounds = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the number of ids of each."""
        got = self.model.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(got.ids, dtype=np.uint32), np.bincount(np.array(got.word_ids, dtype=np.int64), minlength=len(words))

    def __call__(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice and the number of ids of each of its rows."""
        keys, inverse = np.unique(words.hashes(), return_inverse=True)
        some = np.zeros(len(keys), dtype=np.int64)
        some[inverse] = np.arange(len(inverse))
        if len(self.known) + len(keys) > CACHED_WORDS:
            self._forget()
        new = np.flatnonzero(~is_in(keys, self.known))
        flat, bounds = [self.flat], [self.bounds]
        for low in range(0, len(new), 4096):
            ids, lengths = self.encode(texts(words.some(some[new[low : low + 4096]])))
            flat.append(ids)
            bounds.append(bounds[-1][-1] + np.cumsum(lengths))
        self.flat, self.bounds = np.concatenate(flat), np.concatenate(bounds)
        at = np.searchsorted(self.known, keys[new])
        self.place = np.insert(self.place, at, np.arange(len(self.known), len(self.known) + len(new)))
        self.known = np.insert(self.known, at, keys[new])
        place = self.place[np.searchsorted(self.known, keys)][inverse]
        lengths = self.bounds[place + 1] - self.bounds[place]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[ranges(self.bounds[place], lengths)], np.diff(sums[words.bounds])


_LOADED: dict[int, WordTokens] = {}


def word_tokens(model: str) -> WordTokens:
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordTokens(model)
    return _LOADED[key]


def with_ends(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after each row."""
    out = np.full(len(ids) + len(lengths), end, dtype=np.uint32)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[np.arange(len(ids)) + row] = ids
    return out, lengths + 1


def write_ids(
    df: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end: int = 2, file_bytes: int = 48 << 20
) -> DataFrame:
    """Encode and write the documents in ascending order of ``key``; returns the manifest (file, part, n_docs, n_ids).

    ``tokenizer`` is the path of a tokenizer file whose words do not depend on their neighbours; its text is sent
    to the tasks.
    """
    spark = df.sparkSession
    with open(tokenizer, encoding="utf-8") as source:
        model = spark.sparkContext.broadcast(source.read())
    folder = files.new_folder(spark, "ids")
    rows = df.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))
    size = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    order = [F.col("__key").asc_nulls_first(), F.xxhash64("__text")]
    ordered = rows.repartitionByRange(max(1, -(-size // file_bytes)), *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, encode, part = None, None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if out is None:
                part = batch.column("__part")[0].as_py()
                out, encode = Writer(files.new_name(folder, f"ids-{part:07d}", ".s8b")), word_tokens(model.value)
            for words in word_slices(batch.column("__text")):
                ids, lengths = with_ends(*encode(words), end)
                out.add(batch.column("__key").slice(words.first, words.last - words.first).to_pylist(), lengths, ids)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [out.uri], "part": [part], "n_docs": [len(out.keys)], "n_ids": [out.n_ids]})

    ordered = ordered.withColumn("__part", F.spark_partition_id().cast("long"))
    return cut_lineage(ordered.mapInArrow(write, "file string, part long, n_docs long, n_ids long"))


def read_ids(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: key, ids of all documents before it, its number of ids, and their crc32."""
    spark = manifest.sparkSession
    placed, _ = running_totals(manifest, [F.col("part")], {"start": "n_ids"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                file = Reader(files.read(uri))
                ids = file.ids().astype("<u4")
                ends = np.cumsum(file.lengths)
                begins = ends - file.lengths
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(file.keys, mask=~file.present),
                        pa.array(begins + start),
                        pa.array(file.lengths),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files_only = placed.select("file", "start").repartition(parts)
    return files_only.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
