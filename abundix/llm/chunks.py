"""Chunks: a table as compressed files of some MB in the shared folder, and an exchange of packed keys between them.

``stage_chunks`` copies the wanted columns once, with no shuffle. Operators that need several passes over whole
texts, each with what the other chunks have answered, then send only packed keys through Spark's shuffle:

* ``repeated_keys`` takes rows (chunk, bucket, probe, indexed) and answers each chunk which of its indexed keys
  occur at least twice among all probes;
* ``visit_chunks`` groups answers by chunk and runs a function on each chunk's rows with its answers.

A bucket holds a share of the key space, so its size follows from the number of buckets, and a key that every
chunk holds enters its bucket at most twice per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundix.llm import files
from abundix.llm.words import release, small_batches
from abundix.session import cut_lineage

CHUNK_BYTES = 8 << 20
MANIFEST = "chunk string, n_rows long, n_bytes long"
REQUEST = "chunk string, bucket int, probe binary, indexed binary"
ANSWER = "chunk string, keys binary"


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.Table]:
    """Tables of about ``most`` bytes of text, in the order of the rows."""
    held, size = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = batch.num_rows - at
            while take > 1 and batch.slice(at, take).column(text).nbytes > most:
                take = (take + 1) // 2
            part = batch.slice(at, take)
            at += take
            held.append(part)
            size += part.column(text).nbytes
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def stage_chunks(df: DataFrame, text: str, most: int = CHUNK_BYTES) -> DataFrame:
    """Write the table as chunk files; returns their manifest, checkpointed."""
    folder = files.new_folder(df.sparkSession, "chunks")
    small_batches(df.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, text, most):
            if table.num_rows == 0:
                continue
            name = files.new_name(folder, "chunk", ".arrow")
            with files.create(name) as out:
                with pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as sink:
                    sink.write_table(table)
            yield pa.RecordBatch.from_pydict(
                {"chunk": [name], "n_rows": pa.array([table.num_rows]), "n_bytes": pa.array([table.column(text).nbytes])}
            )

    return cut_lineage(df.mapInArrow(write, MANIFEST))


def open_chunk(name: str) -> pa.Table:
    return pa.ipc.open_file(files.read(name)).read_all().combine_chunks()


def each_chunk(manifest: DataFrame, fn: Callable[[str, pa.Table], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """Run ``fn(name, rows)`` on every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("chunk").to_pylist():
                yield from fn(name, open_chunk(name))
        release()

    return spread(manifest).mapInArrow(run, schema)


def spread(manifest: DataFrame) -> DataFrame:
    """One row of the manifest is minutes of work for a task, so deal them out evenly."""
    spark = manifest.sparkSession
    return manifest.select("chunk").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_chunk(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """About one task for each chunk: a few bytes of answers stand for MBs of text, so their size must not merge tasks."""
    return rows.repartition(max(1, min(manifest.count(), 1 << 17)), "chunk")


def bucket_count(manifest: DataFrame, bytes_each: int = 8 << 20) -> int:
    """Number of buckets so that a bucket's keys come from about ``bytes_each`` bytes of text."""
    total = manifest.agg(F.sum("n_bytes")).first()[0] or 0
    return max(1, min(1 << 24, -(-total // bytes_each)))


def twice_at_most(keys: np.ndarray) -> np.ndarray:
    """Sorted keys, each at most twice."""
    keys = np.sort(keys)
    if len(keys) < 3:
        return keys
    keep = np.ones(len(keys), dtype=bool)
    keep[2:] = keys[2:] != keys[:-2]
    return keys[keep]


def requests(name: str, buckets: int, probes: np.ndarray, indexed: np.ndarray, kind: np.dtype, owners=None) -> Iterator[pa.RecordBatch]:
    """Rows of ``REQUEST`` for 64-bit hashes; ``owners`` are second hashes of (probes, indexed) that pick the bucket."""
    packed = {}
    for i, keys in enumerate((probes, indexed)):
        owner = ((keys if owners is None else owners[i]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        packed[i] = (stored(keys, kind)[order], np.searchsorted(owner[order], np.arange(buckets + 1)))
    (p, pc), (i, ic) = packed[0], packed[1]
    used = np.flatnonzero((np.diff(pc) > 0) | (np.diff(ic) > 0)).tolist()
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([name] * len(used), pa.string()),
            pa.array(used, pa.int32()),
            pa.array([twice_at_most(p[pc[b] : pc[b + 1]]).tobytes() for b in used], pa.binary()),
            pa.array([np.unique(i[ic[b] : ic[b + 1]]).tobytes() for b in used], pa.binary()),
        ],
        names=["chunk", "bucket", "probe", "indexed"],
    )


def stored(hashes: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The part of a hash that travels: all of it, or its upper half."""
    return hashes if np.dtype(kind) == np.uint64 else (hashes >> np.uint64(32)).astype(np.uint32)


def answered(hashes: np.ndarray, buckets: int, kind: np.dtype) -> np.ndarray:
    """What ``repeated_keys`` answers for these hashes: upper half and bucket, if only that travelled."""
    if np.dtype(kind) == np.uint64:
        return hashes
    return (hashes >> np.uint64(32) << np.uint64(32)) | (hashes % np.uint64(buckets))


def repeated_keys(asked: DataFrame, kind: np.dtype) -> DataFrame:
    """Rows of ``ANSWER``: the indexed keys with two probes or more."""
    kind = np.dtype(kind)

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        probes = np.sort(np.concatenate([np.frombuffer(x, dtype=kind) for x in table.column("probe").to_pylist()]))
        again = np.unique(probes[1:][probes[1:] == probes[:-1]])
        chunk, keys = [], []
        for name, packed in zip(table.column("chunk").to_pylist(), table.column("indexed").to_pylist()):
            own = np.frombuffer(packed, dtype=kind)
            found = own[is_in(own, again)].astype(np.uint64)
            if len(found):
                if kind != np.uint64:
                    found = (found << np.uint64(32)) | np.uint64(key[0].as_py())
                chunk.append(name)
                keys.append(found.tobytes())
        return pa.table([pa.array(chunk, pa.string()), pa.array(keys, pa.binary())], names=["chunk", "keys"])

    return asked.groupBy("bucket").applyInArrow(answer, ANSWER)


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if len(ordered) == 0:
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def visit_chunks(
    manifest: DataFrame, answers: DataFrame, fn: Callable[[str, pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema
) -> DataFrame:
    """Run ``fn(name, rows, keys)`` on every chunk with the sorted keys it was answered."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = [x for batch in batches for x in batch.column("keys").to_pylist() if x]
        keys = np.sort(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in packed])) if packed else np.zeros(0, np.uint64)
        name = key[0].as_py()
        yield from fn(name, open_chunk(name), keys)
        release()

    every = manifest.select("chunk", F.lit(None).cast("binary").alias("keys"))
    return by_chunk(manifest, answers.unionByName(every)).groupBy("chunk").applyInArrow(run, schema)


def visit_answers(
    manifest: DataFrame, answers: DataFrame, fn: Callable[[str, pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema
) -> DataFrame:
    """Run ``fn(name, rows, answers)`` on every chunk; ``answers`` are its rows of the table, none of them maybe.

    The second column of the answers must not be NULL.
    """

    marker = answers.columns[1]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        table = table.filter(pa.compute.is_valid(table.column(marker)))
        name = key[0].as_py()
        yield from fn(name, open_chunk(name), table)
        release()

    every = manifest.select("chunk", *[F.lit(None).cast(f.dataType).alias(f.name) for f in answers.schema if f.name != "chunk"])
    return by_chunk(manifest, answers.unionByName(every)).groupBy("chunk").applyInArrow(run, schema)
