"""Principal components of samples by block subspace iteration; no matrix of samples ever leaves the executors.

The centred matrix (features x samples) lies in dense blocks (feature block, sample block) as packed bytes. A step
multiplies it with a basis, itself a table of blocks of samples: first to features, then back to samples, each a join
on the block number and a sum of small matrices. The basis is made orthonormal again by a tall-skinny QR: each block of
samples gives its triangle, triangles are stacked and reduced in a tree, and every block divides by the last one. What
comes to the driver are matrices of the basis width squared. With no more samples than the basis is wide, one step is
exact; otherwise the iteration ends when all wanted components satisfy A v = l v, and not reaching that is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abundix.operators.aggregate import collapse_duplicates
from abundix.session import cut_lineage

SAMPLE_BLOCK = 1024
BLOCK_CELLS = 1 << 20
WIDTH = 32
EXACT = 256
_EXTRA = 8
_FAN = 64


def _packed(matrix: np.ndarray) -> bytes:
    return np.ascontiguousarray(matrix, dtype=np.float64).tobytes()


def _matrix(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data).reshape(-1, columns)


@dataclass
class Blocks:
    """``cells``: (fb, sb, n, data) with n features by the block's samples; ``axis``: (sample, at); ``total``: sum of squares."""

    cells: DataFrame
    axis: DataFrame
    samples: int
    per_block: int
    total: float


def centred_blocks(
    df: DataFrame, *, feature: str = "feature", sample: str = "sample", value: str = "value", sample_block: int = SAMPLE_BLOCK
) -> Blocks:
    """Blocks of the features that every sample has, each from its mean. Repeated cells are averaged; missing ones are gaps."""
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(sample).isNotNull())
    cells = cut_lineage(collapse_duplicates(known, [feature, sample], value).select(feature, sample, F.col(value).cast("double").alias("__v")))
    names = cells.select(sample).distinct()
    # one row per sample; the numbers are made once and written
    axis = cut_lineage(names.withColumn("__at", F.row_number().over(W.orderBy(sample)) - 1))
    samples = axis.count()
    stats = cells.groupBy(feature).agg(F.count(F.lit(1)).alias("__n"), F.avg("__v").alias("__mean")).where(F.col("__n") == samples)
    height = max(1, BLOCK_CELLS // max(1, min(samples, sample_block)))
    blocks = max(1, -(-stats.count() // height))
    place = F.pmod(F.xxhash64(feature), F.lit(blocks)).cast("int")
    numbered = stats.withColumn("fb", place).withColumn("__row", F.row_number().over(W.partitionBy("fb").orderBy(feature)) - 1)
    numbered = cut_lineage(numbered.select(feature, "fb", "__row", "__mean"))
    placed = cells.join(numbered, feature).join(axis, sample)
    placed = placed.select(
        "fb",
        F.floor(F.col("__at") / sample_block).cast("int").alias("sb"),
        F.col("__row").alias("row"),
        (F.col("__at") % sample_block).alias("at"),
        (F.col("__v") - F.col("__mean")).alias("v"),
    )

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        fb, sb = key[0].as_py(), key[1].as_py()
        row, at = table.column("row").to_numpy(), table.column("at").to_numpy()
        matrix = np.zeros((int(row.max()) + 1, min(sample_block, samples - sb * sample_block)))
        matrix[row, at] = table.column("v").to_numpy()
        return pa.table(
            {"fb": pa.array([fb], pa.int32()), "sb": pa.array([sb], pa.int32()), "n": pa.array([len(matrix)], pa.int64()), "data": pa.array([_packed(matrix)], pa.binary())}
        )

    packed = cut_lineage(placed.groupBy("fb", "sb").applyInArrow(pack, "fb int, sb int, n long, data binary"))
    squares = placed.agg(F.sum(F.col("v") * F.col("v"))).first()[0]
    return Blocks(packed, axis, samples, sample_block, float(squares or 0.0))


def _products(blocks: DataFrame, other: DataFrame, on: str, width: int, flip: bool) -> DataFrame:
    """Sum of block * other (or block' * other) over the blocks that share a row (or a column) of blocks: (to, m).

    A task sums what it holds before anything is shuffled.
    """
    to = "sb" if flip else "fb"
    joined = blocks.join(other.withColumnsRenamed({"m": "other"}), on).select("n", "data", F.col(to).alias("to"), "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, data, key, basis in zip(*(batch.column(i).to_pylist() for i in range(4))):
                matrix = np.frombuffer(data).reshape(n, -1)
                product = (matrix.T if flip else matrix) @ _matrix(basis, width)
                held[key] = held[key] + product if key in held else product
                if len(held) >= 256:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    def rows(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([_packed(m) for m in held.values()], pa.binary())], names=["to", "m"])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(m) for m in table.column("m").to_pylist())
        return pa.table({to: pa.array([key[0].as_py()], pa.int32()), "m": pa.array([_packed(total)], pa.binary())})

    parts = joined.mapInArrow(run, "to int, m binary")
    return parts.groupBy("to").applyInArrow(add, f"{to} int, m binary")


def applied(blocks: Blocks, basis: DataFrame, width: int) -> DataFrame:
    """A times the basis, with A the samples' matrix of products: (sb, m)."""
    return _products(blocks.cells, _products(blocks.cells, basis, "sb", width, False), "fb", width, True)


def _each(basis: DataFrame, fn, schema: str = "sb int, m binary") -> DataFrame:
    """``fn(block number, *matrices)`` of every row."""
    own = [c for c in basis.columns if c != "sb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("sb").to_pylist()
            out = [_packed(fn(sb, *ms)) for sb, *ms in zip(numbers, *(batch.column(c).to_pylist() for c in own))]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(out, pa.binary())], names=["sb", "m"])

    return basis.mapInArrow(run, schema)


def triangle(basis: DataFrame, width: int) -> np.ndarray:
    """R of the QR decomposition of all rows, by a tree of QRs of stacked triangles."""
    reduced = _each(basis, lambda _, m: np.linalg.qr(_matrix(m, width), mode="r"))

    def stack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tall = np.concatenate([_matrix(m, width) for m in table.column("m").to_pylist()])
        return pa.table({"sb": pa.array([key[0].as_py()], pa.int32()), "m": pa.array([_packed(np.linalg.qr(tall, mode="r"))], pa.binary())})

    left = basis.agg(F.max("sb")).first()[0] + 1
    while left > 1:
        reduced = reduced.withColumn("sb", F.floor(F.col("sb") / _FAN).cast("int")).groupBy("sb").applyInArrow(stack, "sb int, m binary")
        left = -(-left // _FAN)
    return _matrix(reduced.first()["m"], width)


def orthonormal(basis: DataFrame, width: int) -> DataFrame:
    """The basis of the same space with orthonormal columns; twice, as one division leaves rounding errors."""
    for _ in range(2):
        r = triangle(basis, width)
        # directions that the space lacks are left at zero
        u, s, vt = np.linalg.svd(r)
        inverse = vt.T * np.where(s > 1e-13 * max(s[0], 1e-300), 1.0 / np.where(s > 0, s, 1.0), 0.0)
        basis = cut_lineage(_each(basis, lambda _, m, by=inverse: _matrix(m, width) @ by))
    return basis


def _inner(basis: DataFrame, width: int, fn) -> np.ndarray:
    """Sum over all blocks of a small matrix made of the block's matrices."""
    parts = _each(basis, lambda _, *ms: fn(*[_matrix(m, width) for m in ms]))

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(m) for m in table.column("m").to_pylist())
        return pa.table({"sb": pa.array([0], pa.int32()), "m": pa.array([_packed(total)], pa.binary())})

    spread = parts.withColumn("sb", F.floor(F.col("sb") / _FAN).cast("int")).groupBy("sb").applyInArrow(add, "sb int, m binary")
    one = spread.withColumn("sb", F.lit(0)).groupBy("sb").applyInArrow(add, "sb int, m binary").first()
    return np.frombuffer(one["m"])


def component_scores(
    df: DataFrame,
    n_components: int = 2,
    *,
    width: int = WIDTH,
    exact: int = EXACT,
    sample_block: int = SAMPLE_BLOCK,
    max_steps: int = 300,
    tolerance: float = 1e-9,
    seed: int = 1,
    **names: str,
) -> DataFrame:
    """Rows (sample, component, score, share); the largest absolute score of each component is positive, ties by sample.

    Over features that every sample has. A component beyond the rank has scores of zero.
    """
    sample = names.get("sample", "sample")
    spark = df.sparkSession
    blocks = centred_blocks(df, sample_block=sample_block, **names)
    n = blocks.samples
    width = min(max(n, 1), max(exact if n <= exact else width, n_components + _EXTRA))
    if n == 0 or blocks.total == 0.0:
        numbers = F.explode(F.sequence(F.lit(1), F.lit(n_components))).alias("component")
        return blocks.axis.select(F.col(sample).alias("sample"), numbers, F.lit(0.0).alias("score"), F.lit(0.0).alias("share"))
    numbered = spark.range(-(-n // sample_block)).select(F.col("id").cast("int").alias("sb"))

    def start(sb: int) -> np.ndarray:
        rows = min(sample_block, n - sb * sample_block)
        return np.random.default_rng([seed, sb]).normal(size=(rows, width)) if n > width else np.eye(n)[sb * sample_block : sb * sample_block + rows]

    basis = orthonormal(_each(numbered, start), width)
    wanted = min(n_components, width)
    for step in range(max_steps):
        image = cut_lineage(applied(blocks, basis, width).withColumnRenamed("m", "image"))
        both = basis.join(image, "sb")
        small = _inner(both, width, lambda v, z: v.T @ z).reshape(width, width)
        roots, turn = np.linalg.eigh((small + small.T) / 2)
        roots, turn = roots[::-1], turn[:, ::-1]
        off = _inner(both, width, lambda v, z, turn=turn, roots=roots: (((z @ turn) - (v @ turn) * roots) ** 2).sum(axis=0))
        if np.sqrt(off[:wanted]).max() <= tolerance * max(roots[0], 1e-300):
            break
        basis = orthonormal(image.withColumnRenamed("image", "m"), width)
    else:
        raise RuntimeError(f"the components did not settle in {max_steps} steps; widen the basis")

    by = turn[:, :wanted] * np.sqrt(np.maximum(roots[:wanted], 0.0))
    shares = np.maximum(roots[:wanted], 0.0) / blocks.total

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sb, data in zip(batch.column("sb").to_pylist(), batch.column("m").to_pylist()):
                own = _matrix(data, width) @ by
                at = np.repeat(np.arange(len(own)) + sb * sample_block, wanted)
                number = np.tile(np.arange(1, wanted + 1), len(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at.astype(np.int32)), pa.array(number.astype(np.int32)), pa.array(own.reshape(-1)), pa.array(shares[number - 1])],
                    names=["__at", "component", "score", "share"],
                )

    rows = cut_lineage(basis.mapInArrow(scores, "__at int, component int, score double, share double"))
    first = F.max_by("score", F.struct(F.round(F.abs("score"), 9), -F.col("__at")))
    signs = rows.groupBy("component").agg(F.when(first < 0, -1.0).otherwise(1.0).alias("__sign"))
    named = rows.join(signs, "component").join(blocks.axis, "__at")
    found = named.select(F.col(sample).alias("sample"), "component", (F.col("score") * F.col("__sign")).alias("score"), "share")
    if wanted == n_components:
        return found
    more = F.explode(F.sequence(F.lit(wanted + 1), F.lit(n_components))).alias("component")
    return found.unionByName(blocks.axis.select(F.col(sample).alias("sample"), more, F.lit(0.0).alias("score"), F.lit(0.0).alias("share")))
