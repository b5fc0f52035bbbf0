"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is cut into cells of about equal numbers of rows (from the counts of its distinct values, numbers
first rounded to an eighth of an octave). The cells of a row are its point; rows are ordered by the index of the
point on the Hilbert curve and the order is cut into runs of equal bytes. Neighbours on the curve agree in all
dimensions, so the minimum and maximum of any of them prunes shards.

Defined results: NULL is a value of its own in each dimension; NULL text has size 1; ties on the curve follow the
tie columns, full copies are interchangeable; rows of equal text have equal sizes and lie close on the curve, but a
run may end between them, as bytes are cut near equal whatever the copies; an empty table gives no rows; other columns are carried along,
but ``curve``, ``shard`` and ``slot`` are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from abundix.functions.numeric import order_cell
from abundix.llm.running import running_totals


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the curve of points (n x dimensions) with coordinates below 2**bits.

    From the most significant bit on, undo the reflections and exchanges of the curve, then Gray-decode.
    """
    axes = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for d in range(len(axes)):
            high = (axes[d] & level) != 0
            swap = np.where(high, 0, (axes[0] ^ axes[d]) & low)
            axes[0] = np.where(high, axes[0] ^ low, axes[0] ^ swap)
            if d:
                axes[d] = axes[d] ^ swap
        level >>= 1
    for d in range(1, len(axes)):
        axes[d] = axes[d] ^ axes[d - 1]
    flip = np.zeros_like(axes[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip = np.where((axes[-1] & level) != 0, flip ^ (level - 1), flip)
        level >>= 1
    axes = [a ^ flip for a in axes]
    index = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            index = (index << 1) | ((axis >> bit) & 1)
    return index


def sortable(df: DataFrame, name: str) -> Column:
    """Numbers on a grid of eight steps an octave, all else as text."""
    if isinstance(df.schema[name].dataType, NumericType):
        return order_cell(F.nanvl(F.col(name).cast("double"), F.lit(None)), 8)
    return F.col(name).cast("string")


def quantised(df: DataFrame, dimensions: Sequence[str], bits: int) -> DataFrame:
    """Adds ``__cell<i>``: the share of rows with a smaller value, in steps of 2**-bits."""
    for i, name in enumerate(dimensions):
        df = df.withColumn(f"__value{i}", sortable(df, name))
        counts = df.groupBy(f"__value{i}").agg(F.count(F.lit(1)).alias("__n"))
        steps, total = running_totals(counts, [F.col(f"__value{i}").asc_nulls_last()], {"__below": "__n"})
        cell = F.floor(F.col("__below") * F.lit(float(1 << bits)) / F.lit(float(max(total["__below"], 1)))).cast("int")
        steps = steps.select(F.col(f"__value{i}").alias("__key"), cell.alias(f"__cell{i}"))
        df = df.join(steps, df[f"__value{i}"].eqNullSafe(steps["__key"])).drop("__key", f"__value{i}")
    return df


def hilbert_shards(
    df: DataFrame, dimensions: Sequence[str], shards: int, *, size: str = "size", ties: Sequence[str] = (), bits: int = 8
) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1, near equal sums of ``size``), ``slot`` (gapless from 0) and ``curve``."""
    df = df.drop(*[c for c in ("curve", "shard", "slot") if c not in (size, *dimensions, *ties)])
    kept = df.columns
    points = quantised(df, dimensions, bits)
    cells = [f"__cell{i}" for i in range(len(dimensions))]

    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    points = points.withColumn("curve", index(*cells)).drop(*cells).withColumn("__one", F.lit(1).cast("long"))
    order = [F.col("curve"), *[F.col(t) for t in ties], F.col(size)]
    ordered, total = running_totals(points, order, {"__bytes": size, "__rank": "__one"})
    middle = (F.col("__bytes") + F.col(size) / 2) * F.lit(shards / max(total["__bytes"], 1))
    placed = ordered.withColumn("shard", F.least(F.floor(middle), F.lit(shards - 1)).cast("int"))
    firsts = placed.groupBy("shard").agg(F.min("__rank").alias("__first"))
    return placed.join(firsts, "shard").select(*kept, "curve", "shard", (F.col("__rank") - F.col("__first")).alias("slot"))
