"""Order-dependent operators for groups of any size: running totals, ranks, quantiles.

A plain window over ``partitionBy(group)`` puts a group into one task. Here all rows are dealt to ranges of
(group, order) whose bounds Spark takes from a sample of the rows, so a large group spreads over as many ranges as
its share asks for, whatever its values look like. Ranges are summed, the small table of range totals (one row
per group and range) gets the window over the group, and only rows of one group in one range share a task. There
is one plan at every size.

NULL and NaN both mean missing: ``grouped_rank`` and ``grouped_quantiles`` leave such rows out; keys and orders
given to ``prefix_scan`` must not be missing.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from abundix.session import cut_lineage

_RANGE = "__range"
_REDUCE = {"sum": F.sum, "min": F.min, "max": F.max}


def keys_of(by: str | Iterable[str] | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def present(df: DataFrame, value: str) -> Column:
    """Neither NULL nor NaN."""
    known = F.col(value).isNotNull()
    return known & ~F.isnan(value) if isinstance(df.schema[value].dataType, (DoubleType, FloatType)) else known


def cut_ranges(df: DataFrame, by: str | Iterable[str] | None, *order: str | Column) -> DataFrame:
    """A checkpointed copy dealt to ranges of (by, order), with the number of the range in ``__range``.

    The checkpoint keeps bounds and numbers the same for all that is read from the copy.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(parts, *keys_of(by), *order).withColumn(_RANGE, F.spark_partition_id()))


def prefix_scan(
    held: DataFrame,
    by: str | Iterable[str] | None,
    order: str,
    measures: Mapping[str, tuple[str, Column]],
    *,
    descending: bool = False,
) -> DataFrame:
    """Running ``sum``, ``min`` or ``max`` along ``order`` in each group, the current row included.

    ``held`` comes from ``cut_ranges(df, by, order)`` and keeps its ranges. ``measures`` maps a new column to
    (kind, expression). Every measure also gets ``<name>_total``, the value over the whole group. ``order`` must
    be unique in a group (collapse equal values first).
    """
    keys = keys_of(by)

    def along(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    totals = held.groupBy(*keys, _RANGE).agg(*[_REDUCE[kind](expr).alias(name) for name, (kind, expr) in measures.items()])
    group = W.partitionBy(*keys)
    before = group.orderBy(along(_RANGE)).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        _RANGE,
        *[_REDUCE[kind](name).over(before).alias(f"__before_{name}") for name, (kind, _) in measures.items()],
        *[_REDUCE[kind](name).over(group).alias(f"{name}_total") for name, (kind, _) in measures.items()],
    )
    inside = W.partitionBy(*keys, _RANGE).orderBy(along(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = held.join(offsets, [*keys, _RANGE])
    for name, (kind, expr) in measures.items():
        here, earlier = _REDUCE[kind](expr).over(inside), F.col(f"__before_{name}")
        if kind == "sum":
            combined = here + F.when(earlier.isNull(), F.lit(0)).otherwise(earlier)
        else:
            combined = (F.least if kind == "min" else F.greatest)(here, earlier)
        out = out.withColumn(name, combined)
    return out.drop(*[f"__before_{name}" for name in measures])


def grouped_rank(
    df: DataFrame,
    by: str | Iterable[str] | None,
    value: str,
    tie: str,
    *,
    rank: str = "rank",
    total: str | None = None,
    descending: bool = True,
) -> DataFrame:
    """Position 1, 2, ... of each row in its group by ``value``; equal values follow md5(``tie``), then ``tie``.

    Hash order for ties is deliberate: a value that very many rows share is cut into ranges of the hash. Rows
    without a value have no rank and are left out, as in a sort that drops missing values.
    """
    keys = keys_of(by)
    rows = df.where(present(df, value)).withColumn("__hash", F.md5(F.col(tie).cast("string").cast("binary")))
    order = [F.col(value).desc() if descending else F.col(value).asc(), F.col("__hash"), F.col(tie)]
    held = cut_ranges(rows, keys, *order)
    sizes = held.groupBy(*keys, _RANGE).agg(F.count(F.lit(1)).alias("__n"))
    group = W.partitionBy(*keys)
    earlier = group.orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        *keys, _RANGE, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"), F.sum("__n").over(group).alias("__total")
    )
    inside = W.partitionBy(*keys, _RANGE).orderBy(*order)
    out = held.join(starts, [*keys, _RANGE]).withColumn(rank, (F.col("__start") + F.row_number().over(inside)).cast("long"))
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.select(*df.columns, rank, *([total] if total else []))


def grouped_quantiles(
    df: DataFrame,
    by: str | Iterable[str] | None,
    value: str,
    probs: Mapping[str, float],
    *,
    count: str | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Equal values are counted first; the counts get running totals, and the values that hold a wanted position
    are picked by an aggregate.
    """
    keys = keys_of(by)
    levels = df.where(present(df, value)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    steps = prefix_scan(cut_ranges(levels, keys, value), keys, value, {"__end": ("sum", F.col("__n"))})
    start, end, size = F.col("__end") - F.col("__n"), F.col("__end"), F.col("__end_total")

    def position(prob: float) -> Column:
        return (size - 1) * F.lit(float(prob))

    def holds(spot: Column) -> Column:
        return (spot >= start) & (spot < end)

    parts: list[Column] = [F.max("__end_total").alias("__end_total")]
    for name, prob in probs.items():
        parts.append(F.max(F.when(holds(F.floor(position(prob))), F.col(value))).alias(f"__lo_{name}"))
        parts.append(F.max(F.when(holds(F.ceil(position(prob))), F.col(value))).alias(f"__hi_{name}"))
    ends = steps.groupBy(*keys).agg(*parts)
    columns: list[Column] = [F.col(k) for k in keys]
    if count:
        columns.append(size.alias(count))
    for name, prob in probs.items():
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        share = position(prob) - F.floor(position(prob))
        columns.append((low + share * (high - low)).alias(name))
    return ends.select(*columns)


def grouped_median(df: DataFrame, by: str | Iterable[str] | None, value: str, name: str = "median") -> DataFrame:
    return grouped_quantiles(df, by, value, {name: 0.5})
