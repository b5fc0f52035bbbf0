"""Wide and long forms, tokens, member lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundix.operators.ordered import grouped_rank, keys_of


def to_long(
    wide: DataFrame, ids: Sequence[str], *, sample: str = "sample", value: str = "value", keep_missing: bool = False
) -> DataFrame:
    """All columns but ``ids`` become rows; cells without a value are dropped."""
    columns = [c for c in wide.columns if c not in set(ids)]
    out = wide.unpivot([F.col(i) for i in ids], [F.col(f"`{c}`") for c in columns], sample, value)
    return out if keep_missing else out.where(F.col(value).isNotNull())


MOST_COLUMNS = 10_000


def listed(column: str, names: Sequence[str]) -> Column:
    """The column itself; a value that is not among ``names`` ends the job rather than get lost in a pivot."""
    known = F.col(column).isNull() | F.col(column).isin(list(names))
    message = F.concat(F.lit(f"{column} not among the given columns: "), F.col(column).cast("string"))
    return F.when(known, F.col(column)).otherwise(F.raise_error(message))


def names_in(df: DataFrame, column: str) -> list[str]:
    """The distinct names of a column, in order, as a wide table needs them; bounded by what a table can have."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_COLUMNS + 1).collect()
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} values of {column}: too many for columns")
    return sorted(r[0] for r in found)


def to_wide(
    df: DataFrame,
    samples: Sequence[str] | None = None,
    *,
    feature: str | Sequence[str] = "feature",
    sample: str = "sample",
    value: str = "value",
    fill: float | None = None,
    distinct: bool = False,
) -> DataFrame:
    """Mean per cell, missing ignored.

    The columns are those of the sample dimension when ``samples`` gives them, which spares a job; a row of any
    other sample is then an error. Without it the samples of the rows themselves are looked up.
    """
    ids = [feature] if isinstance(feature, str) else list(feature)
    samples = names_in(df, sample) if samples is None else list(samples)
    rows = df.select(*ids, listed(sample, samples).alias(sample), value)
    if distinct:
        rows = rows.distinct()
    wide = rows.groupBy(*ids).pivot(sample, samples).agg(F.avg(value))
    return wide if fill is None else wide.na.fill(fill, samples)


def pool_log_ratio(
    df: DataFrame, is_pool: Column, *, group: Sequence[str], value: str = "value", out: str = "log_ratio"
) -> DataFrame:
    """log10 of each value over the pool of the same group; pool rows leave, no positive pool gives NULL.

    The pool is aggregated on its own and joined back, so a group of any size stays spread.
    """
    pools = df.where(is_pool).groupBy(*group).agg(F.max(value).alias("__pool"))
    rows = df.where(~is_pool).join(pools, list(group), "left")
    return rows.withColumn(out, F.log10(value) - F.log10("__pool")).drop("__pool")


def explode_tokens(df: DataFrame, column: str, separator: str = ";") -> DataFrame:
    """One row per token of a compound value."""
    return df.withColumn(column, F.explode(F.split(column, separator)))


def mean_of_means_strict(df: DataFrame, *, target: str, part: str, sample: str = "sample", value: str = "value") -> DataFrame:
    """Mean over the parts of a target of each part's mean; NULL where any part lacks that sample."""
    parts = df.groupBy(target, part, sample).agg(F.avg(value).alias("__mean"))
    expected = df.groupBy(target).agg(F.count_distinct(part).alias("n_parts"))
    seen = parts.groupBy(target, sample).agg(
        F.count("__mean").alias("__seen"), F.avg("__mean").alias("__avg")
    )
    return seen.join(expected, target).select(
        target, sample, "n_parts", F.when(F.col("__seen") == F.col("n_parts"), F.col("__avg")).alias(value)
    )


def member_rows(df: DataFrame, group: str, member: str) -> DataFrame:
    """Distinct members in order: group, member, ``position`` from 1 and ``size``, one row each at any group size."""
    members = df.select(group, member).where(F.col(member).isNotNull()).distinct()
    return grouped_rank(members, group, member, member, rank="position", total="size", descending=False)


def collapse_members(df: DataFrame, group: str | Sequence[str], member: str, *, separator: str = "; ") -> DataFrame:
    """Sorted member string and size, one row per group.

    A string holds its whole group, so this is a last step for groups that a reader can take in; anything that
    goes on working with members uses ``member_rows`` or the rows themselves.
    """
    keys = keys_of(group)
    members = df.select(*keys, member).where(F.col(member).isNotNull()).distinct()
    return members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"), F.concat_ws(separator, F.array_sort(F.collect_list(member))).alias("members")
    )


def sets_to_long(
    df: DataFrame, term: str, members: str, *, gene: str = "gene", padding: Sequence[str] = ("null", "")
) -> DataFrame:
    """Padded member arrays to one row per member, padding cells dropped."""
    out = df.select(term, F.explode(members).alias(gene))
    return out.where(F.col(gene).isNotNull() & ~F.col(gene).isin(list(padding)))
