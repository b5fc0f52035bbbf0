"""Projections, predicates and recoding."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundix.functions.numeric import missing_to_null


def cast_text_numbers(df: DataFrame, columns: Iterable[str], decimal: str = ".") -> DataFrame:
    """Text to DOUBLE; text that is no number becomes NULL."""
    out = df
    for name in columns:
        text = F.col(name) if decimal == "." else F.replace(F.col(name), F.lit(decimal), F.lit("."))
        out = out.withColumn(name, text.try_cast("double"))
    return out


def drop_missing(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn(value, missing_to_null(F.col(value))).where(F.col(value).isNotNull())


def keep_listed(df: DataFrame, listed: DataFrame, key: str, *, negate: bool = False) -> DataFrame:
    """Rows whose key is (not) in the other table's column of the same name."""
    return df.join(listed.select(key), key, "left_anti" if negate else "left_semi")


def keep_matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(F.col(column).rlike(pattern))


def significant(
    df: DataFrame, p: str, cutoff: float, effect: str | None = None, min_effect: float | None = None
) -> DataFrame:
    out = df.where(F.col(p) < cutoff)
    if effect is not None and min_effect is not None:
        out = out.where(F.abs(F.col(effect)) > min_effect)
    return out


def ion_quality(df: DataFrame, min_interference: float = 0.5, min_s2n: float = 0.0) -> DataFrame:
    return df.where((F.col("interference") >= min_interference) & (F.col("s2n") >= min_s2n))


def drop_decoys(df: DataFrame, decoy: str = "is_decoy") -> DataFrame:
    return df.where(~F.col(decoy))


def keep_modified(df: DataFrame, peptide: str = "peptide", mark: str = "*") -> DataFrame:
    return df.where(F.col(peptide).contains(mark))


def present_in_share(
    df: DataFrame, share: float = 0.5, *, feature: str = "feature", sample: str = "sample", value: str = "value"
) -> DataFrame:
    """Rows of features that have a value in at least ``share`` of all samples."""
    n_samples = df.agg(F.count_distinct(sample).alias("n")).scalar()
    seen = df.where(F.col(value).isNotNull()).groupBy(feature).agg(F.count_distinct(sample).alias("__seen"))
    return df.join(seen.where(F.col("__seen") >= F.lit(share) * n_samples), feature, "left_semi")


def present_in_every_batch(
    df: DataFrame, batch: str, *, feature: str = "feature", value: str = "value", at_least: int = 1
) -> DataFrame:
    """Rows of features that have ``at_least`` values in every batch."""
    n_batches = df.agg(F.count_distinct(batch).alias("n")).scalar()
    seen = df.where(F.col(value).isNotNull()).groupBy(feature, batch).agg(F.count(F.lit(1)).alias("__n"))
    full = seen.where(F.col("__n") >= at_least).groupBy(feature).agg(F.count(F.lit(1)).alias("__batches"))
    return df.join(full.where(F.col("__batches") == n_batches), feature, "left_semi")


def recode(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """First rule that holds wins; no rule and no default gives NULL."""
    chain = None
    for condition, outcome in rules:
        chain = F.when(condition, outcome) if chain is None else chain.when(condition, outcome)
    return chain if default is None else chain.otherwise(default)


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First rows of an order; Spark keeps n rows per task and merges them, no full sort."""
    return df.orderBy(*order).limit(n)
