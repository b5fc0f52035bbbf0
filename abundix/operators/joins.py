"""Joins of facts with metadata, maps and other results.

No broadcast is forced: a metadata side is broadcast by its statistics or by adaptive execution once its
size has been seen, and a larger one gets a sort-merge join with skew splitting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundix.operators.ordered import keys_of
from abundix.operators.reshape import listed


def with_metadata(fact: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """Left join on one key; the second key column does not stay."""
    if dim_key and dim_key != key:
        dim = dim.withColumnRenamed(dim_key, key)
    return fact.join(dim, key, "left")


def join_on_number(fact: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Left join after both keys became whole numbers, so that ``01`` meets ``1``."""
    left = fact.withColumn(key, F.col(key).try_cast("long"))
    right = dim.withColumn(dim_key, F.col(dim_key).try_cast("long"))
    return with_metadata(left, right, key, dim_key)


def merge_shared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on every column name that both tables have."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared, "inner")


def align_results(df: DataFrame, key: str, by: str, value: str, ids: Sequence[str]) -> DataFrame:
    """One row per key of the first id, one column per id; a key that another id lacks is NULL there."""
    wide = df.withColumn(by, listed(by, ids)).groupBy(key).pivot(by, list(ids)).agg(F.avg(value))
    first_keys = df.where(F.col(by) == ids[0]).select(key).distinct()
    return wide.join(first_keys, key, "left_semi")


def replicate_baseline(df: DataFrame, is_baseline: Column, arm: str, arms: Sequence[str]) -> DataFrame:
    """Copy each baseline row once per arm, keep all other rows as they are."""
    copies = df.where(is_baseline).withColumn(arm, F.explode(F.array(*[F.lit(a) for a in arms])))
    return copies.unionByName(df.where(~is_baseline))


def remap_ids(df: DataFrame, mapping: DataFrame, key: str, new_key: str) -> DataFrame:
    """Replace ``key`` by ``new_key`` of the map; rows without a partner are dropped."""
    return df.join(mapping.select(key, new_key), key, "left").where(F.col(new_key).isNotNull()).drop(key)


def union_by_label(parts: dict[str, DataFrame], label: str) -> DataFrame:
    """Stack unlike sources by column name with the name of the source beside each row."""
    stacked = None
    for name, part in parts.items():
        tagged = part.withColumn(label, F.lit(name))
        stacked = tagged if stacked is None else stacked.unionByName(tagged)
    return stacked


def shared_keys(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    keys = keys_of(key)
    return left.select(*keys).intersect(right.select(*keys))
