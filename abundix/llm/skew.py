"""Joining facts about keys to rows when a few keys may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with less than this share of all rows may land in one task.
HOT_SHARE = 1000
SPREAD = 1 << 20


def with_facts(rows: DataFrame, facts: DataFrame, on: Sequence[str], weight: str, spread: Column) -> DataFrame:
    """Left join of ``rows`` with ``facts`` (one row a key, no NULL keys, written or checkpointed before).

    ``weight`` is a key's number of rows. At most ``HOT_SHARE`` keys can hold a thousandth of all rows or more: these
    are broadcast, and their rows are dealt by ``spread`` in the ordinary join of all other keys, where they meet
    nothing.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    names = [c for c in facts.columns if c not in on and c != weight]
    is_hot = F.col(weight) * F.lit(HOT_SHARE) >= F.lit(total)
    found = F.struct(F.lit(True).alias("__met"), *names)
    hot = facts.where(is_hot).select(*on, found.alias("__hot"))
    cold = facts.where(~is_hot).select(*on, F.lit(0).alias("__spread"), found.alias("__cold"))
    out = rows.join(F.broadcast(hot), list(on), "left")
    apart = F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.lit(1) + F.pmod(spread, F.lit(SPREAD)).cast("int"))
    out = out.withColumn("__spread", apart).join(cold, [*on, "__spread"], "left")
    either = F.coalesce("__hot", "__cold")
    return out.select(*[F.col(c) for c in rows.columns], *[either[c].alias(c) for c in names])
