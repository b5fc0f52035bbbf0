"""Group comparisons: Welch, pooled, moderated and paired tests, multiple-testing adjustment.

All comparisons run in one job. Values are first reduced to (feature, condition) statistics; the catalogue
of comparisons is joined to those, so another comparison costs a join with small rows, not another scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abundix.functions.special import digamma, inverse_trigamma, t_two_sided_p, trigamma
from abundix.operators.ordered import cut_ranges, keys_of, prefix_scan, present
from abundix.operators.reshape import listed
from abundix.session import cut_lineage


def condition_stats(
    df: DataFrame,
    *,
    feature: str = "feature",
    sample: str = "sample",
    value: str = "value",
    condition: str = "condition",
    by: str | Sequence[str] | None = None,
    collapsed: bool = False,
) -> DataFrame:
    """Count, mean and variance of sample means per feature and condition.

    ``collapsed`` says that each (feature, sample) is one row already, which saves a shuffle.
    """
    keys = keys_of(by)
    if collapsed:
        cells = df.withColumn("__v", F.col(value))
    else:
        cells = df.groupBy(*keys, feature, sample, condition).agg(F.avg(value).alias("__v"))
    return cells.groupBy(*keys, feature, condition).agg(
        F.count("__v").alias("n"), F.avg("__v").alias("mean"), F.var_samp("__v").alias("var")
    )


def _side(side: int) -> list[Column]:
    here = F.col("side") == side
    n = F.sum(F.when(here, F.col("n")))
    weighted = F.sum(F.when(here, F.col("n") * F.col("mean")))
    squares = (F.col("n") - 1) * F.coalesce("var", F.lit(0.0)) + F.col("n") * F.pow(F.col("mean") - F.col("__center"), 2)
    return [
        F.coalesce(n, F.lit(0)).alias(f"n{side}"),
        (weighted / F.nullif(n, F.lit(0))).alias(f"m{side}"),
        F.when(n > 1, F.sum(F.when(here, squares)) / (n - 1)).alias(f"v{side}"),
    ]


def comparison_stats(stats: DataFrame, catalogue: DataFrame, *, feature: str = "feature", by: str | Sequence[str] | None = None) -> DataFrame:
    """Both sides of every comparison side by side; conditions of one side are merged.

    A side's squares are taken around its own mean, which keeps small variances of large values exact. The
    window and the aggregate share one shuffle, and a group has as many rows as the catalogue has conditions.
    """
    keys = keys_of(by)
    rows = stats.where(F.col("n") > 0).join(catalogue, "condition")
    group = W.partitionBy(*keys, "comparison", feature)

    def center(side: int) -> Column:
        weighted = F.when(F.col("side") == side, F.col("n") * F.col("mean"))
        return F.sum(weighted).over(group) / F.sum(F.when(F.col("side") == side, F.col("n"))).over(group)

    centred = rows.withColumn("__center", F.when(F.col("side") == 1, center(1)).otherwise(center(2)))
    return centred.groupBy(*keys, "comparison", feature).agg(*_side(1), *_side(2))


def welch_test(pairs: DataFrame) -> DataFrame:
    """Unequal-variance t of side 2 against side 1; NULL with fewer than two values on either side."""
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    usable = (F.col("n1") > 1) & (F.col("n2") > 1) & (a + b > 0)
    df = (a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))
    return (
        pairs.withColumn("effect", F.col("m2") - F.col("m1"))
        .withColumn("t", F.when(usable, F.col("effect") / F.sqrt(a + b)))
        .withColumn("df", F.when(usable, df))
    )


def pooled_test(pairs: DataFrame) -> DataFrame:
    """Equal-variance t: log_fc = mean 2 - mean 1, pooled variance ``s2`` on ``d`` degrees of freedom."""
    n1, n2 = F.col("n1"), F.col("n2")
    both = (n1 > 0) & (n2 > 0)
    d = n1 + n2 - 2
    s2 = ((n1 - 1) * F.coalesce("v1", F.lit(0.0)) + (n2 - 1) * F.coalesce("v2", F.lit(0.0))) / d
    return (
        pairs.where(both)
        .withColumn("log_fc", F.col("m2") - F.col("m1"))
        .withColumn("ave", (n1 * F.col("m1") + n2 * F.col("m2")) / (n1 + n2))
        .withColumn("d", d)
        .withColumn("s2", F.when(d > 0, s2))
        .withColumn("unscaled", 1 / n1 + 1 / n2)
        .withColumn("t", F.when(F.col("s2") > 0, F.col("log_fc") / F.sqrt(F.col("s2") * F.col("unscaled"))))
    )


def paired_test(
    df: DataFrame,
    treated: Column,
    *,
    block: str = "patient",
    feature: str = "feature",
    value: str = "value",
    by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Effect of treatment within blocks: least squares with one intercept per block.

    Sums of squares within each block add up to those of the centred regression (Frisch-Waugh), so two
    grouped aggregates replace the model matrix.
    """
    keys = keys_of(by)
    rows = df.where(F.col(value).isNotNull()).withColumn("__x", F.when(treated, 1.0).otherwise(0.0))
    blocks = rows.groupBy(*keys, feature, block).agg(
        F.count(F.lit(1)).alias("__n"),
        (F.var_pop("__x") * F.count(F.lit(1))).alias("__xx"),
        (F.var_pop(value) * F.count(F.lit(1))).alias("__yy"),
        (F.covar_pop("__x", value) * F.count(F.lit(1))).alias("__xy"),
    )
    sums = blocks.groupBy(*keys, feature).agg(
        F.sum("__n").alias("n"),
        F.count(F.lit(1)).alias("n_blocks"),
        F.sum("__xx").alias("__xx"),
        F.sum("__yy").alias("__yy"),
        F.sum("__xy").alias("__xy"),
    )
    d = F.col("n") - F.col("n_blocks") - 1
    slope = F.col("__xy") / F.col("__xx")
    return (
        sums.where(F.col("__xx") > 0)
        .withColumn("log_fc", slope)
        .withColumn("d", d)
        .withColumn("s2", F.when(d > 0, F.greatest(F.col("__yy") - F.col("__xy") * slope, F.lit(0.0)) / d))
        .withColumn("unscaled", 1 / F.col("__xx"))
        .withColumn("t", F.when(F.col("s2") > 0, F.col("log_fc") / F.sqrt(F.col("s2") * F.col("unscaled"))))
        .drop("__xx", "__yy", "__xy")
    )


def variance_prior(tests: DataFrame, by: str | Sequence[str] | None = "comparison") -> DataFrame:
    """Scaled inverse chi-square prior (d0, s02) per comparison by matching moments of ln(s2) (Smyth 2004)."""
    keys = keys_of(by)
    half = F.col("d") / 2.0
    e = F.log("s2") - digamma(half, F.log) + F.log(half)
    moments = tests.where((F.col("s2") > 0) & (F.col("d") > 0)).groupBy(*keys).agg(
        F.avg(e).alias("__mean"),
        (F.var_samp(e) - F.avg(trigamma(half))).alias("__excess"),
        F.sum("d").cast("double").alias("df_pooled"),
    )
    finite = F.col("__excess") > 0
    d0 = F.when(finite, 2.0 * inverse_trigamma(F.col("__excess"))).otherwise(F.lit(float("inf")))
    priors = moments.withColumn("d0", d0)
    s02 = F.when(finite, F.exp(F.col("__mean") + digamma(F.col("d0") / 2.0, F.log) - F.log(F.col("d0") / 2.0)))
    return priors.withColumn("s02", s02.otherwise(F.exp("__mean"))).select(*keys, "d0", "s02", "df_pooled")


def moderate(tests: DataFrame, d0: Column, s02: Column, df_pooled: Column | None = None) -> DataFrame:
    """Posterior variance and moderated t from a prior; total df is capped by the pooled df when given."""
    posterior = F.when(d0 == float("inf"), s02).otherwise(
        (d0 * s02 + F.col("d") * F.coalesce("s2", F.lit(0.0))) / (d0 + F.col("d"))
    )
    total = F.col("d") + d0
    if df_pooled is not None:
        total = F.least(total, df_pooled)
    return (
        tests.withColumn("s2_post", posterior)
        .withColumn("df_total", total.cast("double"))
        .withColumn("t_mod", F.when(posterior > 0, F.col("log_fc") / F.sqrt(posterior * F.col("unscaled"))))
    )


def moderated_test(tests: DataFrame, by: str | Sequence[str] | None = "comparison") -> DataFrame:
    """Moderated t with a fitted prior, p-value and adjusted p-value within each comparison; one prior for all without ``by``."""
    keys = keys_of(by)
    if not keys:
        return moderated_test(tests.withColumn("__all", F.lit(0)), "__all").drop("__all")
    priors = variance_prior(tests, keys)
    joined = tests.join(priors, keys)
    fitted = moderate(joined, F.col("d0"), F.col("s02"), F.col("df_pooled"))
    return bh_adjust(fitted.withColumn("p", t_two_sided_p("t_mod", "df_total")), keys, "p")


def bh_adjust(df: DataFrame, by: str | Sequence[str] | None, p: str = "p", out: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg adjustment within each group; a missing p (NULL or NaN) gets NULL and is not counted.

    Works on distinct p with counts: equal p get equal results, and a p shared by very many rows (1.0) is
    one row before any window sees it.
    """
    keys = keys_of(by)
    df = cut_lineage(df)
    levels = df.where(present(df, p)).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("__n"))
    ranks = prefix_scan(cut_ranges(levels, keys, p), keys, p, {"__rank": ("sum", F.col("__n"))})
    raw = ranks.withColumn("__raw", F.col(p) * F.col("__rank_total") / F.col("__rank"))
    adjusted = prefix_scan(raw, keys, p, {"__min": ("min", F.col("__raw"))}, descending=True)
    adjusted = adjusted.select(*keys, p, F.least(F.col("__min"), F.lit(1.0)).alias(out))
    known = df.where(present(df, p)).join(adjusted, [*keys, p]).select(*df.columns, out)
    missing = df.where(F.coalesce(~present(df, p), F.lit(True))).select(*df.columns, F.lit(None).cast("double").alias(out))
    return known.unionByName(missing)


def patient_effects(
    df: DataFrame, before: Column, after: Column, *, patient: str = "patient", feature: str = "feature", value: str = "value"
) -> DataFrame:
    """Mean after minus mean before per patient and feature, where both arms have a value."""
    arms = df.groupBy(patient, feature).agg(
        F.avg(F.when(before, F.col(value))).alias("mean_before"), F.avg(F.when(after, F.col(value))).alias("mean_after")
    )
    both = arms.where(F.col("mean_before").isNotNull() & F.col("mean_after").isNotNull())
    return both.withColumn("effect", F.col("mean_after") - F.col("mean_before"))


def label_direction(df: DataFrame, *, effect: str = "log_fc", p: str = "p_adj", cutoff: float = 0.05) -> DataFrame:
    return df.withColumn("direction", F.when(F.col(effect) > 0, "UpReg").otherwise("DownReg")).withColumn(
        "significance", F.when(F.col(p) < cutoff, "Significant").otherwise("Non-significant")
    )


def direction_flow(labelled: DataFrame, comparisons: Sequence[str], *, feature: str = "feature") -> DataFrame:
    """How many features take each path of up, down or absent through the ordered comparisons."""
    hits = labelled.where(F.col("significance") == "Significant")
    hits = hits.withColumn("comparison", listed("comparison", comparisons))
    wide = hits.groupBy(feature).pivot("comparison", list(comparisons)).agg(F.first("direction"))
    wide = wide.na.fill("absent", list(comparisons))
    return wide.groupBy(*[F.col(f"`{c}`") for c in comparisons]).agg(F.count(F.lit(1)).alias("n"))
