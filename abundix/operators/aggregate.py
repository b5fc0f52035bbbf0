"""Group summaries. All are decomposable aggregates with a map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundix.operators.filters import top_rows
from abundix.operators.ordered import grouped_quantiles
from abundix.session import cut_lineage


def collapse_duplicates(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """One mean value per key, missing ignored."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value)).where(F.col(value).isNotNull())


def mean_sd_band(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    stats = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return stats.withColumn("low", F.col("mean") - F.col("sd")).withColumn("high", F.col("mean") + F.col("sd"))


def feature_variance(
    df: DataFrame, *, feature: str = "feature", sample: str = "sample", value: str = "value"
) -> DataFrame:
    """Variance across samples of features seen in every sample; zero variance is dropped."""
    n_samples = df.agg(F.count_distinct(sample).alias("n")).scalar()
    cells = collapse_duplicates(df, [feature, sample], value)
    stats = cells.groupBy(feature).agg(F.count(value).alias("__n"), F.var_samp(value).alias("variance"))
    return stats.where((F.col("__n") == n_samples) & (F.col("variance") > 0)).select(feature, "variance")


def top_variable(df: DataFrame, n: int = 150, *, feature: str = "feature", sample: str = "sample", value: str = "value") -> DataFrame:
    """Most variable complete features, ties by name."""
    variances = feature_variance(df, feature=feature, sample=sample, value=value)
    return top_rows(variances, n, F.col("variance").desc(), F.col(feature))


def sizes_with_zero(groups: DataFrame, rows: DataFrame, key: str, out: str = "n") -> DataFrame:
    """Row count per listed group, 0 for a group without rows."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return groups.select(key).join(counts, key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def box_summary(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Count, minimum, quartiles and maximum per group, exact at any group size."""
    return grouped_quantiles(
        df, keys, value, {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}, count="n"
    )


def histogram(df: DataFrame, keys: Sequence[str], value: str, width: float, low: float = 0.0) -> DataFrame:
    bin_id = F.floor((F.col(value) - F.lit(low)) / F.lit(width)).cast("long").alias("bin")
    return df.where(F.col(value).isNotNull()).groupBy(*keys, bin_id).agg(F.count(F.lit(1)).alias("n"))


def kernel_density(df: DataFrame, keys: Sequence[str], value: str, *, points: int = 128, reach: float = 4.0) -> DataFrame:
    """Gaussian kernel density per group on a grid of ``points``: rows (keys, i, x, density).

    Bandwidth 0.9 min(sd, quartile range / 1.34) n^-0.2, the grid reaches three of these beyond the values (Silverman
    1986). Values are dealt to their two neighbouring grid points by distance, which is summed before any shuffle of size;
    the kernel then runs over grid points only, cut at ``reach`` bandwidths. A group of equal values has the bandwidth of
    sd 1; missing values are left out.
    """
    keys = list(keys)
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("__v"))
    moments = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.stddev_samp("__v").alias("__sd"))
    spots = grouped_quantiles(known, keys, "__v", {"__low": 0.0, "__q1": 0.25, "__q3": 0.75, "__high": 1.0})
    quartiles = (F.col("__q3") - F.col("__q1")) / 1.34
    spread = F.when(F.coalesce("__sd", F.lit(0.0)) <= 0, F.lit(1.0)).when(quartiles > 0, F.least("__sd", quartiles)).otherwise(F.col("__sd"))
    grid = moments.join(spots, keys).withColumn("__h", 0.9 * spread * F.pow(F.col("__n").cast("double"), F.lit(-0.2)))
    grid = grid.withColumn("__from", F.col("__low") - 3 * F.col("__h"))
    grid = grid.withColumn("__step", (F.col("__high") + 3 * F.col("__h") - F.col("__from")) / (points - 1))
    grid = cut_lineage(grid.select(*keys, "__n", "__h", "__from", "__step"))
    placed = known.join(grid, keys).withColumn("__at", (F.col("__v") - F.col("__from")) / F.col("__step"))
    below = F.least(F.floor("__at").cast("int"), F.lit(points - 2))
    shares = F.array(
        F.struct(below.alias("j"), (1 - (F.col("__at") - below)).alias("w")), F.struct((below + 1).alias("j"), (F.col("__at") - below).alias("w"))
    )
    dealt = placed.select(*keys, F.inline(shares)).groupBy(*keys, "j").agg(F.sum("w").alias("w"))
    far = F.floor(F.lit(reach) * F.col("__h") / F.col("__step")).cast("int")
    near = F.sequence(F.greatest(F.col("j") - far, F.lit(0)), F.least(F.col("j") + far, F.lit(points - 1)))
    spread_out = dealt.join(grid, keys).withColumn("i", F.explode(near))
    gap = (F.col("i") - F.col("j")) * F.col("__step") / F.col("__h")
    bell = F.exp(-gap * gap / 2) / (F.sqrt(F.lit(2.0) * F.pi()) * F.col("__h") * F.col("__n"))
    sums = spread_out.groupBy(*keys, "i").agg(F.sum(F.col("w") * bell).alias("density"))
    every = grid.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    out = every.join(sums, [*keys, "i"], "left")
    return out.select(*keys, "i", (F.col("__from") + F.col("i") * F.col("__step")).alias("x"), F.coalesce("density", F.lit(0.0)).alias("density"))
