"""From identifications and reporter ions to ratio tables and kinase activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def link_quantities(psm: DataFrame, ions: DataFrame, fractions: DataFrame, design: DataFrame) -> DataFrame:
    """Identifications with intensities (dataset, scan), then plex of the dataset, then sample of the channel."""
    linked = psm.join(ions, ["dataset", "scan"]).join(fractions, "dataset")
    return linked.join(design, ["plex_id", "channel"])


def reporter_ratios(
    linked: DataFrame,
    references: DataFrame,
    key: Sequence[str],
    *,
    intensity: str = "intensity",
) -> DataFrame:
    """log2 of summed intensity over the reference channel of the same plex, per key and sample.

    ``references`` is (plex_id, reference): the channel that serves as denominator. Sums combine map-side;
    a missing or zero reference gives NULL.
    """
    marked = linked.join(references, "plex_id").withColumn("__is_base", F.col("channel") == F.col("reference"))
    sums = marked.groupBy(*key, "plex_id", "channel", "measurement", "__is_base").agg(F.sum(intensity).alias("__sum"))
    # a window holds the channels of one plex
    plex = W.partitionBy(*key, "plex_id")
    sums = sums.withColumn("__base", F.sum(F.when(F.col("__is_base"), F.col("__sum"))).over(plex))
    ratio = F.when(F.col("__base") > 0, F.log2(F.col("__sum") / F.col("__base")))
    return sums.where(~F.col("__is_base")).select(*key, F.col("measurement").alias("sample"), ratio.alias("log_ratio"))


def kinase_activity(
    sites: DataFrame, substrates: DataFrame, *, sample: str = "sample", value: str = "value", score: str = "score"
) -> DataFrame:
    """Mean change, mean score and number of substrate sites per kinase and sample.

    Both inputs share (gene, residue); sites are one row per (gene, residue, sample).
    """
    return (
        sites.join(substrates, ["gene", "residue"])
        .groupBy("kinase", sample)
        .agg(
            F.avg(value).alias("mean_lfc"),
            F.avg(score).alias("mean_score"),
            F.count(F.lit(1)).alias("n_substrates"),
        )
    )
