"""Study design: sample metadata, visits, cohorts, comparison catalogue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abundix.functions.text import cell_line_parts, plex_name, visit_parts
from abundix.operators.ordered import grouped_rank, keys_of


def sample_metadata(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Select, rename (``{old: new}``) and de-duplicate."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in columns.items()]).distinct()


def dataset_fractions(df: DataFrame, dataset: str) -> DataFrame:
    """Distinct datasets with the plex that their name carries."""
    return df.select(F.col(dataset).alias("dataset")).distinct().withColumn("plex_id", plex_name(F.col("dataset")))


def first_per_group(df: DataFrame, by: str | Sequence[str], *order: str | Column) -> DataFrame:
    """The first row of each group in an explicit order; a map-side minimum instead of a window."""
    keys = keys_of(by)
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return first.select(*keys, "__first.*").select(*df.columns)


def center_to_first(
    df: DataFrame, by: Sequence[str], order: str, tie: str, *, value: str = "value", number: str = "x", out: str = "delta"
) -> DataFrame:
    """Sequence number in the group and difference to the group's first value."""
    keys = keys_of(by)
    hashed = F.md5(F.col(tie).cast("string").cast("binary"))
    first = df.groupBy(*keys).agg(F.min_by(value, F.struct(F.col(order), hashed, F.col(tie))).alias("__base"))
    ranked = grouped_rank(df, keys, order, tie, rank=number, descending=False)
    return ranked.join(first, keys).withColumn(out, F.col(value) - F.col("__base")).drop("__base")


def with_level_order(df: DataFrame, column: str, levels: Sequence[str], out: str = "ord") -> DataFrame:
    """Number of the level in an explicit order; the first level is the reference level of a model."""
    pairs = [part for number, level in enumerate(levels, 1) for part in (F.lit(level), F.lit(number))]
    return df.withColumn(out, F.try_element_at(F.create_map(*pairs), F.col(column)).cast("long"))


def comparison_catalogue(
    spark: SparkSession, comparisons: Mapping[str, tuple[Sequence[str], Sequence[str]]]
) -> DataFrame:
    """{name: (conditions of side 1, conditions of side 2)} as rows (comparison, side, condition)."""
    rows = [
        (name, side, condition)
        for name, sides in comparisons.items()
        for side, conditions in enumerate(sides, 1)
        for condition in conditions
    ]
    columns = list(zip(*rows)) or [(), (), ()]
    types = {"comparison": pa.string(), "side": pa.int32(), "condition": pa.string()}
    # An Arrow table becomes a local relation: its size is known, so it is broadcast without a look at run time.
    return spark.createDataFrame(pa.table({n: pa.array(c, t) for (n, t), c in zip(types.items(), columns)}))


def checked_catalogue(catalogue: DataFrame, samples: DataFrame) -> DataFrame:
    """The same rows; reading them fails when a condition has no sample, so no arm is silently empty."""
    known = samples.select("condition").distinct().withColumn("__known", F.lit(True))
    return catalogue.join(known, "condition", "left").select(
        "comparison",
        "side",
        F.when(F.col("__known"), F.col("condition"))
        .otherwise(F.raise_error(F.concat(F.lit("no sample has condition "), F.col("condition"))))
        .alias("condition"),
    )


def comparison_samples(catalogue: DataFrame, samples: DataFrame) -> DataFrame:
    """(comparison, side, sample) of every comparison in one join."""
    return checked_catalogue(catalogue, samples).join(samples, "condition").select("comparison", "side", "sample")


def cohorts(
    visits: DataFrame, *, patient: str, treatment: str, order: str, sample: str, before: str, after: str, later: str,
    healthy: Column | None = None,
) -> DataFrame:
    """Label rows as healthy, pre-treatment, first treated, first treated with a later counterpart, or combination.

    Rows (cohort, patient, sample); one sample may be in several cohorts.
    """
    first_treated = first_per_group(visits.where(F.col(treatment) == after), patient, order, sample)
    with_later = visits.where(F.col(treatment) == later).select(patient).distinct()
    parts = {
        "pre": visits.where(F.col(treatment) == before),
        "first_treated": first_treated,
        "first_treated_with_later": first_treated.join(with_later, patient, "left_semi"),
        "later": first_per_group(visits.where(F.col(treatment) == later), patient, order, sample),
    }
    if healthy is not None:
        parts["healthy"] = visits.where(healthy)
    out = None
    for name, part in parts.items():
        rows = part.select(F.lit(name).alias("cohort"), patient, sample)
        out = rows if out is None else out.unionByName(rows)
    return out


def split_samples(
    visits: DataFrame, is_cell_line: Column, *, sample: str = "sample", name: str = "name", description: str = "description"
) -> dict[str, DataFrame]:
    """Two typed tables: patient samples with phase, cycle and day, and cell lines with line and replicate."""
    patients = visit_parts(F.col(description))
    lines = cell_line_parts(F.col(name))
    return {
        "patient": visits.where(~is_cell_line).select(sample, *[c.alias(n) for n, c in patients.items()]),
        "cell_line": visits.where(is_cell_line).select(sample, *[c.alias(n) for n, c in lines.items()]),
    }
