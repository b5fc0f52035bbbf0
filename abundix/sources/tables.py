"""Readers and writers of measurement, metadata, sequence and result tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abundix.functions.numeric import missing_to_null, signif
from abundix.operators.filters import cast_text_numbers
from abundix.operators.reshape import to_long
from abundix.session import stage_path


def read_table(spark: SparkSession, path: str, list_columns: Sequence[str] = (), value: str | None = None) -> DataFrame:
    """Parquet table, of one written by ``replace_table`` its present rows; one-element lists become plain values, NaN becomes NULL."""
    df = spark.read.parquet(current_snapshot(path) or path)
    for name in list_columns:
        df = df.withColumn(name, F.try_element_at(F.col(name), F.lit(1)))
    return df.withColumn(value, missing_to_null(F.col(value))) if value else df


def read_crosstab(spark: SparkSession, path: str | Sequence[str], ids: Sequence[str], separator: str = "\t") -> DataFrame:
    """Wide delimited table: leading id columns as text, every other column as number.

    The header line alone decides the columns; a file of the same table with another header is an error (see
    ``read_datasets`` for those). Values are cast, so text such as ``NA`` turns NULL.
    """
    raw = spark.read.csv(path, sep=separator, header=True, inferSchema=False, quote="", enforceSchema=False)
    return cast_text_numbers(raw, [c for c in raw.columns if c not in set(ids)])


def read_text_numbers(
    spark: SparkSession, path: str, ids: Sequence[str], separator: str = ";", decimal: str = ","
) -> DataFrame:
    """Delimited table whose numbers are text with a decimal comma."""
    raw = spark.read.csv(path, sep=separator, header=True, inferSchema=False)
    return cast_text_numbers(raw, [c for c in raw.columns if c not in set(ids)], decimal)


def read_list(spark: SparkSession, path: str, column: str = "gene") -> DataFrame:
    """One value per line, no header."""
    return spark.read.text(path).select(F.trim("value").alias(column)).where(F.col(column) != "")


def read_metadata(spark: SparkSession, path: str, columns: Mapping[str, str], separator: str = ",") -> DataFrame:
    """Exported metadata sheet: chosen columns under new names, distinct rows."""
    raw = spark.read.csv(path, sep=separator, header=True, inferSchema=False)
    return raw.select(*[F.col(f"`{old}`").alias(new) for old, new in columns.items()]).distinct()


def read_study_design(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three design tables ``fractions.txt``, ``samples.txt`` and ``references.txt`` of a folder."""
    schemas = {
        "fractions": "Dataset string, PlexID string",
        "samples": "PlexID string, QuantBlock int, ReporterName string, ReporterAlias string, MeasurementName string",
        "references": "PlexID string, QuantBlock int, Reference string",
    }
    return {
        name: spark.read.csv(f"{folder.rstrip('/')}/{name}.txt", sep="\t", header=True, schema=schema, nullValue="NA")
        for name, schema in schemas.items()
    }


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Sequence records (header, accession, symbol, sequence), split between records so that files stay splittable."""
    raw = spark.read.text(path, lineSep="\n>")
    record = F.regexp_replace("value", "^>", "")
    header = F.split(record, "\n", 2)
    return raw.where(F.trim("value") != "").select(
        F.trim(header[0]).alias("header"),
        F.regexp_extract(header[0], r"\|([^|]+)\|", 1).alias("accession"),
        F.regexp_extract(header[0], r"GN=(\S+)", 1).alias("symbol"),
        F.regexp_replace(F.coalesce(F.get(header, F.lit(1)), F.lit("")), r"\s", "").alias("sequence"),
    )


def read_enrichment(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """Enrichment result file: set, description and the list of its members."""
    raw = spark.read.csv(path, sep=separator, header=True, inferSchema=False)
    return raw.select("geneSet", "description", F.split("userId", ";").alias("members"))


def read_datasets(
    spark: SparkSession, paths: Sequence[str], ids: Sequence[str], separator: str = "\t", *, sample: str = "sample", value: str = "value"
) -> DataFrame:
    """Crosstabs, each with a header of its own, as one long table (dataset, ids, sample, value).

    Every file or folder is read by its own header, so a value stays with its sample whatever columns the others
    have; ``dataset`` is the last part of the path without its ending. Cells without a value are dropped.
    """
    out = None
    for path in paths:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        name = name.rsplit(".", 1)[0] if "." in name[1:] else name
        part = to_long(read_crosstab(spark, path, ids, separator), ids, sample=sample, value=value)
        part = part.select(F.lit(name).alias("dataset"), *ids, sample, value)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no paths to read")
    return out


def write_new_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """New table of snapshots; anything that is there already is an error."""
    if exists(path):
        raise FileExistsError(path)
    replace_table(df, path, partition_by)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), *, keep: int = 2) -> None:
    """Replace all rows of a table, in one step for its readers; ``df`` may read the same table.

    Rows are written to a numbered snapshot in the table's folder. Only when it is complete a pointer with its name is put
    beside it, by one rename to a name that did not exist; the pointer with the highest number holds. So a reader
    finds the old or the new rows at any moment, and a job that fails anywhere before leaves the old ones. The last
    ``keep`` snapshots stay, so that who has opened one can read on; of two writers at once the higher name holds.
    """
    spots = pointers(path)
    version = spots[-1][0] + 1 if spots else 1
    mark = f"{version:012d}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path.rstrip('/')}/snapshot-{mark}")
    put_pointer(path, mark)
    system, place = located(path)
    for _, old in pointers(path)[: -max(1, keep)]:
        system.delete_file(f"{place}/_pointer-{old}")
        if exists(f"{path.rstrip('/')}/snapshot-{old}"):
            system.delete_dir(f"{place}/snapshot-{old}")


def put_pointer(path: str, mark: str) -> None:
    """Make the snapshot of this mark the present one. The pointer's name says all, so no reader sees half of it."""
    system, place = located(path)
    with system.open_output_stream(f"{place}/_new-{mark}") as out:
        out.write(mark.encode())
    system.move(f"{place}/_new-{mark}", f"{place}/_pointer-{mark}")


def pointers(path: str) -> list[tuple[int, str]]:
    """(version, mark) of the pointers of a table, ascending; none for a folder of plain files."""
    if not exists(path):
        return []
    system, place = located(path)
    names = [f.base_name for f in system.get_file_info(pafs.FileSelector(place))]
    marks = sorted(n.removeprefix("_pointer-") for n in names if n.startswith("_pointer-"))
    return [(int(m.split("-")[0]), m) for m in marks]


def current_snapshot(path: str) -> str | None:
    spots = pointers(path)
    return f"{path.rstrip('/')}/snapshot-{spots[-1][1]}" if spots else None


def write_named_table(df: DataFrame, name: str, *, replace: bool = False) -> None:
    """Table of the session's catalogue; an existing one is an error unless it is to be replaced."""
    df.write.mode("overwrite" if replace else "errorifexists").saveAsTable(name)


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":/" in path else f"file://{os.path.abspath(path)}")


def exists(path: str) -> bool:
    system, place = located(path)
    return system.get_file_info(place).type != pafs.FileType.NotFound


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with header, without quotes; missing as ``NA``."""
    df.write.mode("errorifexists").csv(path, sep="\t", header=True, quote="", nullValue="NA")


def export_datasets(
    df: DataFrame, path: str, *, dataset: str = "dataset", pattern: str = ".*", replacement: str | None = None, digits: int = 3
) -> None:
    """Datasets whose name matches, numbers at ``digits`` significant digits, one folder per dataset.

    With ``replacement`` what ``pattern`` matches of a name is replaced in the name of its folder.
    """
    numbers = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    chosen = df.where(F.col(dataset).rlike(pattern))
    if replacement is not None:
        chosen = chosen.withColumn(dataset, F.regexp_replace(dataset, pattern, replacement))
    for name in numbers:
        chosen = chosen.withColumn(name, signif(F.col(name), digits))
    chosen.write.mode("errorifexists").partitionBy(dataset).csv(path, sep="\t", header=True, nullValue="NA")


def staged(df: DataFrame, path: str | None = None, name: str = "stage") -> DataFrame:
    """Result of an expensive step kept as parquet: read it when it is there, else compute and write it."""
    spark = df.sparkSession
    target = path or stage_path(spark, name)
    if not exists(f"{target.rstrip('/')}/_SUCCESS"):
        df.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
