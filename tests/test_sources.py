"""Readers and writers on small files."""

import pytest
from pyspark.sql import functions as F

from abundix.sources import tables


def write(path, text):
    path.write_text(text)
    return str(path)


def test_crosstabs(spark, tmp_path):
    one = write(tmp_path / "crosstab_global_corrected.txt", "Gene\tUniprot\t01\t02\nA\tP1\t1.5\tNA\nB\tP2\t2\t3\n")
    two = write(tmp_path / "crosstab_global_original.txt", "Gene\tUniprot\t02\t03\nA\tP1\t9\t8\n")
    df = tables.read_crosstab(spark, one, ["Gene", "Uniprot"])
    assert [tuple(r) for r in df.orderBy("Gene").collect()] == [("A", "P1", 1.5, None), ("B", "P2", 2.0, 3.0)]
    both = tables.read_datasets(spark, [one, two], ["Gene", "Uniprot"])
    assert sorted(tuple(r)[0:2] + tuple(r)[3:] for r in both.collect()) == [
        ("crosstab_global_corrected", "A", "01", 1.5), ("crosstab_global_corrected", "B", "01", 2.0),
        ("crosstab_global_corrected", "B", "02", 3.0), ("crosstab_global_original", "A", "02", 9.0),
        ("crosstab_global_original", "A", "03", 8.0),
    ]
    with pytest.raises(Exception):
        tables.read_crosstab(spark, [one, two], ["Gene", "Uniprot"]).collect()
    tables.export_datasets(both, str(tmp_path / "out"), pattern="_corrected$", replacement="_final")
    back = spark.read.csv(str(tmp_path / "out"), sep="\t", header=True)
    assert {r["dataset"] for r in back.collect()} == {"crosstab_global_final"}


def test_text_numbers_lists_metadata(spark, tmp_path):
    numbers = write(tmp_path / "t.csv", "T: Category;s1;pool\nG;1,25;x\n")
    assert tuple(tables.read_text_numbers(spark, numbers, ["T: Category"]).first()) == ("G", 1.25, None)
    genes = write(tmp_path / "genes.txt", "FLT3\nNRAS \n\n")
    assert sorted(r["gene"] for r in tables.read_list(spark, genes).collect()) == ["FLT3", "NRAS"]
    sheet = write(tmp_path / "m.csv", "Sample ID,Tx Status,x\n1,PRE,a\n1,PRE,b\n")
    assert [tuple(r) for r in tables.read_metadata(spark, sheet, {"Sample ID": "sample", "Tx Status": "treatment"}).collect()] == [("1", "PRE")]


def test_design_fasta_enrichment(spark, tmp_path):
    write(tmp_path / "fractions.txt", "Dataset\tPlexID\nD1\tPlex1\n")
    write(tmp_path / "samples.txt", "PlexID\tQuantBlock\tReporterName\tReporterAlias\tMeasurementName\nPlex1\t1\t126\tref\tNA\n")
    write(tmp_path / "references.txt", "PlexID\tQuantBlock\tReference\nPlex1\t1\tref\n")
    design = tables.read_study_design(spark, str(tmp_path))
    assert design["samples"].first()["MeasurementName"] is None and design["samples"].first()["QuantBlock"] == 1
    fasta = write(tmp_path / "db.fasta", ">sp|P1|A_HUMAN name OS=x GN=AAA PE=1\nMKV\nLL\n>sp|P2|B_HUMAN no symbol\nMM\n")
    assert sorted(tuple(r) for r in tables.read_fasta(spark, fasta).select("accession", "symbol", "sequence").collect()) == [("P1", "AAA", "MKVLL"), ("P2", "", "MM")]
    result = write(tmp_path / "e.txt", "geneSet\tdescription\tsize\tuserId\nGO:1\tcell cycle\t2\tA;B\n")
    assert tables.read_enrichment(spark, result).first()["members"] == ["A", "B"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", ["G"], float("nan")), ("b", ["H"], 1.0)], "i string, gene array<string>, value double")
    path = str(tmp_path / "table")
    tables.write_new_table(df, path)
    with pytest.raises(Exception):
        tables.write_new_table(df, path)
    tables.replace_table(df.where("i = 'a'").unionByName(df), path)
    again = tables.read_table(spark, path)
    tables.replace_table(again, path)
    with pytest.raises(Exception):
        tables.replace_table(again.withColumn("bad", F.raise_error(F.lit("no"))), path)
    tables.write_named_table(df, "kept_by_name", replace=True)
    assert spark.table("kept_by_name").count() == 2
    spark.sql("drop table kept_by_name")
    back = tables.read_table(spark, path, list_columns=["gene"], value="value")
    assert sorted((r["i"], r["gene"], r["value"] is None) for r in back.collect()) == [("a", "G", True), ("a", "G", True), ("b", "H", False)]


def test_replace_is_one_step_for_readers(spark, tmp_path, monkeypatch):
    """At every step of a replacement, and after a failure at any of them, a reader finds all old or all new rows."""
    path = str(tmp_path / "table")
    rows = lambda first: spark.range(first, first + 100, 1, 4)
    read = lambda: sorted(r["id"] for r in tables.read_table(spark, path).collect())
    tables.write_new_table(rows(0), path)
    seen = []
    put = tables.put_pointer

    def watched(p, mark):
        seen.append(read())
        put(p, mark)
        seen.append(read())

    monkeypatch.setattr(tables, "put_pointer", watched)
    tables.replace_table(rows(1000), path)
    assert seen == [list(range(100)), list(range(1000, 1100))] and read() == list(range(1000, 1100))

    def broken(p, mark):
        raise OSError("lost before the pointer")

    monkeypatch.setattr(tables, "put_pointer", broken)
    with pytest.raises(OSError):
        tables.replace_table(rows(5000), path)
    assert read() == list(range(1000, 1100))
    monkeypatch.setattr(tables, "put_pointer", put)
    # a reader that has opened the table before finishes after it was replaced
    opened = tables.read_table(spark, path)
    tables.replace_table(rows(2000), path)
    assert sorted(r["id"] for r in opened.collect()) == list(range(1000, 1100)) and read() == list(range(2000, 2100))
    for turn in range(3):
        tables.replace_table(rows(turn), path)
    assert len(tables.pointers(path)) == 2 and read() == list(range(2, 102))


def test_stage_is_written_once(spark, tmp_path):
    path = str(tmp_path / "stage")
    first = tables.staged(spark.range(3), path)
    second = tables.staged(spark.range(99).where(F.raise_error(F.lit("must not run")).isNull()), path)
    assert first.count() == second.count() == 3
