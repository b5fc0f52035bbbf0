"""Line dedup over whole documents, from DataFrame functions only.

Lines are exploded and normalised (white space at both ends off, A-Z lower), and travel as two 64-bit hashes with
their position. Documents are counted per hash; a line found in ``least_docs`` documents or more goes everywhere
but in the document with the largest key that holds it. The positions to drop come back as one list a document,
and the document is put together again from the positions that are left. Lines of fewer than ``least_chars`` code
points are never counted or dropped.

Texts move once, in the last join; before it only hashes do. Distinct (line, document) pairs are counted before
they meet by line, and lines that hold a thousandth of all lines or more are joined by broadcast (at most a
thousand), so a line of every document makes no large task.

Defined results: NULL and empty texts are one empty line; documents are told apart by their key, so repeated rows
and rows that share a key count as one document, and rows without a key together as one that is smaller than all
others; a line that one document repeats counts once for it and goes or stays with all its places there; an empty
table gives no rows; other columns are not read, so their names cannot clash. Rows that are equal in key and text
come out equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundix.llm.skew import HOT_SHARE, with_facts
from abundix.session import cut_lineage

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashes(*columns: Column | str) -> tuple[Column, Column]:
    """Two 64-bit hashes with seeds of their own; NULL is told from every value."""
    whole = [x for c in columns for x in (F.col(c) if isinstance(c, str) else c,)]
    marks = [c.isNull() for c in whole]
    return F.xxhash64(*whole, *marks), F.xxhash64(F.lit(1), *whole, *marks)


def deduplicated(df: DataFrame, *, key: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """Per row: the key, ``n_lines``, ``n_dropped`` and the ``kept`` text."""
    body = F.coalesce(F.col(text), F.lit(""))
    row1, row2 = hashes(F.col(key), body)
    docs = df.select(F.col(key).alias("__doc"), row1.alias("__row1"), row2.alias("__row2"), F.split(body, "\n", -1).alias("__lines"))

    trimmed = docs.select("__doc", "__row1", "__row2", F.posexplode("__lines").alias("__at", "__line"))
    trimmed = trimmed.withColumn("__line", F.btrim("__line", F.lit(WHITE))).where(F.char_length("__line") >= least_chars)
    key1, key2 = hashes(F.translate("__line", UPPER, LOWER))
    lines = trimmed.select("__doc", "__row1", "__row2", "__at", key1.alias("__key1"), key2.alias("__key2"))

    held = lines.groupBy("__key1", "__key2", "__doc").agg(F.count(F.lit(1)).alias("n"))
    counted = held.groupBy("__key1", "__key2").agg(
        F.count(F.lit(1)).alias("__docs"), F.max("__doc").alias("__keeper"), F.sum("n").alias("__weight")
    )
    # keys of few documents matter only where they hold so many lines that their rows have to be dealt apart
    facts = cut_lineage(counted.where((F.col("__docs") >= least_docs) | (F.col("__weight") >= HOT_SHARE)))
    met = with_facts(lines, facts, ["__key1", "__key2"], "__weight", F.hash("__row1", "__at"))
    goes = (F.col("__docs") >= least_docs) & ~F.col("__doc").eqNullSafe(F.col("__keeper"))
    gone = met.where(goes).groupBy("__row1", "__row2").agg(F.collect_set("__at").alias("__gone"))

    whole = docs.join(gone, ["__row1", "__row2"], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(F.transform(left, lambda at: F.get("__lines", at)))
    return whole.select(
        F.col("__doc").alias(key),
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept"),
    )
