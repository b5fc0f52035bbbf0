"""From raw documents to shards: five stages, each over all that the one before has kept.

Quality rules, near copies, benchmark passages, mixing, sharding. Each stage takes (spark, docs, sf_dir) and its
result is written as Parquet and read again as the next stage's documents; all but the last keep the columns of
``documents``. Stages decide on rows, by an identity made of all columns, so that rows without a key and rows that
share one are judged like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from abundix.llm.hilbert import hilbert_shards
from abundix.llm.host_rules import kept_documents
from abundix.llm.jaccard_rtree import jaccard_components
from abundix.llm.mixing import Mix, cycled_weights, with_word_counts
from abundix.llm.spaced_seeds import contaminated
from abundix.session import cut_lineage, ship_package, stage_path

SHARDS = 16


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep: none that fails one clearly, and borderline ones only of hosts no worse than most.

    NULL and empty texts have too few words and go; a NULL source is a host of its own; rows that are equal or share a key
    are judged one by one; an empty table stays empty.
    """
    return kept_documents(docs)


def with_identity(docs: DataFrame) -> DataFrame:
    """Adds ``__id``: 128 bits of hash of all columns, and the key. Only rows that are equal in all columns share it.

    It is made of values alone, so that it is the same in every job, whatever the partitions or lost executors.
    """
    whole = [*[F.col(c) for c in docs.columns], *[F.col(c).isNull() for c in docs.columns]]
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(seed), *whole)), 16, "0") for seed in (1, 2)]
    key = F.col("doc_id").cast("string")
    return docs.withColumn("__id", F.concat(*halves, F.when(key.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), key))))


def key_of(row: Column, kind: DataType) -> Column:
    """The key (NULL without one) in an identity."""
    return F.when(F.substring(row, 33, 1) == "+", F.substr(row, F.lit(34))).cast(kind)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest key; five-word shingles, similarity 0.8 or more.

    A row without a key stays only where no linked row has one; of rows that are equal throughout one stays. NULL and
    empty texts are linked with nothing and stay; an empty table stays empty.
    """
    rows = with_identity(docs)
    groups = jaccard_components(rows.select("__id", "text"), key="__id", width=5, percent=80).select("__id", "component_id")
    groups = cut_lineage(groups)
    key = key_of(F.col("__id"), docs.schema["doc_id"].dataType)
    first = groups.groupBy("component_id").agg(F.min(F.struct(key.isNull(), key, F.col("__id").alias("__id"))).alias("first"))
    counted = groups.groupBy("__id").count()
    copies = counted.join(first.select("first.__id"), "__id", "left_anti").select("__id")
    kept = rows.join(cut_lineage(copies), "__id", "left_anti")
    if not counted.where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["__id"])
    return kept.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no benchmark passage.

    NULL and empty texts hold none and stay; equal rows stay or go together; an item without text finds nothing; with an
    empty benchmark all rows stay, and an empty table stays empty.
    """
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = with_identity(docs)
    found = contaminated(rows.select("__id", "text"), bench.select("item_id", "text"), key="__id")
    found = found.select(F.col("doc_id").alias("__id")).distinct()
    return rows.join(cut_lineage(found), "__id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as the mix deals them: sources weigh 3, 1, 2, repeating, and share 150 % of all words.

    A document comes once for each of its pieces. Rows lie by shard of the mix, in the order of its slots. NULL and empty
    texts have no words to take and go; a NULL source is a source of its own, the last; of rows equal throughout each
    is dealt for itself; ties of sources cannot occur; an empty table stays empty.
    """
    rows, pieces = with_identity(docs), cut_lineage(dealt(docs))
    if not pieces.groupBy("__id", "__epoch").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["__id"])  # rows equal throughout have pieces of their own, but one row serves them
    return in_order(rows.join(pieces, "__id")).select(*docs.columns)


def dealt(docs: DataFrame) -> DataFrame:
    """The pieces of the mix, each a whole document: its identity, epoch, shard and slot."""
    sizes = with_word_counts(with_identity(docs).select("__id", "source", "text"), "text", "size")
    pieces = Mix(sizes, cycled_weights, key="__id", whole_documents=True).pieces()
    return pieces.select("__id", *[F.col(c).alias(f"__{c}") for c in ("epoch", "shard", "slot")])


def in_order(drawn: DataFrame) -> DataFrame:
    """A shard of the mix has a bounded number of words, so it fits into a task."""
    parts = int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return drawn.repartition(parts, "__shard").sortWithinPartitions("__shard", "__slot")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of each document along the Hilbert curve: shard and slot, near equal bytes in each shard.

    A NULL text has size 1; NULL sources and languages have a cell of their own; ties on the curve go by key and the text's
    checksum, and equal rows get different slots; an empty table gives no rows.
    """
    text = F.col("text")
    sized = docs.select(
        "doc_id",
        "source",
        "lang",
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return hilbert_shards(sized, ["source", "lang", "size"], SHARDS, ties=["doc_id", "text_crc32"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

# The mix draws from a seeded generator and links need iteration: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        if i:
            path = stage_path(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        docs = stage(spark, docs, sf_dir)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
