"""Measurement, design and set views over the given tables, once as DataFrames and once as SQL text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = [f"N{i}" for i in range(25)]
PLEXES = [0, 1, 2, 3, 4]


# Known schemas spare the job that would otherwise read file footers for each table.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _supplied(spark: SparkSession, d: str) -> DataFrame:
    suppliers = table(spark, d, "supplier").join(
        table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return table(spark, d, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))


def _text(prefix: str, column) -> F.Column:
    return F.concat(F.lit(prefix), column.cast("string"))


def meas(spark: SparkSession, d: str, parts_each: int = 1) -> DataFrame:
    """Long measurements (feature, sample, plex, value); cells may be missing or repeated."""
    part = F.col("l_partkey") if parts_each == 1 else F.floor(F.col("l_partkey") / parts_each)
    return _supplied(spark, d).select(
        _text("P", part).alias("feature"),
        _text("N", F.col("s_nationkey")).alias("sample"),
        F.col("n_regionkey").alias("plex"),
        F.log2("l_extendedprice").alias("value"),
    )


def meas_dense(spark: SparkSession, d: str) -> DataFrame:
    """The same rows with twenty parts to a feature, nearly every cell filled; features grow with the parts."""
    return meas(spark, d, 20)


def course(spark: SparkSession, d: str) -> DataFrame:
    day = F.dayofmonth("ts")
    return table(spark, d, "events").select(
        _text("U", F.col("user_id")).alias("feature"),
        F.col("event_type").alias("ligand"),
        day.cast("long").alias("day"),
        _text("D", day).alias("sample"),
        F.when(day <= 10, "PRE").when(day <= 20, "GILT").otherwise("GILT + DEC").alias("treatment"),
        F.log10("value").alias("value"),
    )


def visits(spark: SparkSession, d: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    return table(spark, d, "orders").select(
        _text("C", F.col("o_custkey")).alias("patient"),
        F.col("o_orderkey").alias("sample"),
        F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long").alias("visit_day"),
        F.when(priority == "1-URGENT", "PRE").when(priority == "2-HIGH", "GILT")
        .when(priority == "3-MEDIUM", "GILT + DEC").otherwise("OTHER").alias("treatment"),
        F.concat(
            F.lit("P"), (1 + F.col("o_custkey") % 2).cast("string"),
            F.lit(" Cycle "), F.month("o_orderdate").cast("string"),
            F.lit(" Day "), F.dayofmonth("o_orderdate").cast("string"),
        ).alias("description"),
        F.col("o_totalprice").alias("loading_mass"),
        F.when(priority.isin("1-URGENT", "2-HIGH", "3-MEDIUM"), _text("S", F.col("o_orderkey")))
        .otherwise(F.concat(_text("HS-", F.col("o_custkey") % 30), _text(" R", 1 + F.col("o_orderkey") % 3))).alias("name"),
    )


def term2gene(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    gene = _text("P", F.col("p_partkey")).alias("gene")
    kegg = part.select(_text("KEGG_", F.col("p_brand")).alias("term"), gene)
    reactome = part.select(
        F.concat(F.lit("REACTOME_"), "p_type", F.lit("_"), (F.col("p_size") % 10).cast("string")).alias("term"), gene
    )
    sizes = part.select(_text("GOMF_SIZE_", F.col("p_size")).alias("term"), gene)
    return kegg.unionByName(reactome).unionByName(sizes)


def _scan() -> F.Column:
    return F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


def _distinct(rows: DataFrame, dealt_by: Sequence[str]) -> DataFrame:
    """Distinct rows. Rows dealt by some of their columns are made distinct where they are, and stay dealt by these."""
    return (rows.repartition(*dealt_by) if dealt_by else rows).distinct()


def psm(spark: SparkSession, d: str, dealt_by: Sequence[str] = ()) -> DataFrame:
    part = F.col("l_partkey")
    rows = _supplied(spark, d).select(
        _text("EX_Plex", F.col("n_regionkey")).alias("dataset"),
        _scan().alias("scan"),
        F.when(part % 3 == 0, _text("PEP", F.floor(part / 10))).otherwise(_text("PEPU", part)).alias("peptide"),
        _text("P", part).alias("accession"),
        (part % 10 == 0).alias("is_decoy"),
        (F.col("l_extendedprice") * F.when(part % 10 == 0, 0.2).otherwise(1.0)).alias("score"),
    )
    return _distinct(rows, dealt_by)


def ions(spark: SparkSession, d: str, dealt_by: Sequence[str] = ()) -> DataFrame:
    rows = _supplied(spark, d).select(
        _text("EX_Plex", F.col("n_regionkey")).alias("dataset"),
        _scan().alias("scan"),
        _text("N", F.col("s_nationkey")).alias("channel"),
        F.col("n_regionkey").alias("plex"),
        F.col("l_extendedprice").alias("intensity"),
        (1.0 - F.col("l_discount") * 6).alias("interference"),
        (F.col("l_quantity") - 2).alias("s2n"),
    )
    return _distinct(rows, dealt_by)


def sites(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("l_linenumber")
    second = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("T"), (line + 10).cast("string"), F.lit("t"))).otherwise("")
    return table(spark, d, "lineitem").select(
        _text("P", F.col("l_partkey")).alias("gene"),
        F.concat(_text("P", F.col("l_partkey")), F.lit("-S"), line.cast("string"), F.lit("s"), second).alias("site"),
        F.concat(F.lit("K.PEP"), (F.col("l_suppkey") % 3).cast("string"), F.lit(".V")).alias("peptide"),
        _text("N", F.col("l_suppkey") % 20).alias("sample"),
        F.log2("l_extendedprice").alias("value"),
    )


def substrates(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    joined = parts.join(table(spark, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey"))
    return joined.select(
        F.col("p_brand").alias("kinase"),
        _text("P", F.col("p_partkey")).alias("sub_gene"),
        _text("S", F.col("l_linenumber")).alias("sub_mod_rsd"),
        _text("DB", F.col("p_size") % 2).alias("source"),
    ).distinct()


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Interaction graph with one edge per line: its part and the part at twenty times its supplier."""
    a, b = F.col("l_partkey"), F.col("l_suppkey") * 20 + F.col("l_linenumber")
    return table(spark, d, "lineitem").where(a != b).select(
        _text("P", F.least(a, b)).alias("a"), _text("P", F.greatest(a, b)).alias("b")
    ).distinct()


SQL = {
    "meas": """select concat('P', cast(l.l_partkey as varchar)) as feature,
        concat('N', cast(s.s_nationkey as varchar)) as sample, n.n_regionkey as plex, log2(l.l_extendedprice) as value
        from lineitem l join supplier s on l.l_suppkey = s.s_suppkey join nation n on s.s_nationkey = n.n_nationkey""",
    "meas_dense": """select concat('P', cast(l.l_partkey // 20 as varchar)) as feature,
        concat('N', cast(s.s_nationkey as varchar)) as sample, n.n_regionkey as plex, log2(l.l_extendedprice) as value
        from lineitem l join supplier s on l.l_suppkey = s.s_suppkey join nation n on s.s_nationkey = n.n_nationkey""",
    "course": """select concat('U', cast(user_id as varchar)) as feature, event_type as ligand, day(ts) as day,
        concat('D', cast(day(ts) as varchar)) as sample,
        case when day(ts) <= 10 then 'PRE' when day(ts) <= 20 then 'GILT' else 'GILT + DEC' end as treatment,
        log10(value) as value from events""",
    "visits": """select concat('C', cast(o_custkey as varchar)) as patient, o_orderkey as sample,
        date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as visit_day,
        case o_orderpriority when '1-URGENT' then 'PRE' when '2-HIGH' then 'GILT' when '3-MEDIUM' then 'GILT + DEC'
             else 'OTHER' end as treatment,
        concat('P', cast(1 + o_custkey % 2 as varchar), ' Cycle ', cast(month(o_orderdate) as varchar),
               ' Day ', cast(day(o_orderdate) as varchar)) as description,
        o_totalprice as loading_mass,
        case when o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM') then concat('S', cast(o_orderkey as varchar))
             else concat('HS-', cast(o_custkey % 30 as varchar), ' R', cast(1 + o_orderkey % 3 as varchar)) end as name from orders""",
    "term2gene": """select concat('KEGG_', p_brand) as term, concat('P', cast(p_partkey as varchar)) as gene from part
        union all select concat('REACTOME_', p_type, '_', cast(p_size % 10 as varchar)), concat('P', cast(p_partkey as varchar)) from part
        union all select concat('GOMF_SIZE_', cast(p_size as varchar)), concat('P', cast(p_partkey as varchar)) from part""",
    "psm": """select distinct concat('EX_Plex', cast(n.n_regionkey as varchar)) as dataset,
        concat_ws('-', cast(l.l_orderkey as varchar), cast(l.l_linenumber as varchar), cast(l.l_partkey as varchar), cast(l.l_suppkey as varchar)) as scan,
        case when l.l_partkey % 3 = 0 then concat('PEP', cast(l.l_partkey // 10 as varchar))
             else concat('PEPU', cast(l.l_partkey as varchar)) end as peptide,
        concat('P', cast(l.l_partkey as varchar)) as accession, (l.l_partkey % 10 = 0) as is_decoy,
        l.l_extendedprice * cast(case when l.l_partkey % 10 = 0 then 0.2 else 1.0 end as double) as score
        from lineitem l join supplier s on l.l_suppkey = s.s_suppkey join nation n on s.s_nationkey = n.n_nationkey""",
    "ions": """select distinct concat('EX_Plex', cast(n.n_regionkey as varchar)) as dataset,
        concat_ws('-', cast(l.l_orderkey as varchar), cast(l.l_linenumber as varchar), cast(l.l_partkey as varchar), cast(l.l_suppkey as varchar)) as scan,
        concat('N', cast(s.s_nationkey as varchar)) as channel, n.n_regionkey as plex,
        l.l_extendedprice as intensity, cast(1.0 as double) - l.l_discount * 6 as interference, l.l_quantity - 2 as s2n
        from lineitem l join supplier s on l.l_suppkey = s.s_suppkey join nation n on s.s_nationkey = n.n_nationkey""",
    "sites": """select concat('P', cast(l_partkey as varchar)) as gene,
        concat('P', cast(l_partkey as varchar), '-S', cast(l_linenumber as varchar), 's',
               case when l_returnflag = 'R' then concat('T', cast(l_linenumber + 10 as varchar), 't') else '' end) as site,
        concat('K.PEP', cast(l_suppkey % 3 as varchar), '.V') as peptide,
        concat('N', cast(l_suppkey % 20 as varchar)) as sample, log2(l_extendedprice) as value
        from lineitem""",
    "ks": """select distinct p_brand as kinase, concat('P', cast(p_partkey as varchar)) as sub_gene,
        concat('S', cast(l_linenumber as varchar)) as sub_mod_rsd,
        concat('DB', cast(p_size % 2 as varchar)) as source
        from part join lineitem on p_partkey = l_partkey""",
    "edges": """select distinct concat('P', cast(least(l_partkey, l_suppkey * 20 + l_linenumber) as varchar)) as a,
        concat('P', cast(greatest(l_partkey, l_suppkey * 20 + l_linenumber) as varchar)) as b
        from lineitem where l_partkey <> l_suppkey * 20 + l_linenumber""",
}


def with_views(query: str, *names: str, **extra: str) -> str:
    """``query`` preceded by the named views, then by further named sub-queries in the given order."""
    parts = [f"{name} as ({SQL[name]})" for name in names] + [f"{name} as ({text})" for name, text in extra.items()]
    return f"with {', '.join(parts)} {query}" if parts else query
