"""Queries on sequence databases, identifications, reporter ratios and kinase activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from abundix.operators import design, identify, joins, quantify, reshape
from abundix.session import cut_lineage, stage_path
from abundix.sources import tables
from abundix.plans import views
from abundix.plans.registry import prefixed, query, r6, rounded
from abundix.plans.shaping import RESIDUES_SQL, site_residues
from abundix.plans.views import table, with_views

HEADERS_SQL = """select concat('sp|P', cast(p_partkey as varchar), '|', upper(replace(p_name, ' ', '_')), ' ', p_type,
    case when p_partkey % 5 <> 0 then concat(' GN=SYM', cast(p_partkey % 700 as varchar), ' PE=1') else ' PE=1' end) as header,
    upper(regexp_replace(p_name || p_type || p_brand, '[^A-Za-z]', '', 'g')) as sequence from part"""
MAP_SQL = """select distinct regexp_extract(header, '\\|([^|]+)\\|', 1) as accession, regexp_extract(header, 'GN=(\\S+)', 1) as symbol
    from headers where regexp_extract(header, 'GN=(\\S+)', 1) <> ''"""


def headers(spark, d):
    symbol = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit(" GN=SYM"), (F.col("p_partkey") % 700).cast("string"), F.lit(" PE=1")))
    return table(spark, d, "part").select(
        F.concat(
            F.lit("sp|P"), F.col("p_partkey").cast("string"), F.lit("|"), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))),
            F.lit(" "), "p_type", F.coalesce(symbol, F.lit(" PE=1")),
        ).alias("header"),
        prefixed("P", "p_partkey").alias("accession"),
        F.upper(F.regexp_replace(F.concat("p_name", "p_type", "p_brand"), "[^A-Za-z]", "")).alias("sequence"),
    )


@query("accession_map", with_views("select accession, symbol from mapping", headers=HEADERS_SQL, mapping=MAP_SQL))
def accession_map(spark, d):
    """From FASTA text, written and read back."""
    path = stage_path(spark, "fasta")
    headers(spark, d).select(F.concat(F.lit(">"), "header", F.lit("\n"), "sequence")).write.text(path)
    return identify.parse_fasta_headers(tables.read_fasta(spark, path))


@query(
    "fasta_by_gene",
    with_views(
        """select symbol, accession, sequence from (select symbol, accession, sequence, row_number() over (partition by symbol
             order by length(sequence) desc, accession) as rn from mapping join
             (select regexp_extract(header, '\\|([^|]+)\\|', 1) as accession, sequence from headers) using (accession)) where rn = 1""",
        headers=HEADERS_SQL, mapping=MAP_SQL,
    ),
)
def fasta_by_gene(spark, d):
    records = headers(spark, d)
    return identify.longest_per_symbol(records.select("accession", "sequence"), identify.parse_fasta_headers(records))


@query("fractions_dim", with_views("select distinct dataset, concat('Plex', regexp_extract(dataset, 'P(lex)?([0-9]+)', 2)) as plex_id from psm", "psm"))
def fractions_dim(spark, d):
    return design.dataset_fractions(views.psm(spark, d), "dataset")


@query(
    "remap_accession",
    with_views(
        "select dataset, scan, peptide, symbol from psm join mapping using (accession)", "psm", headers=HEADERS_SQL, mapping=MAP_SQL
    ),
)
def remap_accession(spark, d):
    mapping = identify.parse_fasta_headers(headers(spark, d))
    remapped = joins.remap_ids(views.psm(spark, d), mapping, "accession", "symbol")
    return remapped.select("dataset", "scan", "peptide", "symbol")


BEST_SQL = """select {level}, max(score) as score, arg_min(is_decoy, {{'s': -score, 'd': is_decoy}}) as is_decoy from {source} group by {level}"""
QMIN_SQL = "select *, min(rate) over (order by score range between unbounded preceding and current row) as q_value from ({inner})"


def _q(level: str, source: str) -> str:
    inner = """select *, case when targets > 0 then decoys / targets else 'inf'::double end as rate from (
        select *, sum(case when is_decoy then 1.0::double else 0 end) over w as decoys, sum(case when is_decoy then 0 else 1.0::double end) over w as targets
        from (%s) window w as (order by score desc range between unbounded preceding and current row))""" % BEST_SQL.format(level=level, source=source)
    return QMIN_SQL.format(inner=inner)


@query("target_decoy_fdr", with_views(f"select peptide, score, is_decoy, {r6('q_value')} as q_value from q", "psm", q=_q("peptide", "psm")))
def target_decoy_fdr(spark, d):
    best = identify.best_score(views.psm(spark, d), "peptide")
    return rounded(identify.target_decoy_q(best), "q_value")


@query(
    "fdr_filter",
    with_views(
        "select dataset, scan, peptide, accession, is_decoy from first where accession in (select accession from second where q_value <= 0.01)",
        "psm",
        q=_q("peptide", "psm"),
        first="select * from psm where peptide in (select peptide from q where q_value <= 0.01)",
        second=_q("accession", "first"),
    ),
)
def fdr_filter(spark, d):
    # both levels and both filters read the identifications: made once
    by_peptide = identify.filter_by_fdr(cut_lineage(views.psm(spark, d)), "peptide", 0.01)
    return identify.filter_by_fdr(by_peptide, "accession", 0.01).select("dataset", "scan", "peptide", "accession", "is_decoy")


@query(
    "unique_peptides",
    with_views("select distinct peptide, accession from psm where peptide in (select peptide from psm group by peptide having count(distinct accession) = 1)", "psm"),
)
def unique_peptides(spark, d):
    return identify.unique_peptides(views.psm(spark, d)).select("peptide", "accession").distinct()


@query(
    "prior_peptides",
    with_views(
        """select distinct peptide, accession from psm where accession in (select accession from prior)
           or peptide not in (select peptide from psm where accession in (select accession from prior))""",
        "psm",
        prior="select concat('P', cast(p_partkey as varchar)) as accession from part where p_size <= 25",
    ),
)
def prior_peptides(spark, d):
    prior = table(spark, d, "part").where("p_size <= 25").select(prefixed("P", "p_partkey").alias("accession"))
    return identify.prefer_prior(views.psm(spark, d), prior).select("peptide", "accession").distinct()


@query(
    "parsimony_greedy",
    # Groups of accessions that share peptides are known here, so the SQL takes one accession per group and step.
    """with recursive pairs as (select distinct case when l_partkey % 3 = 0 then concat('G', cast(l_partkey // 10 as varchar)) else concat('U', cast(l_partkey as varchar)) end as grp,
         concat('PEP', cast(case when l_partkey % 3 = 0 then l_partkey // 10 else l_partkey end as varchar), case when l_partkey % 3 = 0 then 'S' else 'U' end,
           cast(l_linenumber as varchar)) as peptide, concat('P', cast(l_partkey as varchar)) as accession from lineitem),
       walk(grp, peptide, accession, taken) as (
         select grp, peptide, accession, null::varchar from pairs
         union all
         select l.grp, l.peptide, l.accession, case when c.peptide is not null then b.accession end
         from (select grp, peptide, accession from walk where taken is null) l
         join (select grp, accession from (select grp, accession, row_number() over (partition by grp order by count(*) desc, accession) as rn
               from walk where taken is null group by grp, accession) where rn = 1) b on b.grp = l.grp
         left join (select grp, peptide, accession from walk where taken is null) c on c.grp = l.grp and c.peptide = l.peptide and c.accession = b.accession)
       select distinct peptide, taken as accession from walk where taken is not null""",
)
def parsimony_greedy(spark, d):
    """Every accession has several peptides; a third of the accessions share theirs with others."""
    part = F.col("l_partkey")
    stem = F.when(part % 3 == 0, F.floor(part / 10)).otherwise(part).cast("string")
    pairs = table(spark, d, "lineitem").select(
        F.concat(F.lit("PEP"), stem, F.when(part % 3 == 0, "S").otherwise("U"), F.col("l_linenumber").cast("string")).alias("peptide"),
        prefixed("P", "l_partkey").alias("accession"),
    )
    return identify.parsimonious_accessions(pairs)


@query(
    "peptides_per_1000aa",
    with_views(
        f"""select accession, count(distinct peptide) as n_peptides, length(sequence) as n_residues,
            {r6('count(distinct peptide) * 1000.0::double / length(sequence)')} as per_1000
            from psm join (select concat('P', cast(p_partkey as varchar)) as accession, sequence from (
              select p_partkey, upper(regexp_replace(p_name || p_type || p_brand, '[^A-Za-z]', '', 'g')) as sequence from part)) using (accession)
            group by accession, sequence""",
        "psm",
    ),
)
def peptides_per_1000aa(spark, d):
    counted = identify.peptides_per_1000(views.psm(spark, d), headers(spark, d))
    return rounded(counted.withColumn("n_residues", F.col("n_residues").cast("long")), "per_1000")


DESIGN_SQL = """select concat('Plex', cast(n_regionkey as varchar)) as plex_id, concat('N', cast(n_nationkey as varchar)) as channel,
    concat('S', cast(n_nationkey as varchar)) as measurement from nation"""
REFERENCES_SQL = """select concat('Plex', cast(n_regionkey as varchar)) as plex_id, concat('N', cast(min(n_nationkey) as varchar)) as reference
    from nation group by n_regionkey"""


def study_design(spark, d):
    nation = table(spark, d, "nation")
    channels = nation.select(
        prefixed("Plex", "n_regionkey").alias("plex_id"), prefixed("N", "n_nationkey").alias("channel"),
        prefixed("S", "n_nationkey").alias("measurement"),
    )
    lowest = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("k"))
    references = lowest.select(prefixed("Plex", "n_regionkey").alias("plex_id"), prefixed("N", "k").alias("reference"))
    return channels, references


def _ratio_sql(keys: str) -> str:
    return with_views(
        f"""select {', '.join('s.' + k for k in keys.split(', '))}, s.measurement as sample, {r6('log2(s.total / b.total)')} as log_ratio from sums s
            join refs r using (plex_id) left join (select * from sums join refs using (plex_id) where channel = reference and total > 0) b
            on s.plex_id = b.plex_id and {' and '.join(f's.{k} = b.{k}' for k in keys.split(', '))} where s.channel <> r.reference""",
        "psm", "ions",
        design=DESIGN_SQL,
        refs=REFERENCES_SQL,
        sums=f"""select {keys}, plex_id, channel, measurement, sum(intensity) as total from psm join ions using (dataset, scan)
                 join (select distinct dataset, replace(dataset, 'EX_', '') as plex_id from psm) using (dataset)
                 join design using (plex_id, channel) group by all""",
    )


def ratios(spark, d, keys):
    # both sides meet by (dataset, scan): dealt by these before they are made distinct, they join without moving again
    psm, ions = (view(spark, d, dealt_by=("dataset", "scan")) for view in (views.psm, views.ions))
    channels, references = study_design(spark, d)
    fractions = design.dataset_fractions(table(spark, d, "nation").select(prefixed("EX_Plex", "n_regionkey").alias("dataset")), "dataset")
    linked = quantify.link_quantities(psm.select("dataset", "scan", *keys), ions.select("dataset", "scan", "channel", "intensity"), fractions, channels)
    return rounded(quantify.reporter_ratios(linked, references, keys), "log_ratio")


@query("crosstab_ratio", _ratio_sql("accession"))
def crosstab_ratio(spark, d):
    return ratios(spark, d, ["accession"])


@query("crosstab_ratio_peptide", _ratio_sql("accession, peptide"))
def crosstab_ratio_peptide(spark, d):
    return ratios(spark, d, ["accession", "peptide"])


@query(
    "best_site_per_spectrum",
    """select spectrum, site, score from (select i.l_orderkey as spectrum, concat('S', cast(i.l_partkey as varchar)) as site, s.l_quantity as score,
         row_number() over (partition by i.l_orderkey order by s.l_quantity desc, concat('S', cast(i.l_partkey as varchar))) as rn
         from lineitem i join lineitem s on i.l_orderkey = s.l_orderkey and i.l_linenumber = s.l_linenumber where s.l_returnflag <> 'A') where rn = 1""",
)
def best_site_per_spectrum(spark, d):
    """Candidate sites of each spectrum, and a table of localisation scores that not every candidate is in."""
    lines = table(spark, d, "lineitem")
    keys = [F.col("l_orderkey").alias("spectrum"), F.col("l_linenumber").alias("candidate")]
    candidates = lines.select(*keys, prefixed("S", "l_partkey").alias("site"))
    scores = lines.where("l_returnflag <> 'A'").select(*keys, F.col("l_quantity").alias("score"))
    return identify.best_localisation(candidates, scores, ["spectrum"], ["candidate"], "score", "site")


@query(
    "map_mod_sites",
    """select gene, peptide, concat(gene, '-', r1, cast(spot + 3 as varchar), lower(r1), r2, cast(spot + 6 as varchar), lower(r2)) as site_id from (
         select *, instr(sequence, bare) as spot, substr(bare, 4, 1) as r1, substr(bare, 7, 1) as r2 from (
           select gene, sequence, substr(sequence, start, 9) as bare, concat('K.', substr(sequence, start, 4), '*', substr(sequence, start + 4, 3), '*',
             substr(sequence, start + 7, 2), '.R') as peptide from (
             select gene, sequence, 1 + (doc_id * 7) % (length(sequence) - 12) as start from (
               select doc_id, concat('D', cast(doc_id as varchar)) as gene, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as sequence from documents)
             where length(sequence) > 12)))""",
)
def map_mod_sites(spark, d):
    """Peptides cut from whole document texts, with two marked residues each, found again in the texts.

    The pattern of stars differs from the SQL only in that the operator takes any number of them.
    """
    text_letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    sequences = table(spark, d, "documents").select("doc_id", prefixed("D", "doc_id").alias("gene"), text_letters.alias("sequence"))
    long_enough = sequences.where(F.length("sequence") > 12).withColumn(
        "start", (1 + (F.col("doc_id") * 7) % (F.length("sequence") - 12)).cast("int")
    )

    def piece(offset: int, size: int):
        return F.substr(F.col("sequence"), F.col("start") + offset, F.lit(size))

    peptides = long_enough.select(
        "gene", F.concat(F.lit("K."), piece(0, 4), F.lit("*"), piece(4, 3), F.lit("*"), piece(7, 2), F.lit(".R")).alias("peptide")
    )
    return identify.map_modified_sites(peptides, sequences)


@query(
    "kinase_activity",
    with_views(
        f"""select kinase, sample, {r6('avg(value)')} as mean_lfc, {r6('avg(score)')} as mean_score, count(*) as n_substrates
            from (select gene, r as residue, sample, avg(value) as value from sites join singles using (gene, site) group by all) v
            join (select kinase, sub_gene as gene, sub_mod_rsd as residue, cast(substr(sub_mod_rsd, 2) as double) / 2 as score from ks) k
            using (gene, residue) group by kinase, sample""",
        "sites", "ks",
        residues=RESIDUES_SQL,
        singles="select gene, site, unnest(string_split(residue, ';')) as r from residues",
    ),
)
def kinase_activity(spark, d):
    return rounded(activity(spark, d), "mean_lfc", "mean_score")


def activity(spark, d):
    single = reshape.explode_tokens(site_residues(views.sites(spark, d)), "residue")
    single = single.groupBy("gene", "residue", "sample").agg(F.avg("value").alias("value"))
    table_ks = views.substrates(spark, d).select(
        "kinase", F.col("sub_gene").alias("gene"), F.col("sub_mod_rsd").alias("residue"),
        (F.substr("sub_mod_rsd", F.lit(2)).cast("double") / 2).alias("score"),
    )
    return quantify.kinase_activity(single, table_ks)
