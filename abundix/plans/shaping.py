"""Queries on scans, filters, joins, reshaping, aggregates, order, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from abundix.functions import text
from abundix.functions.numeric import signif
from abundix.operators import aggregate, design, filters, joins, reshape
from abundix.plans import views
from abundix.plans.registry import prefixed, query, r6, rounded
from abundix.plans.views import SAMPLES, table, with_views
from abundix.sources import tables
from abundix.session import stage_path

CELLS_SQL = "select feature, sample, plex, avg(value) as value from meas group by all"
DENSE_CELLS_SQL = "select feature, sample, plex, avg(value) as value from meas_dense group by all"
TARGETED_SQL = "select distinct concat('P', cast(p_partkey * 2 as varchar)) as feature from part where p_size <= 10"


def cells(df):
    return aggregate.collapse_duplicates(df, ["feature", "sample", "plex"])


def targeted(spark, d):
    part = table(spark, d, "part").where("p_size <= 10")
    return part.select(F.concat(F.lit("P"), (F.col("p_partkey") * 2).cast("string")).alias("feature")).distinct()


def nations(spark, d):
    """Sample metadata (sample, plex, cell_line)."""
    named = table(spark, d, "nation").withColumn("name", prefixed("N", "n_nationkey"))
    return design.sample_metadata(named, {"name": "sample", "n_regionkey": "plex", "n_name": "cell_line"})


# --- sources and projections -----------------------------------------------------------------------------


@query(
    "cast_numeric",
    "select p_partkey as id, try_cast(replace(case when p_partkey % 7 = 0 then 'NA' "
    "else replace(cast(p_retailprice as varchar), '.', ',') end, ',', '.') as double) as value from part",
)
def cast_numeric(spark, d):
    written = F.when(F.col("p_partkey") % 7 == 0, "NA").otherwise(
        F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(","))
    )
    raw = table(spark, d, "part").select(F.col("p_partkey").alias("id"), written.alias("value"))
    return filters.cast_text_numbers(raw, ["value"], decimal=",")


@query(
    "sample_dim",
    "select distinct concat('N', cast(s_nationkey as varchar)) as sample, n_name as cell_line, n_regionkey as plex "
    "from supplier join nation on s_nationkey = n_nationkey",
)
def sample_dim(spark, d):
    sheet = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    sheet = sheet.withColumn("Sample description", prefixed("N", "s_nationkey"))
    return design.sample_metadata(
        sheet, {"Sample description": "sample", "n_name": "cell_line", "n_regionkey": "plex"}
    )


@query(
    "project_rename",
    with_views(
        f"select feature as gene, feature as feature_id, sample, {r6('value')} as log_ratio, 'global' as dataset from meas",
        "meas",
    ),
)
def project_rename(spark, d):
    renamed = views.meas(spark, d).select(F.col("feature").alias("gene"), "sample", "plex", F.col("value").alias("log_ratio"))
    return rounded(renamed.drop("plex").withColumn("feature_id", F.col("gene")).withColumn("dataset", F.lit("global")), "log_ratio")


@query(
    "filter_missing",
    "select l_orderkey, l_partkey, l_linenumber, " + r6("log2(l_extendedprice)") + " as value from lineitem "
    "where l_discount <> 0 and l_tax <> 0",
)
def filter_missing(spark, d):
    value = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).when(F.col("l_tax") != 0, F.log2("l_extendedprice"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", value.alias("value"))
    return rounded(filters.drop_missing(rows), "value")


@query(
    "filter_group",
    with_views(
        f"select feature, sample, {r6('value')} as value from meas where plex = 1 and sample <> 'N1' and value > 13", "meas"
    ),
)
def filter_group(spark, d):
    rows = views.meas(spark, d).where((F.col("plex") == 1) & (F.col("sample") != "N1") & (F.col("value") > 13))
    return rounded(rows.select("feature", "sample", "value"), "value")


@query("targeted_present", with_views("select feature from targeted where feature in (select feature from meas)", "meas", targeted=TARGETED_SQL))
def targeted_present(spark, d):
    return filters.keep_listed(targeted(spark, d), views.meas(spark, d), "feature")


@query("targeted_absent", with_views("select feature from targeted where feature not in (select feature from meas)", "meas", targeted=TARGETED_SQL))
def targeted_absent(spark, d):
    return filters.keep_listed(targeted(spark, d), views.meas(spark, d), "feature", negate=True)


@query("filter_regex", with_views("select term, gene from term2gene where regexp_matches(term, '^(KEGG|REACTOME)_.*[0-5]$')", "term2gene"))
def filter_regex(spark, d):
    return filters.keep_matching(views.term2gene(spark, d), "term", "^(KEGG|REACTOME)_.*[0-5]$")


@query(
    "ion_quality_filter",
    with_views(
        f"select dataset, scan, channel, intensity, {r6('interference')} as interference, s2n from ions where interference >= 0.5 and s2n >= 0",
        "ions",
    ),
)
def ion_quality_filter(spark, d):
    kept = filters.ion_quality(views.ions(spark, d))
    return rounded(kept.select("dataset", "scan", "channel", "intensity", "interference", "s2n"), "interference")


@query(
    "drop_decoys",
    with_views("select dataset, scan, peptide, accession from psm where not is_decoy and peptide like '%U%'", "psm"),
)
def drop_decoys(spark, d):
    kept = filters.keep_modified(filters.drop_decoys(views.psm(spark, d)), mark="U")
    return kept.select("dataset", "scan", "peptide", "accession")


@query(
    "filter_proportion_present",
    with_views(
        f"""select feature, sample, {r6('value')} as value from cells where feature in (
          select feature from cells group by feature having count(value) >= 0.5 * (select count(distinct sample) from cells))""",
        "meas",
        cells=CELLS_SQL,
    ),
)
def filter_proportion_present(spark, d):
    kept = filters.present_in_share(cells(views.meas(spark, d)), 0.5)
    return rounded(kept.select("feature", "sample", "value"), "value")


@query(
    "filter_per_batch",
    with_views(
        f"""select feature, sample, {r6('value')} as value from cells where feature in (
          select feature from cells group by feature having count(distinct plex) = (select count(distinct plex) from cells))""",
        "meas",
        cells=CELLS_SQL,
    ),
)
def filter_per_batch(spark, d):
    kept = filters.present_in_every_batch(cells(views.meas(spark, d)), "plex")
    return rounded(kept.select("feature", "sample", "value"), "value")


@query(
    "recode_groups",
    with_views(
        """select sample, case when treatment = 'PRE' then 'control' when treatment = 'GILT' and loading_mass > 200000 then 'heavy'
           when treatment = 'GILT' then 'light' end as grp,
           case when loading_mass > 300000 then 'high' else 'usual' end as load from visits""",
        "visits",
    ),
)
def recode_groups(spark, d):
    treatment, mass = F.col("treatment"), F.col("loading_mass")
    return views.visits(spark, d).select(
        "sample",
        filters.recode(
            [(treatment == "PRE", "control"), ((treatment == "GILT") & (mass > 200000), "heavy"), (treatment == "GILT", "light")]
        ).alias("grp"),
        filters.recode([(mass > 300000, "high")], "usual").alias("load"),
    )


@query(
    "top20_split",
    """select o_orderkey, o_totalprice, place, case when place % 2 = 1 then 'odd' else 'even' end as half from (
       select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) as place from orders)
       where place <= 20""",
)
def top20_split(spark, d):
    top = filters.top_rows(
        table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 20, F.col("o_totalprice").desc(), F.col("o_orderkey")
    )
    # Twenty rows are left, so numbering them is bounded work.
    numbered = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))).alias("rows"))
    out = numbered.select(F.posexplode("rows").alias("pos", "row"))
    place = (F.col("pos") + 1).cast("long")
    return out.select(
        "row.o_orderkey", (-F.col("row.p")).alias("o_totalprice"), place.alias("place"),
        F.when(place % 2 == 1, "odd").otherwise("even").alias("half"),
    )


# --- joins -----------------------------------------------------------------------------------------------


@query(
    "long_with_metadata",
    with_views(
        f"""select m.feature, m.sample, {r6('m.value')} as value, k.n_name as cell_line from meas m
            left join (select * from nation where n_regionkey < 4) k on m.sample = concat('N', cast(k.n_nationkey as varchar))""",
        "meas",
    ),
)
def long_with_metadata(spark, d):
    known = nations(spark, d).where("plex < 4").select(F.col("sample").alias("sample_id"), "cell_line")
    joined = joins.with_metadata(views.meas(spark, d).drop("plex"), known, "sample", "sample_id")
    return rounded(joined, "value")


@query(
    "join_cast_key",
    "select s_suppkey, cast(s_nationkey as bigint) as sample, n_name as cell_line from supplier left join nation on s_nationkey = n_nationkey and n_nationkey < 20",
)
def join_cast_key(spark, d):
    fact = table(spark, d, "supplier").select("s_suppkey", F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("sample"))
    dim = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("cell_line"))
    return joins.join_on_number(fact, dim, "sample", "id")


@query(
    "site_fanout",
    with_views(
        """select f.gene, f.site, p.peptide from (select distinct gene, site from sites) f
           left join (select distinct site, peptide from sites where peptide <> 'K.PEP2.V') p on f.site = p.site""",
        "sites",
    ),
)
def site_fanout(spark, d):
    sites = views.sites(spark, d)
    peptides = sites.where(F.col("peptide") != "K.PEP2.V").select("site", "peptide").distinct()
    return joins.with_metadata(sites.select("gene", "site").distinct(), peptides, "site")


@query(
    "inner_merge",
    with_views(
        f"""select c.feature, c.sample, c.plex, {r6('c.value')} as value, n_name as cell_line from cells c
            join nation on c.sample = concat('N', cast(n_nationkey as varchar)) and c.plex = n_regionkey""",
        "meas",
        cells=CELLS_SQL,
    ),
)
def inner_merge(spark, d):
    return rounded(joins.merge_shared(cells(views.meas(spark, d)), nations(spark, d)), "value")


ALIGN_IDS = ["R0", "R1", "R2", "R3", "R4"]


@query(
    "align_by_key",
    with_views(
        "select feature, "
        + ", ".join(f"{r6(f'avg(case when plex = {i} then value end)')} as R{i}" for i in range(5))
        + " from meas group by feature having count(case when plex = 0 then 1 end) > 0",
        "meas",
    ),
)
def align_by_key(spark, d):
    results = views.meas(spark, d).withColumn("arm", prefixed("R", "plex"))
    return rounded(joins.align_results(results, "feature", "arm", "value", ALIGN_IDS), *ALIGN_IDS)


@query(
    "baseline_replicate",
    with_views(
        f"""select feature, day, {r6('value')} as value, arm from (
              select feature, day, value, unnest(['DMSO', 'GILT']) as arm from course where day = 1
              union all
              select feature, day, value, case when ligand in ('click', 'view') then 'DMSO' else 'GILT' end from course where day <> 1)""",
        "course",
    ),
)
def baseline_replicate(spark, d):
    rows = views.course(spark, d).select(
        "feature", "day", "value", F.when(F.col("ligand").isin("click", "view"), "DMSO").otherwise("GILT").alias("arm")
    )
    return rounded(joins.replicate_baseline(rows, F.col("day") == 1, "arm", ["DMSO", "GILT"]), "value")


# --- reshape ---------------------------------------------------------------------------------------------


@query("crosstab_to_long", with_views(f"select feature, sample, {r6('value')} as value from cells", "meas", cells=CELLS_SQL))
def crosstab_to_long(spark, d):
    crosstab = reshape.to_wide(views.meas(spark, d), SAMPLES)
    return rounded(reshape.to_long(crosstab, ["feature"]), "value")


def _wide_sql(source: str, cell: str) -> str:
    columns = ", ".join(f"{cell.format(v=f'avg(case when sample = {chr(39)}{s}{chr(39)} then value end)')} as {s}" for s in SAMPLES)
    return f"select feature, {columns} from {source} group by feature"


@query("long_to_wide_fill0", with_views(_wide_sql("meas", "round(coalesce({v}, 0), 6) + 0.0::double"), "meas"))
def long_to_wide_fill0(spark, d):
    return rounded(reshape.to_wide(views.meas(spark, d), SAMPLES, fill=0.0), *SAMPLES)


@query("long_to_wide_mean", with_views(_wide_sql("meas", "round({v}, 6) + 0.0::double"), "meas"))
def long_to_wide_mean(spark, d):
    return rounded(reshape.to_wide(views.meas(spark, d), SAMPLES), *SAMPLES)


@query(
    "wide_distinct_mean",
    with_views(
        _wide_sql("once", "round({v}, 6) + 0.0::double"), "meas_dense",
        once="select distinct feature, sample, round(value, 1) as value from meas_dense",
    ),
)
def wide_distinct_mean(spark, d):
    coarse = views.meas_dense(spark, d).withColumn("value", F.round("value", 1))
    return rounded(reshape.to_wide(coarse, SAMPLES, distinct=True), *SAMPLES)


@query(
    "pool_log_ratio",
    with_views(
        f"""select c.feature, c.plex, c.sample, {r6('log10(c.price) - log10(p.pool)')} as log_ratio from priced c left join
            (select feature, plex, max(price) as pool from priced join pools using (sample) group by all) p
            on c.feature = p.feature and c.plex = p.plex where c.sample not in (select sample from pools)""",
        "meas",
        priced="select feature, plex, sample, avg(power(2, value)) as price from meas group by all",
        pools="select concat('N', cast(min(n_nationkey) as varchar)) as sample from nation group by n_regionkey",
    ),
)
def pool_log_ratio(spark, d):
    pools = table(spark, d, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("k"))
    pools = pools.select(prefixed("N", "k").alias("sample"), F.lit(True).alias("is_pool"))
    priced = views.meas(spark, d).groupBy("feature", "plex", "sample").agg(F.avg(F.pow(F.lit(2.0), "value")).alias("price"))
    marked = priced.join(pools, "sample", "left").withColumn("is_pool", F.coalesce("is_pool", F.lit(False)))
    ratios = reshape.pool_log_ratio(marked, F.col("is_pool"), group=["feature", "plex"], value="price")
    return rounded(ratios.select("feature", "plex", "sample", "log_ratio"), "log_ratio")


RESIDUES_SQL = """select distinct gene, site, regexp_replace(regexp_replace(regexp_replace(
    substr(site, length(gene) + 2), '([STY])', ';\\1', 'g'), '^;+', ''), '[sty]', '', 'g') as residue from sites"""


def site_residues(sites):
    return sites.withColumn("residue", text.site_residues(F.col("site"), F.col("gene")))


@query("phosphosite_residues", with_views("select gene, site, residue from residues", "sites", residues=RESIDUES_SQL))
def phosphosite_residues(spark, d):
    return site_residues(views.sites(spark, d)).select("gene", "site", "residue").distinct()


@query("explode_sites", with_views("select gene, site, unnest(string_split(residue, ';')) as residue from residues", "sites", residues=RESIDUES_SQL))
def explode_sites(spark, d):
    listed = site_residues(views.sites(spark, d)).select("gene", "site", "residue").distinct()
    return reshape.explode_tokens(listed, "residue")


@query(
    "mean_of_means_strict",
    with_views(
        f"""select target, sample, n_parts, case when seen = n_parts then {r6('v')} end as value from (
              select target, sample, count(m) as seen, avg(m) as v from part_means group by all)
            join (select target, count(distinct site) as n_parts from part_means group by all) using (target)""",
        "sites",
        residues=RESIDUES_SQL,
        singles="select gene, site, unnest(string_split(residue, ';')) as r from residues",
        part_means="""select concat(gene, '-', r) as target, s.site, sample, avg(value) as m
                      from sites s join singles using (gene, site) group by all""",
    ),
)
def mean_of_means_strict(spark, d):
    single = reshape.explode_tokens(site_residues(views.sites(spark, d)), "residue")
    keyed = single.withColumn("target", F.concat_ws("-", "gene", "residue"))
    return rounded(reshape.mean_of_means_strict(keyed, target="target", part="site"), "value")


@query(
    "collapse_members",
    with_views(
        """select kinase, count(*) as size, string_agg(m, '; ' order by m) as members from (
             select distinct kinase, concat(sub_gene, '-', sub_mod_rsd) as m from ks) group by kinase""",
        "ks",
    ),
)
def collapse_members(spark, d):
    listed = views.substrates(spark, d).withColumn("m", F.concat_ws("-", "sub_gene", "sub_mod_rsd"))
    return reshape.collapse_members(listed, "kinase", "m")


@query(
    "split_by_type",
    with_views(
        """select 'patient' as kind, sample, regexp_extract(description, '^(P\\S+)\\s', 1) as phase,
             regexp_extract(description, 'Cycle ([0-9]+)', 1) as cycle, regexp_extract(description, 'Day ([0-9]+)', 1) as day,
             null as cell_line, null as replicate from visits where treatment <> 'OTHER'
           union all select 'cell_line', sample, null, null, null, regexp_extract(name, 'HS-[0-9]+'), regexp_extract(name, 'R[0-9]')
             from visits where treatment = 'OTHER'""",
        "visits",
    ),
)
def split_by_type(spark, d):
    """Both tables stacked, for the comparison; the operator gives them one by one."""
    typed = design.split_samples(views.visits(spark, d), F.col("treatment") == "OTHER")
    kinds = [df.withColumn("kind", F.lit(kind)) for kind, df in typed.items()]
    return kinds[0].unionByName(kinds[1], allowMissingColumns=True)


# --- aggregates ------------------------------------------------------------------------------------------


@query("distinct_samples", with_views("select distinct sample, plex from meas", "meas"))
def distinct_samples(spark, d):
    return views.meas(spark, d).select("sample", "plex").distinct()


@query("group_mean", with_views(f"select sample, {r6('avg(value)')} as mean from meas group by sample", "meas"))
def group_mean(spark, d):
    return rounded(views.meas(spark, d).groupBy("sample").agg(F.avg("value").alias("mean")), "mean")


@query(
    "group_mean_sd_band",
    with_views(
        f"""select ligand, treatment, day, sample, {r6('avg(value)')} as mean, {r6('stddev_samp(value)')} as sd,
            {r6('avg(value) - stddev_samp(value)')} as low, {r6('avg(value) + stddev_samp(value)')} as high
            from course group by all""",
        "course",
    ),
)
def group_mean_sd_band(spark, d):
    band = aggregate.mean_sd_band(views.course(spark, d), ["ligand", "treatment", "day", "sample"])
    return rounded(band, "mean", "sd", "low", "high")


VARIANCE_SQL = """select feature, var_samp(value) as variance from dense group by feature
    having count(*) = (select count(distinct sample) from dense) and var_samp(value) > 0"""


@query("feature_variance", with_views(f"select feature, {r6('variance')} as variance from spread", "meas_dense", dense=DENSE_CELLS_SQL, spread=VARIANCE_SQL))
def feature_variance(spark, d):
    return rounded(aggregate.feature_variance(views.meas_dense(spark, d)), "variance")


@query(
    "top_variable",
    with_views(
        f"select feature, {r6('variance')} as variance from spread order by spread.variance desc, feature limit 150",
        "meas_dense", dense=DENSE_CELLS_SQL, spread=VARIANCE_SQL,
    ),
)
def top_variable(spark, d):
    return rounded(aggregate.top_variable(views.meas_dense(spark, d), 150), "variance")


@query("patient_arm_mean", with_views(f"select patient, treatment, {r6('avg(loading_mass)')} as mean_mass from visits group by all", "visits"))
def patient_arm_mean(spark, d):
    return rounded(views.visits(spark, d).groupBy("patient", "treatment").agg(F.avg("loading_mass").alias("mean_mass")), "mean_mass")


@query(
    "cluster_sizes",
    "select n_nationkey as label, count(vec_id) as n from nation left join embeddings on label = n_nationkey group by all",
)
def cluster_sizes(spark, d):
    groups = table(spark, d, "nation").select(F.col("n_nationkey").alias("label"))
    return aggregate.sizes_with_zero(groups, table(spark, d, "embeddings"), "label")


@query(
    "box_summary",
    with_views(
        f"""select treatment, count(*) as n, min(loading_mass) as min, {r6('quantile_cont(loading_mass, 0.25)')} as q1,
            {r6('median(loading_mass)')} as median, {r6('quantile_cont(loading_mass, 0.75)')} as q3, max(loading_mass) as max
            from visits group by treatment""",
        "visits",
    ),
)
def box_summary(spark, d):
    return rounded(aggregate.box_summary(views.visits(spark, d), ["treatment"], "loading_mass"), "q1", "median", "q3")


# --- order and sets --------------------------------------------------------------------------------------


@query(
    "earliest_per_patient",
    with_views(
        """select patient, sample, visit_day, treatment from (select *, row_number() over (partition by patient
             order by visit_day, sample) as rn from visits) where rn = 1""",
        "visits",
    ),
)
def earliest_per_patient(spark, d):
    rows = views.visits(spark, d).select("patient", "sample", "visit_day", "treatment")
    return design.first_per_group(rows, "patient", "visit_day", "sample")


@query(
    "center_to_first",
    with_views(
        f"""select patient, sample, row_number() over w as x, {r6('loading_mass - first_value(loading_mass) over w')} as delta
            from visits window w as (partition by patient order by visit_day, md5(cast(sample as varchar)), sample)""",
        "visits",
    ),
)
def center_to_first(spark, d):
    rows = views.visits(spark, d).select("patient", "sample", "visit_day", "loading_mass")
    centred = design.center_to_first(rows, ["patient"], "visit_day", "sample", value="loading_mass")
    return rounded(centred.select("patient", "sample", "x", "delta"), "delta")


LEVELS = ["PRE", "GILT", "GILT + DEC"]


@query(
    "ordered_visits",
    with_views(
        """select patient, sample, treatment, case treatment when 'PRE' then 1 when 'GILT' then 2 when 'GILT + DEC' then 3 end::bigint as ord
           from visits order by ord, patient, sample""",
        "visits",
    ),
)
def ordered_visits(spark, d):
    rows = views.visits(spark, d).select("patient", "sample", "treatment")
    return design.with_level_order(rows, "treatment", LEVELS).orderBy("ord", "patient", "sample")


@query(
    "cohorts",
    with_views(
        """select 'pre' as cohort, patient, sample from visits where treatment = 'PRE'
           union all select 'first_treated', patient, sample from ft
           union all select 'first_treated_with_later', patient, sample from ft where patient in (select patient from visits where treatment = 'GILT + DEC')
           union all select 'later', patient, sample from visits where treatment = 'GILT + DEC'
             qualify row_number() over (partition by patient order by visit_day, sample) = 1
           union all select 'healthy', patient, sample from visits where treatment = 'OTHER'""",
        "visits",
        ft="select patient, sample from visits where treatment = 'GILT' qualify row_number() over (partition by patient order by visit_day, sample) = 1",
    ),
)
def cohorts(spark, d):
    return design.cohorts(
        views.visits(spark, d), patient="patient", treatment="treatment", order="visit_day", sample="sample",
        before="PRE", after="GILT", later="GILT + DEC", healthy=F.col("treatment") == "OTHER",
    )


@query(
    "union_cohorts",
    with_views(
        f"""select feature, sample, {r6('value')} as value from meas where plex = 0
            union all select feature, sample, {r6('value')} from course where treatment = 'PRE'""",
        "meas", "course",
    ),
)
def union_cohorts(spark, d):
    first = views.meas(spark, d).where("plex = 0").select("sample", "value", "feature")
    second = views.course(spark, d).where("treatment = 'PRE'").select("feature", "sample", "value")
    return rounded(first.unionByName(second), "value")


@query(
    "multi_dataset_long",
    with_views(
        f"""select 'global' as dataset, feature, sample, {r6('avg(value)')} as value from meas group by all
            union all select 'dense', feature, concat('D', sample), {r6('avg(value)')} from meas_dense group by all""",
        "meas", "meas_dense",
    ),
)
def multi_dataset_long(spark, d):
    """Two crosstabs with different sample columns, written as text and read together."""
    folder = stage_path(spark, "crosstabs")
    renamed = views.meas_dense(spark, d).withColumn("sample", F.concat(F.lit("D"), "sample"))
    parts = {"global": views.meas(spark, d), "dense": renamed}
    for name, rows in parts.items():
        tables.write_tsv(reshape.to_wide(rows), f"{folder}/{name}")
    return rounded(tables.read_datasets(spark, [f"{folder}/{name}" for name in parts], ["feature"]), "value")


@query(
    "intersect_keys",
    with_views("select feature from targeted intersect select feature from meas where plex = 0", "meas", targeted=TARGETED_SQL),
)
def intersect_keys(spark, d):
    return joins.shared_keys(targeted(spark, d), views.meas(spark, d).where("plex = 0"), "feature")


# --- scalar functions ------------------------------------------------------------------------------------


@query(
    "string_clean",
    """select p_partkey, regexp_replace(p_name, '[aeiou]', '*') as first_only, regexp_replace(p_name, '^(\\w+) (\\w+)', '\\2_\\1') as swapped,
       regexp_replace(p_brand, '[^0-9]', '', 'g') as digits from part""",
)
def string_clean(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        text.replace_first(F.col("p_name"), "[aeiou]", "*").alias("first_only"),
        F.regexp_replace("p_name", r"^(\w+) (\w+)", "$2_$1").alias("swapped"),
        F.regexp_replace("p_brand", "[^0-9]", "").alias("digits"),
    )


@query(
    "parse_accession",
    with_views(
        """select accession, regexp_extract(accession, '^(.*)@', 1) as site, regexp_extract(accession, '@(.*)$', 1) as peptide,
           regexp_extract(regexp_extract(accession, '^(.*)@', 1), '^(.*)-[^-]*$', 1) as gene
           from (select distinct concat('HLA-', site, '@', peptide) as accession from sites)""",
        "sites",
    ),
)
def parse_accession(spark, d):
    keyed = views.sites(spark, d).select(F.concat(F.lit("HLA-"), "site", F.lit("@"), "peptide").alias("accession")).distinct()
    site = text.extract(F.col("accession"), "^(.*)@", 1)
    return keyed.select(
        "accession", site.alias("site"), text.extract(F.col("accession"), "@(.*)$", 1).alias("peptide"),
        text.before_last_hyphen(site).alias("gene"),
    )


_SIGNIF = "case when x = 0 then 0 else round(x / pow(10, floor(log10(abs(x))) - 2)) * pow(10, floor(log10(abs(x))) - 2) end"


@query(
    "export_signif",
    f"""select regexp_replace(dataset, '_corrected$', '_final') as dataset, l_orderkey, l_linenumber, l_partkey, {r6(_SIGNIF)} as value from (
        select concat('crosstab_', l_linestatus, case when l_tax > 0.04 then '_corrected' else '_original' end) as dataset,
        l_orderkey, l_linenumber, l_partkey, l_extendedprice * (l_discount - 0.05) as x from lineitem) where regexp_matches(dataset, '_corrected$')""",
)
def export_signif(spark, d):
    """Datasets whose name matches, rounded, written under their new names as text, and read back."""
    name = F.concat(F.lit("crosstab_"), "l_linestatus", F.when(F.col("l_tax") > 0.04, "_corrected").otherwise("_original"))
    rows = table(spark, d, "lineitem").select(
        name.alias("dataset"), "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("value")
    )
    path = stage_path(spark, "exports")
    tables.export_datasets(rows, path, pattern="_corrected$", replacement="_final")
    kinds = "l_orderkey bigint, l_linenumber int, l_partkey bigint, value double, dataset string"
    return rounded(spark.read.csv(path, sep="\t", header=True, schema=kinds, nullValue="NA"), "value")


@query(
    "parse_visit",
    with_views(
        """select distinct description, regexp_extract(description, '^(P\\S+)\\s', 1) as phase,
           regexp_extract(description, 'Cycle ([0-9]+)', 1) as cycle, regexp_extract(description, 'Day ([0-9]+)', 1) as day from visits""",
        "visits",
    ),
)
def parse_visit(spark, d):
    listed = views.visits(spark, d).select("description").distinct()
    return listed.select("description", *[c.alias(n) for n, c in text.visit_parts(F.col("description")).items()])


@query(
    "condition_key",
    """select o_orderkey, concat_ws('_', o_orderstatus, known) as joined, o_orderstatus || '_' || known as strict from (
       select o_orderkey, o_orderstatus, case when o_orderpriority <> '5-LOW' then o_orderpriority end as known from orders)""",
)
def condition_key(spark, d):
    known = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    return table(spark, d, "orders").select(
        "o_orderkey", F.concat_ws("_", "o_orderstatus", known).alias("joined"),
        F.concat("o_orderstatus", F.lit("_"), known).alias("strict"),
    )


@query(
    "sanitize_names",
    with_views(
        """select distinct raw, case when regexp_matches(regexp_replace(raw, '[^A-Za-z0-9._]', '.', 'g'), '^[0-9]')
             then concat('X', regexp_replace(raw, '[^A-Za-z0-9._]', '.', 'g')) else regexp_replace(raw, '[^A-Za-z0-9._]', '.', 'g') end as name
           from (select treatment as raw from visits union all select o_orderpriority from orders union all select description from visits)""",
        "visits",
    ),
)
def sanitize_names(spark, d):
    visits = views.visits(spark, d)
    raw = visits.select(F.col("treatment").alias("raw")).union(visits.select("description")).union(
        table(spark, d, "orders").select("o_orderpriority")
    ).distinct()
    return raw.withColumn("name", text.syntactic_name(F.col("raw")))


@query(
    "sink_round_trip",
    with_views(f"select feature, sample, {r6('avg(value)')} as value from meas group by all", "meas"),
)
def sink_round_trip(spark, d):
    """New table, replaced table and tab-separated file, read back as a crosstab."""
    long = cells(views.meas(spark, d)).drop("plex")
    table_path, text_path = stage_path(spark, "long-table"), stage_path(spark, "crosstab")
    tables.write_new_table(long.where("value < 0"), table_path)
    tables.replace_table(long, table_path)
    tables.write_tsv(reshape.to_wide(tables.read_table(spark, table_path, value="value"), SAMPLES), text_path)
    return rounded(reshape.to_long(tables.read_crosstab(spark, text_path, ["feature"]), ["feature"]), "value")
