"""Queries on kinase scores, ranked lists, over-representation, correlation and consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from abundix.operators import aggregate, enrich, filters, reshape
from abundix.operators.permute import draw_order_sql
from abundix.plans import views
from abundix.plans.identification import activity
from abundix.plans.multivariate import KMEANS_VIEWS, clusters_from_starts
from abundix.plans.registry import prefixed, query, r6, rounded
from abundix.plans.shaping import CELLS_SQL, RESIDUES_SQL, cells, site_residues
from abundix.plans.statistics import P_VIEWS, TEST_VIEWS, bh_sql, ranked, t_p_sql, with_p
from abundix.plans.views import table, with_views
from abundix.session import cut_lineage, stage_path
from abundix.sources import tables

# --- kinases ---------------------------------------------------------------------------------------------

KSEA_VIEWS = {
    "residues": RESIDUES_SQL,
    "singles": "select gene, site, unnest(string_split(residue, ';')) as r from residues",
    "single": "select sample, gene, r as residue, avg(value) as v from sites join singles using (gene, site) group by all",
    "overall": "select sample, avg(v) as mean_all, stddev_samp(v) as sd_all from single group by sample",
    "scores": """select kinase, sample, m, mean_s, mean_all, sd_all, (mean_s - mean_all) * sqrt(m) / sd_all as z from (
        select kinase, sample, count(*) as m, avg(v) as mean_s from single join ks on gene = sub_gene and residue = sub_mod_rsd group by all)
        join overall using (sample)""",
}


def normal_tail_sql(z: str, steps: int = 1000) -> str:
    """P(Z > |z|) by Simpson's rule on the density."""
    weight = f"case when i = 0 or i = {steps} then 1 when i % 2 = 1 then 4 else 2 end"
    area = f"list_sum(list_transform(generate_series(0, {steps}), lambda i: ({weight}) * exp(-pow(abs({z}) * i / {steps}, 2) / 2)))"
    return f"0.5 - abs({z}) / {steps} / 3 * {area} / sqrt(2 * pi())"


def substrates(spark, d):
    return views.substrates(spark, d).withColumnsRenamed({"sub_gene": "gene", "sub_mod_rsd": "residue"})


def kinases(spark, d):
    return enrich.kinase_scores(site_residues(views.sites(spark, d)), substrates(spark, d), by="sample")


@query(
    "ksea_z",
    with_views(
        f"select kinase, sample, m, {r6('mean_s')} as mean_s, {r6('mean_all')} as mean_all, {r6('sd_all')} as sd_all, {r6('z')} as z from scores",
        "sites", "ks", **KSEA_VIEWS,
    ),
)
def ksea_z(spark, d):
    return rounded(kinases(spark, d), "mean_s", "mean_all", "sd_all", "z")


@query(
    "ksea_test",
    with_views(
        f"select kinase, sample, {r6('p')} as p, {r6('fdr')} as fdr from adjusted", "sites", "ks", **KSEA_VIEWS,
        with_p=f"select *, {normal_tail_sql('z')} as p from scores", adjusted=bh_sql("with_p", "sample", "p", "fdr"),
    ),
)
def ksea_test(spark, d):
    tested = enrich.kinase_test(kinases(spark, d), "sample")
    return rounded(tested.select("kinase", "sample", "p", "fdr"), "p", "fdr")


@query(
    "ksea_significant",
    with_views(
        f"select kinase, sample, m, {r6('fdr')} as fdr from adjusted where m >= 5 and fdr < 0.45", "sites", "ks", **KSEA_VIEWS,
        with_p=f"select *, {normal_tail_sql('z')} as p from scores", adjusted=bh_sql("with_p", "sample", "p", "fdr"),
    ),
)
def ksea_significant(spark, d):
    kept = enrich.significant_kinases(enrich.kinase_test(kinases(spark, d), "sample"), 5, 0.45)
    return rounded(kept.select("kinase", "sample", "m", "fdr"), "fdr")


TESTED_VIEWS = {
    **KSEA_VIEWS,
    "with_p": f"select *, {normal_tail_sql('z')} as p from scores",
    "adjusted": bh_sql("with_p", "sample", "p", "fdr"),
    "pairs": """select s.sample, ks.kinase, s.gene, s.residue, ks.source, s.v as value from single s
        join ks on s.gene = ks.sub_gene and s.residue = ks.sub_mod_rsd""",
}


def substrate_rows(spark, d, *, max_fdr: float | None = None):
    sites = site_residues(views.sites(spark, d))
    tested = enrich.kinase_test(kinases(spark, d), "sample")
    if max_fdr is not None:
        tested = enrich.significant_kinases(tested, 5, max_fdr)
    return enrich.kinase_substrates(sites, substrates(spark, d), tested, by="sample")


SUBSTRATE_COLUMNS = f"{r6('value')} as value, m, {r6('mean_s')} as mean_s, {r6('z')} as z, {r6('p')} as p, {r6('fdr')} as fdr"


@query(
    "ksea_substrates",
    with_views(
        f"select sample, kinase, gene, residue, source, {SUBSTRATE_COLUMNS} from pairs join adjusted using (sample, kinase)", "sites", "ks", **TESTED_VIEWS
    ),
)
def ksea_substrates(spark, d):
    """Every measured substrate of every tested kinase, with its source and value."""
    return rounded(substrate_rows(spark, d), "value", "mean_s", "z", "p", "fdr")


@query(
    "kinase_network",
    with_views(
        f"""select sample, kinase, gene, source, count(*) as n_sites, {r6('avg(value)')} as value, {r6('max(z)')} as z, {r6('max(fdr)')} as fdr
            from pairs join adjusted using (sample, kinase) where m >= 5 and fdr < 0.45 group by sample, kinase, gene, source""",
        "sites", "ks", **TESTED_VIEWS,
    ),
)
def kinase_network(spark, d):
    """Per condition the edges from significant kinases to their substrates, with the columns of both."""
    edges = substrate_rows(spark, d, max_fdr=0.45).groupBy("sample", "kinase", "gene", "source").agg(
        F.count(F.lit(1)).alias("n_sites"), F.avg("value").alias("value"), F.max("z").alias("z"), F.max("fdr").alias("fdr")
    )
    return rounded(edges, "value", "z", "fdr")


KINASE_SAMPLES = [f"N{i}" for i in range(20)]


@query(
    "kinase_matrix",
    with_views(
        "select kinase, " + ", ".join(f"{r6(f'avg(case when sample = {chr(39)}{s}{chr(39)} then v end)')} as {s}" for s in KINASE_SAMPLES)
        + " from acts where kinase in (select kinase from adjusted where m >= 5 and fdr < 0.45)"
        " and kinase in (select kinase from spread order by spread.variance desc, kinase limit 150) group by kinase",
        "sites", "ks", **TESTED_VIEWS,
        acts="select kinase, sample, avg(value) as v from pairs group by all",
        spread="""select kinase, var_samp(v) as variance from acts group by kinase
            having count(*) = (select count(distinct sample) from acts) and var_samp(v) > 0""",
    ),
)
def kinase_matrix(spark, d):
    """Activity matrix of the 150 most variable kinases among those that are significant in any condition."""
    strong = enrich.significant_kinases(enrich.kinase_test(kinases(spark, d), "sample"), 5, 0.45)
    scores = cut_lineage(activity(spark, d))
    variable = aggregate.top_variable(scores, 150, feature="kinase", value="mean_lfc")
    kept = filters.keep_listed(filters.keep_listed(scores, strong.select("kinase").distinct(), "kinase"), variable.select("kinase"), "kinase")
    matrix = reshape.to_wide(kept, KINASE_SAMPLES, feature="kinase", value="mean_lfc")
    return rounded(matrix, *KINASE_SAMPLES)


# --- gene sets -------------------------------------------------------------------------------------------


@query(
    "geneset_long",
    """select distinct concat('KEGG_', p_brand, '_', p_type) as term, replace(concat(p_brand, '_', p_type), '_', ' ') as label,
       concat('P', cast(p_partkey + extra as varchar)) as gene from part, (values (0), (1)) as e(extra)""",
)
def geneset_long(spark, d):
    part = table(spark, d, "part")
    members = F.array(prefixed("P", "p_partkey"), F.lit("null"), F.concat(F.lit("P"), (F.col("p_partkey") + 1).cast("string")), F.lit(""))
    padded = part.select(F.concat_ws("_", F.lit("KEGG"), "p_brand", "p_type").alias("term"), members.alias("members"))
    others = part.select(F.concat_ws("_", F.lit("REACTOME"), "p_brand", "p_type").alias("term"), members.alias("members"))
    return enrich.sets_by_prefix(padded.unionByName(others), "KEGG_").select("term", "label", "gene").distinct()


@query(
    "leading_edge_values",
    with_views(
        f"select feature, sample, {r6('value')} as value from cells where feature in (select gene from term2gene where regexp_matches(term, 'REACTOME_(PROMO|ECONOMY)_[1-3]$'))",
        "meas", "term2gene", cells=CELLS_SQL,
    ),
)
def leading_edge_values(spark, d):
    """Of terms in an enrichment result file, written and read as text."""
    sets = reshape.collapse_members(views.term2gene(spark, d), "term", "gene", separator=";")
    path = stage_path(spark, "enrichment")
    tables.write_tsv(sets.select(F.col("term").alias("geneSet"), F.col("term").alias("description"), F.col("members").alias("userId")), path)
    results = tables.read_enrichment(spark, path)
    values = cells(views.meas(spark, d)).drop("plex")
    return rounded(enrich.member_values(results, "REACTOME_(PROMO|ECONOMY)_[1-3]$", values), "value")


# --- ranked lists ----------------------------------------------------------------------------------------


GSEA_VIEWS = {
    **TEST_VIEWS,
    "ranks": """select comparison, feature, abs(round(log_fc, 9)) as w, count(*) over (partition by comparison) as n,
        row_number() over (partition by comparison order by round(log_fc, 9) desc, md5(feature), feature) as rank from tested""",
    "sizes": "select comparison, term, count(*) as h, sum(w) as total_w from ranks join (select distinct term, gene from term2gene) on feature = gene group by all having count(*) >= 5",
    "grid": """select r.comparison, z.term, r.n, z.h, z.total_w, r.w, r.rank, g.gene is not null as hit from ranks r join sizes z on r.comparison = z.comparison
        left join (select distinct term, gene from term2gene) g on g.term = z.term and g.gene = r.feature""",
    "scored": """select comparison, term, n, h, case when up >= -down then up else down end as es from (
        select comparison, term, n, h, max(s) as up, min(s) as down from (
          select comparison, term, n, h, sum(case when hit then w / total_w else -1.0::double / (n - h) end) over (
            partition by comparison, term order by rank) as s from grid) group by all)""",
}
DRAWS, SEED = 2000, 117
NULL_VIEWS = {
    "wanted": "select distinct comparison, n, h from scored",
    "lists": "select n, max(h) as most from wanted group by n",
    "draws": draw_order_sql(DRAWS, SEED, "lists", "most"),
    "drawn": """select z.comparison, z.n, z.h, d.perm, d.rank, r.w, sum(r.w) over w as up, row_number() over w as i
        from wanted z join draws d on d.n = z.n and d.j <= z.h join ranks r on r.comparison = z.comparison and r.rank = d.rank
        window w as (partition by z.comparison, z.h, d.perm order by d.rank)""",
    "nulls": """select comparison, h, case when high >= -low then high else low end as es from (
        select comparison, h, perm, max(up / total - missed) as high, min((up - w) / total - missed) as low from (
          select d.comparison, d.h, d.perm, up, w, (rank - i) / (n - d.h)::double as missed, total from drawn d
          join (select comparison, h, perm, max(up) as total from drawn group by all) using (comparison, h, perm))
        group by all)""",
    "with_p": """select * exclude (mean), es / mean as nes from (
        select s.comparison, s.term, s.n, s.h, s.es, avg(case when sign(u.es) = sign(s.es) then abs(u.es) end) as mean,
          (1 + count(case when sign(u.es) = sign(s.es) and abs(u.es) >= abs(s.es) - 1e-9 then 1 end))::double
            / (1 + count(case when sign(u.es) = sign(s.es) then 1 end)) as p
        from scored s join nulls u using (comparison, h) group by s.comparison, s.term, s.n, s.h, s.es)""",
}


@query("gsea_es", with_views(f"select comparison, term, n, h, {r6('es')} as es from scored", "meas", "term2gene", **GSEA_VIEWS))
def gsea_es(spark, d):
    return rounded(set_scores(spark, d), "es")


def set_scores(spark, d):
    return enrich.ranked_set_scores(ranked(spark, d), views.term2gene(spark, d), value="log_fc", min_size=5)


@query(
    "gsea_nes",
    with_views(
        f"select comparison, term, n, h, {r6('es')} as es, {r6('nes')} as nes, {r6('p')} as p, {r6('p_adj')} as p_adj from adjusted",
        "meas", "term2gene", **GSEA_VIEWS, **NULL_VIEWS, adjusted=bh_sql("with_p"),
    ),
)
def gsea_nes(spark, d):
    """Normalised scores of all comparisons, with 2,000 random sets per set size."""
    listed = cut_lineage(ranked(spark, d))
    scores = cut_lineage(enrich.ranked_set_scores(listed, views.term2gene(spark, d), value="log_fc", min_size=5))
    null = enrich.null_set_scores(listed, scores, value="log_fc", n_perm=DRAWS, seed=SEED)
    return rounded(enrich.normalised_set_scores(scores, null), "es", "nes", "p", "p_adj")


@query("gsea_multilevel")
def gsea_multilevel(spark, d):
    """The same terms with p by splitting where the 2,000 random sets say too little."""
    listed = cut_lineage(ranked(spark, d))
    scores = cut_lineage(enrich.ranked_set_scores(listed, views.term2gene(spark, d), value="log_fc", min_size=5))
    null = cut_lineage(enrich.null_set_scores(listed, scores, value="log_fc", n_perm=DRAWS, seed=SEED))
    return enrich.multilevel_p(scores, listed, null, value="log_fc", seed=SEED)


# --- over-representation ---------------------------------------------------------------------------------

ORA_VIEWS = {
    "members": "select distinct term, gene from term2gene where gene in (select feature from meas)",
    "set_sizes": "select term, count(*) as big_k from members group by term",
    "universe": "select count(distinct feature) as big_n from meas",
}


def _ora_sql(chosen: str, keys: str) -> dict[str, str]:
    return {
        **ORA_VIEWS,
        "chosen": f"select * from ({chosen}) where feature in (select feature from meas)",
        "counts": f"""select {keys}, term, k, big_k, n, big_n from (select {keys}, term, count(*) as k from chosen join members on feature = gene group by all)
            join set_sizes using (term) join (select {keys}, count(*) as n from chosen group by all) using ({keys}), universe""",
        "with_p": """select *, least(1, list_sum(list_transform(generate_series(k, least(n, big_k)), lambda i: exp(
            lgamma(big_k + 1) - lgamma(i + 1) - lgamma(big_k - i + 1) + lgamma(big_n - big_k + 1) - lgamma(n - i + 1)
            - lgamma(greatest(big_n - big_k - n + i, 0) + 1) - lgamma(big_n + 1) + lgamma(n + 1) + lgamma(big_n - n + 1))
            * case when big_n - big_k - n + i < 0 then 0 else 1 end))) as p from counts""",
    }


CHOSEN_SQL = "select distinct concat('C', cast(p_size % 7 as varchar)) as cluster, concat('P', cast(p_partkey as varchar)) as feature from part"


def chosen(spark, d):
    part = table(spark, d, "part")
    return part.select(F.concat(F.lit("C"), (F.col("p_size") % 7).cast("string")).alias("cluster"), prefixed("P", "p_partkey").alias("feature"))


def overlap(spark, d):
    return enrich.overlap_counts(chosen(spark, d), views.meas(spark, d), views.term2gene(spark, d))


@query("ora_counts", with_views("select cluster, term, k, n, big_k, big_n from counts", "meas", "term2gene", **_ora_sql(CHOSEN_SQL, "cluster")))
def ora_counts(spark, d):
    return overlap(spark, d).select("cluster", "term", "k", "n", "big_k", "big_n")


@query(
    "ora_pvalue",
    with_views(
        f"select cluster, term, {r6('p')} as p, {r6('p_adj')} as p_adj from adjusted", "meas", "term2gene", **_ora_sql(CHOSEN_SQL, "cluster"),
        adjusted=bh_sql("with_p", "cluster"),
    ),
)
def ora_pvalue(spark, d):
    tested = enrich.over_representation(overlap(spark, d))
    return rounded(tested.select("cluster", "term", "p", "p_adj"), "p", "p_adj")


BY_K_SQL = "select k as k_, cluster, concat('P', cast(feature as varchar)) as feature from clusters"


@query(
    "ora_by_cluster",
    with_views(
        "select cast(k_ as bigint) as kk, cast(cluster as bigint) as cluster, count(case when p_adj < 0.05 then 1 end) as significant_terms, count(*) as terms from adjusted group by all",
        "meas", "term2gene", **KMEANS_VIEWS, **_ora_sql(BY_K_SQL, "k_, cluster"), adjusted=bh_sql("with_p", "k_, cluster"),
    ),
)
def ora_by_cluster(spark, d):
    """Clusters of K-means for every K, all tested in one job."""
    found = cut_lineage(clusters_from_starts(spark, d))
    clusters = found.select(F.col("k").alias("kk"), "cluster", prefixed("P", "feature").alias("feature"))
    counts = enrich.overlap_counts(clusters, views.meas(spark, d), views.term2gene(spark, d), by=["kk", "cluster"])
    tested = enrich.over_representation(counts, ["kk", "cluster"])
    return tested.groupBy("kk", "cluster").agg(F.count_if(F.col("p_adj") < 0.05).alias("significant_terms"), F.count(F.lit(1)).alias("terms"))


# --- correlation -----------------------------------------------------------------------------------------

CORRELATION_VIEWS = {
    "cells": "select feature, sample, concat('R', cast(plex as varchar)) as cohort, avg(value) as value from meas group by all",
    "seen": "select cohort, feature from cells group by all having count(*) >= 3",
    "kept": "select * from cells semi join seen using (cohort, feature)",
    "pairs": """select x.cohort, x.feature as a, y.feature as b, corr(x.value, y.value) as r from kept x join kept y
        on x.cohort = y.cohort and x.sample = y.sample and x.feature < y.feature group by all
        having count(*) >= 3 and var_pop(x.value) * count(*) > 1e-9 and var_pop(y.value) * count(*) > 1e-9""",
    "members": "select distinct term, gene from term2gene",
    "inside": """select cohort, g.term, count(*) as pairs, avg(r) as correlation, var_samp(r) as v from pairs
        join members g on a = g.gene join members h on b = h.gene and g.term = h.term group by all""",
    "outside": "select cohort, count(*) as all_pairs, avg(r) as background, var_samp(r) as v0 from pairs group by cohort",
    "counted": "select cohort, term, count(*) as n_members from seen join members on feature = gene group by all",
    "features": "select cohort, count(*) as n_features from seen group by all",
}


def _cohort_rows(spark, d):
    """Sparse rows: about a third of the cells of a cohort are missing."""
    return views.meas(spark, d).select("feature", "sample", "value", prefixed("R", "plex").alias("cohort"))


@query(
    "corr_enrichment",
    with_views(
        f"""select cohort, term, n_members, n_features, pairs, all_pairs, {r6('correlation')} as correlation, {r6('background')} as background
            from inside join outside using (cohort) join counted using (cohort, term) join features using (cohort)""",
        "meas", "term2gene", **CORRELATION_VIEWS,
    ),
)
def corr_enrichment(spark, d):
    scored = enrich.set_correlation(_cohort_rows(spark, d), views.term2gene(spark, d))
    out = scored.select("cohort", "term", "n_members", "n_features", "pairs", "all_pairs", "correlation", "background")
    return rounded(out, "correlation", "background")


@query(
    "corr_enrichment_p",
    with_views(
        f"""select cohort, term, {r6('correlation')} as correlation, round(t, 4) + 0.0::double as t, {r6(t_p_sql('t', 'df'))} as p from (
              select *, (correlation - background) / sqrt(q1 + q0) as t, (q1 + q0) * (q1 + q0) / (q1 * q1 / (pairs - 1) + q0 * q0 / (all_pairs - 1)) as df from (
                select *, v / pairs as q1, v0 / all_pairs as q0 from inside join outside using (cohort) where pairs > 2))""",
        "meas", "term2gene", **CORRELATION_VIEWS,
    ),
)
def corr_enrichment_p(spark, d):
    tested = enrich.set_correlation_test(_cohort_rows(spark, d), views.term2gene(spark, d))
    tested = tested.where("pairs > 2").select("cohort", "term", "correlation", F.round("t", 4).alias("t"), "p")
    return rounded(tested, "correlation", "p")


# --- consensus -------------------------------------------------------------------------------------------


@query(
    "consensus_terms",
    with_views(
        f"""select term, {r6('max_abs')} as max_abs_score, {r6('min_p')} as min_p_adj from (
              select feature as term, max(abs(t)) as max_abs, min(p_adj) as min_p from adjusted group by feature
              having count(t) = (select count(distinct comparison) from with_p) order by max_abs desc, term limit 50) where min_p < 0.9""",
        "meas", **P_VIEWS, usable="select * from with_p where t is not null", adjusted=bh_sql("usable", ""),
    ),
)
def consensus_terms(spark, d):
    results = with_p(spark, d).where("t is not null").select(F.col("comparison").alias("patient"), F.col("feature").alias("term"), F.col("t").alias("score"), "p")
    return rounded(enrich.consensus_terms(results, top=50, cutoff=0.9), "max_abs_score", "min_p_adj")
