"""Queries on normalisation, batch correction and group comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from abundix.functions.special import t_two_sided_p
from abundix.functions.text import significance_mark
from abundix.operators import aggregate, design, differential, filters, joins, linear, normalize
from abundix.operators.ordered import grouped_rank
from abundix.plans import views
from abundix.plans.registry import prefixed, query, r6, rounded
from abundix.plans.shaping import CELLS_SQL, DENSE_CELLS_SQL, cells
from abundix.plans.views import PLEXES, table, with_views

COMPARISONS = {
    "R1_R0": (["R0"], ["R1"]),
    "R2_R0": (["R0"], ["R2"]),
    "R12_R0": (["R0"], ["R1", "R2"]),
    "R34_R12": (["R1", "R2"], ["R3", "R4"]),
}

CATALOGUE_SQL = "select * from (values " + ", ".join(
    f"('{name}', {side}, '{condition}')"
    for name, sides in COMPARISONS.items()
    for side, conditions in enumerate(sides, 1)
    for condition in conditions
) + ") as v(comparison, side, condition)"


def t_p_sql(t: str, v: str, steps: int = 1000) -> str:
    """Two-sided t tail in SQL: with x = sqrt(v) tan(a) the density integrates as cos(a)^(v-1); Simpson's rule."""
    top = f"atan(abs({t}) / sqrt({v}))"
    weight = f"case when i = 0 or i = {steps} then 1 when i % 2 = 1 then 4 else 2 end"
    area = f"list_sum(list_transform(generate_series(0, {steps}), lambda i: ({weight}) * pow(cos({top} * i / {steps}), ({v}) - 1)))"
    scale = f"2 * exp(lgamma((({v}) + 1) / 2.0::double) - lgamma(({v}) / 2.0::double)) / sqrt(pi())"
    return f"greatest(0, 1 - {scale} * {top} / {steps} / 3 * {area})"


def bh_sql(source: str, by: str = "comparison", p: str = "p", out: str = "p_adj") -> str:
    """Adjusted p in SQL; rows without p get none."""
    part = f"partition by {by}" if by else ""
    return f"""select * exclude (j_, n_, raw_), case when {p} is not null then least(1.0::double, min(raw_) over ({part} order by {p} desc
        range between unbounded preceding and current row)) end as {out} from (
        select *, {p} * n_ / j_ as raw_ from (select *, count({p}) over ({part}) as n_,
          count({p}) over ({part} order by {p} range between unbounded preceding and current row) as j_ from {source}))"""


SIDED_SQL = """select comparison, feature, side, count(v) as n, avg(v) as m, coalesce(var_samp(v), 0) as v from (
    select feature, sample, concat('R', cast(plex as varchar)) as condition, avg(value) as v from meas group by all) join catalogue using (condition)
    group by all"""
TESTED_SQL = """select *, case when s2 > 0 then log_fc / sqrt(s2 * unscaled) end as t from (
    select a.comparison, a.feature, a.n as n1, b.n as n2, b.m - a.m as log_fc, (a.n * a.m + b.n * b.m) / (a.n + b.n) as ave, a.n + b.n - 2 as d,
    case when a.n + b.n > 2 then ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) end as s2, 1.0::double / a.n + 1.0::double / b.n as unscaled
    from sided a join sided b on a.comparison = b.comparison and a.feature = b.feature and a.side = 1 and b.side = 2)"""
WITH_P_SQL = f"select *, case when t is not null then {t_p_sql('t', 'd')} end as p from tested"

TEST_VIEWS = {"catalogue": CATALOGUE_SQL, "sided": SIDED_SQL, "tested": TESTED_SQL}
P_VIEWS = {**TEST_VIEWS, "with_p": WITH_P_SQL}
BH_VIEWS = {**P_VIEWS, "adjusted": bh_sql("with_p")}


def conditions(spark, d):
    return table(spark, d, "nation").select(prefixed("N", "n_nationkey").alias("sample"), prefixed("R", "n_regionkey").alias("condition"))


def pairs(spark, d):
    """Both sides of every comparison for every feature."""
    catalogue = design.checked_catalogue(design.comparison_catalogue(spark, COMPARISONS), conditions(spark, d))
    rows = views.meas(spark, d).withColumn("condition", prefixed("R", "plex"))
    return differential.comparison_stats(differential.condition_stats(rows), catalogue)


def tested(spark, d):
    return differential.pooled_test(pairs(spark, d))


def with_p(spark, d):
    return tested(spark, d).withColumn("p", t_two_sided_p(F.col("t"), F.col("d").cast("double")))


def adjusted(spark, d):
    return differential.bh_adjust(with_p(spark, d), "comparison")


# --- normalisation ---------------------------------------------------------------------------------------


@query(
    "normalize_sample_median",
    with_views(f"select feature, sample, {r6('value - median(value) over (partition by sample)')} as value from cells", "meas", cells=CELLS_SQL),
)
def normalize_sample_median(spark, d):
    return rounded(normalize.center_samples(cells(views.meas(spark, d)).drop("plex")), "value")


@query(
    "normalize_global_median",
    with_views(
        f"""select gene, site, peptide, s.sample, {r6('s.value - m.med')} as value from sites s
            left join (select sample, median(value) as med from meas group by sample) m on s.sample = m.sample""",
        "meas", "sites",
    ),
)
def normalize_global_median(spark, d):
    return rounded(normalize.center_samples(views.sites(spark, d), medians_from=views.meas(spark, d)), "value")


def _polish_sql() -> dict[str, str]:
    steps = {"s0": "select feature, sample, avg(value) as value, 0.0::double as row_effect, 0.0::double as col_effect from meas_dense group by all"}
    for i in range(4):
        key, effect, other = [("feature", "row_effect", "col_effect"), ("sample", "col_effect", "row_effect")][i % 2]
        med = f"median(value) over (partition by {key})"
        steps[f"s{i + 1}"] = f"select feature, sample, value - {med} as value, {effect} + {med} as {effect}, {other} from s{i}"
    return steps


@query(
    "median_polish_2iter",
    with_views(f"select feature, sample, {r6('value')} as value, {r6('row_effect')} as row_effect, {r6('col_effect')} as col_effect from s4", "meas_dense", **_polish_sql()),
)
def median_polish_2iter(spark, d):
    polished = normalize.median_polish(cells(views.meas_dense(spark, d)).drop("plex"), passes=2)
    return rounded(polished, "value", "row_effect", "col_effect")


@query(
    "batch_center",
    with_views(
        f"""select feature, sample, {r6('value - avg(value) over (partition by feature, plex) + avg(value) over (partition by feature)')} as value from cells""",
        "meas", cells=CELLS_SQL,
    ),
)
def batch_center(spark, d):
    return rounded(normalize.center_batches(cells(views.meas(spark, d)), "plex").drop("plex"), "value")


def _solved_sql(size: int, source: str) -> dict[str, str]:
    """Coefficients by elimination: ``source`` has the normal equations as rows (feature, i, j, v), j = ``size`` the right side."""
    steps = {"gone0": f"select * from {source}"}
    for k in range(size):
        steps[f"gone{k + 1}"] = f"""select m.feature, m.i, m.j, case when m.i = {k} then m.v / p.v else m.v - c.v * r.v / p.v end as v from gone{k} m
            join gone{k} p on p.feature = m.feature and p.i = {k} and p.j = {k}
            join gone{k} r on r.feature = m.feature and r.i = {k} and r.j = m.j
            join gone{k} c on c.feature = m.feature and c.i = m.i and c.j = {k}"""
    steps["coefficients"] = f"select feature, i, v as b from gone{size} where j = {size}"
    return steps


_LAST = len(PLEXES) - 1
_CODED = [f"case plex when {p} then 1.0::double when {_LAST} then -1 else 0 end" for p in PLEXES[:-1]]
_KINDS = [f"case kind when {k} then 1.0::double when 2 then -1 else 0 end" for k in (0, 1)]
BATCH_SQL = {
    "cells": DENSE_CELLS_SQL,
    "dim": """select concat('N', cast(n_nationkey as varchar)) as sample, n_nationkey % 3 as kind, coalesce(mass, 0) / 1000 - 4.5::double as mass
        from nation left join (select s_nationkey, avg(s_acctbal) as mass from supplier group by all) on n_nationkey = s_nationkey""",
    "coded": f"select feature, sample, value, [1.0::double, {', '.join(_CODED)}, mass, {', '.join(_KINDS)}, value] as x from cells join dim using (sample)",
    "normal": "select feature, i, j, sum(x[i + 1] * x[j + 1]) as v from coded, range(8) t(i), range(9) u(j) group by all",
    **_solved_sql(8, "normal"),
    "removed": "select feature, list(b order by i) as b from coefficients where i between 1 and 5 group by feature",
}


@query(
    "batch_model",
    with_views(
        f"select feature, sample, {r6('value - (x[2] * b[1] + x[3] * b[2] + x[4] * b[3] + x[5] * b[4] + x[6] * b[5])')} as value from coded join removed using (feature)",
        "meas_dense", **BATCH_SQL,
    ),
)
def batch_model(spark, d):
    """Remove plex and loading mass, keep sample type."""
    rows, remove, keep = batch_rows(spark, d)
    return rounded(normalize.remove_covariates(rows, remove, keep).select("feature", "sample", "value"), "value")


def batch_rows(spark, d):
    nation = table(spark, d, "nation").withColumn("sample", prefixed("N", "n_nationkey"))
    loading = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("mass"))
    dim = nation.join(loading, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(
        "sample", (F.coalesce("mass", F.lit(0.0)) / 1000.0 - 4.5).alias("mass"), (F.col("n_nationkey") % 3).cast("string").alias("kind")
    )
    rows = cells(views.meas_dense(spark, d)).withColumn("plex", F.col("plex").cast("string")).join(dim, "sample")
    remove = {**normalize.sum_coded("plex", [str(p) for p in PLEXES]), "mass": F.col("mass")}
    return rows, remove, normalize.sum_coded("kind", ["0", "1", "2"])


@query("batch_model_hierarchical")
def batch_model_hierarchical(spark, d):
    """The same with a prior over all features; of the sparse rows, whose features often lack plexes."""
    sparse = cells(views.meas(spark, d)).withColumn("plex", F.col("plex").cast("string"))
    remove = normalize.sum_coded("plex", [str(p) for p in PLEXES])
    return rounded(normalize.hierarchical_removal(sparse, remove, {}).select("feature", "sample", "value"), "value")


# With every plex present the sum-coded effect of a plex is its mean minus the mean of plex means, and its
# sampling variance follows from the plex sizes; the last plex takes minus the sum of the others.
_SHRINK_SQL = {
    "plex_means": "select feature, plex, avg(value) as m, count(*) as n, var_pop(value) * count(*) as ss from cells group by all",
    "size": "select count(distinct plex)::double as l, max(plex) as last from cells",
    "whole": "select feature, avg(m) as mm, sum(ss) / (sum(n) - max(l)) as s2, sum(1.0::double / n) as inv from plex_means, size group by feature",
    "effects": """select feature, plex, m - mm as b, s2 * (pow(1 - 1 / l, 2) / n + (inv - 1.0::double / n) / (l * l)) as noise
        from plex_means join whole using (feature), size where plex < last""",
    "priors": "select plex, avg(b) as mean_b, greatest(var_samp(b) - avg(noise), 0) as prior from effects group by plex",
    "pulled": """select feature, plex, mean_b + prior / (prior + noise) * (b - mean_b) as b from effects join priors using (plex)""",
    "all_effects": "select feature, plex, b from pulled union all select feature, last, -sum(b) from pulled, size group by feature, last",
}


@query(
    "batch_model_shrunk",
    with_views(
        f"select feature, sample, {r6('value - b')} as value from cells join all_effects using (feature, plex)",
        "meas_dense",
        every=DENSE_CELLS_SQL,
        cells="""select * from every where feature in (select feature from every group by feature
                 having count(distinct plex) = (select count(distinct plex) from every))""",
        **_SHRINK_SQL,
    ),
)
def batch_model_shrunk(spark, d):
    """Plex effects pulled towards their mean over features, of features that every plex has."""
    full = filters.present_in_every_batch(cells(views.meas_dense(spark, d)), "plex")
    rows = full.withColumn("plex", F.col("plex").cast("string"))
    plexes = sorted(row["plex"] for row in rows.select("plex").distinct().collect())  # one per region
    remove = normalize.sum_coded("plex", plexes)
    return rounded(normalize.remove_covariates(rows, remove, {}, shrink=True).select("feature", "sample", "value"), "value")


MASS_VIEWS = {
    "mass": "select concat('N', cast(s_nationkey as varchar)) as sample, avg(s_acctbal) / 1000 - 4.5::double as x from supplier group by s_nationkey",
    "cells": CELLS_SQL,
    "joined": "select feature, sample, value, x from cells join mass using (sample)",
}


@query(
    "covariate_removal",
    with_views(
        f"""select feature, sample, {r6('value - coalesce(b, 0) * x')} as value from joined join
            (select feature, case when count(distinct x) > 1 then regr_slope(value, x) end as b from joined group by feature) using (feature)""",
        "meas", **MASS_VIEWS,
    ),
)
def covariate_removal(spark, d):
    """One numeric covariate; features that see one level of it have no slope and stay as they are."""
    rows = mass_rows(spark, d)
    several = rows.groupBy("feature").agg(F.count_distinct("x").alias("levels"))
    coded = F.when(F.col("levels") > 1, F.col("x")).otherwise(F.lit(0.0))
    removed = normalize.remove_covariates(rows.join(several, "feature"), {"x": coded}, {})
    return rounded(removed.select("feature", "sample", "value"), "value")


def mass_rows(spark, d):
    mass = table(spark, d, "supplier").groupBy("s_nationkey").agg((F.avg("s_acctbal") / 1000 - 4.5).alias("x"))
    return cells(views.meas(spark, d)).drop("plex").join(mass.select(prefixed("N", "s_nationkey").alias("sample"), "x"), "sample")


def _em_sql(steps: int) -> dict[str, str]:
    """EM for the mean and variance of one coefficient over features, step by step."""
    out = {
        "slopes": """select feature, sxx, sxy, case when d > 0 and rss > 0 then rss / d else (select sum(rss) / sum(d) from fitted where d > 0) end as s2 from fitted""",
        "prior0": "select 0.0::double as m, 1.0::double as t",
    }
    for k in range(steps):
        out[f"post{k}"] = f"select 1 / (1 / t + sxx / s2) as v, (m / t + sxy / s2) / (1 / t + sxx / s2) as b from slopes, prior{k}"
        out[f"prior{k + 1}"] = f"select avg(b) as m, avg(v + b * b) - avg(b) * avg(b) as t from post{k}"
    return out


@query(
    "covariate_removal_shrunk",
    with_views(
        f"""select feature, sample, {r6('value - x * b')} as value from joined join
            (select feature, (m / t + sxy / s2) / (1 / t + sxx / s2) as b from slopes, prior25) using (feature)""",
        "meas", **MASS_VIEWS,
        fitted="""select feature, sxx, sxy, greatest(syy - case when sxx > 1e-12 then sxy * sxy / sxx else 0 end, 0) as rss,
            n - 1 - case when sxx > 1e-12 then 1 else 0 end as d from (
            select feature, count(*) as n, var_pop(x) * count(*) as sxx, covar_pop(x, value) * count(*) as sxy, var_pop(value) * count(*) as syy from joined group by feature)""",
        **_em_sql(25),
    ),
)
def covariate_removal_shrunk(spark, d):
    """The same slope with a prior fitted to all features; those with one level take the prior's mean."""
    removed = normalize.hierarchical_removal(mass_rows(spark, d), {"x": F.col("x")}, {}, steps=25)
    return rounded(removed.select("feature", "sample", "value"), "value")


# --- tests -----------------------------------------------------------------------------------------------

WELCH_SQL = """select *, case when ok then effect / sqrt(q) end as t, case when ok then q * q / (q1 * q1 / (n1 - 1) + q2 * q2 / (n2 - 1)) end as df from (
    select a.comparison, a.feature, a.n as n1, b.n as n2, b.m - a.m as effect, a.v / a.n as q1, b.v / b.n as q2, a.v / a.n + b.v / b.n as q,
    a.n > 1 and b.n > 1 and a.v / a.n + b.v / b.n > 0 as ok
    from sided a join sided b on a.comparison = b.comparison and a.feature = b.feature and a.side = 1 and b.side = 2)"""


@query(
    "fold_change",
    with_views(
        f"select comparison, feature, {r6('effect')} as effect, {r6('t')} as t, {r6('df')} as df, {r6('p')} as p, {r6('p_adj')} as p_adj from adjusted",
        "meas", catalogue=CATALOGUE_SQL, sided=SIDED_SQL, welch=WELCH_SQL,
        with_p=f"select *, case when t is not null then {t_p_sql('t', 'df')} end as p from welch", adjusted=bh_sql("with_p"),
    ),
)
def fold_change(spark, d):
    both = pairs(spark, d).where("n1 > 0 and n2 > 0")
    welch = differential.welch_test(both).withColumn("p", t_two_sided_p("t", "df"))
    out = differential.bh_adjust(welch, "comparison").select("comparison", "feature", "effect", "t", "df", "p", "p_adj")
    return rounded(out, "effect", "t", "df", "p", "p_adj")


@query(
    "two_group_t",
    with_views(
        f"select comparison, feature, n1, n2, d, {r6('log_fc')} as log_fc, {r6('ave')} as ave, {r6('s2')} as s2, {r6('t')} as t from tested",
        "meas", **TEST_VIEWS,
    ),
)
def two_group_t(spark, d):
    out = tested(spark, d).select("comparison", "feature", "n1", "n2", "d", "log_fc", "ave", "s2", "t")
    return rounded(out, "log_fc", "ave", "s2", "t")


@query(
    "moderated_t_fixed_prior",
    with_views(
        f"""select comparison, feature, {r6('post')} as s2_post, {r6('d + 4.0::double')} as df_total, {r6('log_fc / sqrt(post * unscaled)')} as t_mod
            from (select *, (4 * 0.8::double + d * coalesce(s2, 0)) / (4 + d) as post from tested)""",
        "meas", **TEST_VIEWS,
    ),
)
def moderated_t_fixed_prior(spark, d):
    out = differential.moderate(tested(spark, d), F.lit(4.0), F.lit(0.8))
    return rounded(out.select("comparison", "feature", "s2_post", "df_total", "t_mod"), "s2_post", "df_total", "t_mod")


def _digamma_sql(x: str) -> str:
    y = f"({x} + 8)"
    shift = " + ".join(f"1 / ({x} + {i})" for i in range(8))
    return f"(ln{y} - 0.5 / {y} - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6)) + 1 / (240 * pow({y}, 8)) - ({shift}))"


def _trigamma_sql(x: str) -> str:
    y = f"({x} + 8)"
    shift = " + ".join(f"1 / pow({x} + {i}, 2)" for i in range(8))
    return f"(1 / {y} + 0.5 / pow({y}, 2) + 1 / (6 * pow({y}, 3)) - 1 / (30 * pow({y}, 5)) + 1 / (42 * pow({y}, 7)) - 1 / (30 * pow({y}, 9)) + ({shift}))"


# Bisection on ln(x): trigamma falls from plus infinity to 0, so sixty halvings of [-25, 25] settle it.
_PRIOR_SQL = {
    "moments": f"""select comparison, avg(e) as mean_e, var_samp(e) - avg({_trigamma_sql('h')}) as excess, sum(d)::double as pooled from (
        select *, ln(s2) - {_digamma_sql('h')} + ln(h) as e from (select comparison, d, s2, d / 2.0::double as h from tested where s2 > 0 and d > 0))
        group by comparison""",
    "halved": f"""with recursive b(comparison, excess, lo, hi, step) as (select comparison, excess, -25.0::double, 25.0::double, 0 from moments where excess > 0
        union all select comparison, excess, case when {_trigamma_sql('exp((lo + hi) / 2)')} > excess then (lo + hi) / 2 else lo end,
          case when {_trigamma_sql('exp((lo + hi) / 2)')} > excess then hi else (lo + hi) / 2 end, step + 1 from b where step < 60)
        select comparison, 2 * exp((lo + hi) / 2) as d0 from b where step = 60""",
    "prior": f"""select m.comparison, pooled, coalesce(d0, 'inf'::double) as d0, case when d0 is null then exp(mean_e)
        else exp(mean_e + {_digamma_sql('(d0 / 2)')} - ln(d0 / 2)) end as s02 from moments m left join halved using (comparison)""",
    "moderated": """select *, log_fc / sqrt(s2_post * unscaled) as t_mod, least(d + d0, pooled) as df_total from (
        select t.*, d0, s02, pooled, case when d0 = 'inf'::double then s02 else (d0 * s02 + d * coalesce(s2, 0)) / (d0 + d) end as s2_post
        from tested t join prior using (comparison))""",
}


@query(
    "moderated_t",
    with_views(
        f"""select comparison, feature, {r6('log_fc')} as log_fc, {r6('t_mod')} as t_mod, {r6('s2_post')} as s2_post, round(df_total, 4) as df_total,
            {r6('p')} as p, {r6('p_adj')} as p_adj from adjusted""",
        "meas", **TEST_VIEWS, **_PRIOR_SQL,
        with_p=f"select *, {t_p_sql('t_mod', 'df_total', 2000)} as p from moderated", adjusted=bh_sql("with_p"),
    ),
)
def moderated_t(spark, d):
    out = differential.moderated_test(tested(spark, d))
    out = out.select("comparison", "feature", "log_fc", "t_mod", "s2_post", F.round("df_total", 4).alias("df_total"), "p", "p_adj")
    return rounded(out, "log_fc", "t_mod", "s2_post", "p", "p_adj")


PAIRED_SQL = """select 'treated' as comparison, *, 1 / sxx as unscaled, case when s2 > 0 then log_fc / sqrt(s2 / sxx) end as t from (
    select *, case when d > 0 then greatest(syy - sxy * log_fc, 0) / d end as s2 from (
      select *, sxy / sxx as log_fc, n - n_blocks - 1 as d from (
        select feature, count(*) as n, count(distinct block) as n_blocks, sum(x * x) as sxx, sum(x * y) as sxy, sum(y * y) as syy from (
          select feature, block, x0 - avg(x0) over w as x, value - avg(value) over w as y from {rows} window w as (partition by feature, block))
        group by feature) where sxx > 1e-12))"""
MODERATED_SQL = f"""{r6('log_fc')} as log_fc, {r6('s2')} as s2, {r6('t')} as t, {r6('s2_post')} as s2_post, {r6('t_mod')} as t_mod,
    round(df_total, 4) as df_total, {r6('p')} as p, {r6('p_adj')} as p_adj from adjusted"""
MODERATED_VIEWS = {
    **_PRIOR_SQL, "with_p": f"select *, {t_p_sql('t_mod', 'df_total', 2000)} as p from moderated", "adjusted": bh_sql("with_p"),
}
MODERATED = ["log_fc", "s2", "t", "s2_post", "t_mod", "df_total", "p", "p_adj"]


def moderated_columns(tests, *keys):
    out = tests.select(*keys, *[c for c in MODERATED if c != "df_total"], F.round("df_total", 4).alias("df_total"))
    return rounded(out, *[c for c in MODERATED if c != "df_total"])


@query(
    "paired_effect",
    with_views(
        f"select feature, n, n_blocks, d, {MODERATED_SQL}", "course",
        arms="select feature, ligand as block, value, case when treatment <> 'PRE' then 1.0::double else 0 end as x0 from course",
        tested=PAIRED_SQL.format(rows="arms"), **MODERATED_VIEWS,
    ),
)
def paired_effect(spark, d):
    """Features are the users, blocks the kinds of event: both grow with the table."""
    rows = views.course(spark, d).select("feature", F.col("ligand").alias("patient"), "treatment", "value")
    tests = differential.paired_test(rows, F.col("treatment") != "PRE")
    return moderated_columns(differential.moderated_test(tests, None), "feature", "n", "n_blocks", "d")


@query(
    "contrast_effect",
    with_views(
        f"select form, feature, n, d, {MODERATED_SQL}", "meas",
        arms="""select feature, plex as block, avg(value) as value, cast(substr(sample, 2) as integer) % 2 as x0 from meas group by feature, plex, sample""",
        once=PAIRED_SQL.format(rows="arms"),
        tested="select form as comparison, form, * exclude (comparison) from once, (values ('contrast'), ('coefficient')) t(form)",
        **MODERATED_VIEWS,
    ),
)
def contrast_effect(spark, d):
    """One group against another with plexes as blocks, written once as a contrast of two columns and once as a coefficient."""
    nation = table(spark, d, "nation")
    dim = nation.select(
        prefixed("N", "n_nationkey").alias("sample"),
        F.concat(F.lit("G"), (F.col("n_nationkey") % 2).cast("string")).alias("group"),
        prefixed("B", "n_regionkey").alias("block"),
    )
    cells = views.meas(spark, d).groupBy("feature", "sample").agg(F.avg("value").alias("value"))
    forms = {
        "contrast": (linear.study_design(dim, ["group", "block"], intercept=False), linear.difference("group", "G1", "G0")),
        "coefficient": (linear.study_design(dim, ["block", "group"]), {"group:G1": 1.0}),
    }
    fits = [linear.contrast_fits(cells, form, {name: wanted}, collapsed=True) for name, (form, wanted) in forms.items()]
    tests = differential.moderated_test(fits[0].unionByName(fits[1]))
    return moderated_columns(tests.withColumnRenamed("comparison", "form"), "form", "feature", "n", "d")


def _closed_form(t: str, k: str) -> str:
    h = f"atan(abs({t}) / sqrt({k}))"
    odd = f"coalesce(list_sum(list_transform(generate_series(1, ({k} - 1) // 2), lambda j: sqrt(pi()) / 2 * exp(lgamma(j) - lgamma(j + 0.5::double)) * pow(cos({h}), 2 * j - 1))), 0)"
    even = f"list_sum(list_transform(generate_series(0, ({k} - 2) // 2), lambda j: exp(lgamma(j + 0.5::double) - lgamma(j + 1)) / sqrt(pi()) * pow(cos({h}), 2 * j)))"
    return f"1 - case when {k} % 2 = 1 then 2 / pi() * ({h} + sin({h}) * {odd}) else sin({h}) * {even} end"


@query(
    "t_pvalue_int_df",
    f"""select t, k, {r6(_closed_form('t', 'k'))} as p from (select distinct round(l_discount * 80 - 4, 2) as t, l_linenumber * 5 - 4 as k from lineitem)""",
)
def t_pvalue_int_df(spark, d):
    grid = table(spark, d, "lineitem").select(
        F.round(F.col("l_discount") * 80 - 4, 2).alias("t"), (F.col("l_linenumber") * 5 - 4).alias("k")
    ).distinct()
    return rounded(grid.withColumn("p", t_two_sided_p(F.col("t"), F.col("k").cast("double"))), "p")


@query(
    "comparison_matrix",
    with_views(
        "select comparison, side, concat('N', cast(n_nationkey as varchar)) as sample from catalogue join nation on condition = concat('R', cast(n_regionkey as varchar))",
        catalogue=CATALOGUE_SQL,
    ),
)
def comparison_matrix(spark, d):
    return design.comparison_samples(design.comparison_catalogue(spark, COMPARISONS), conditions(spark, d))


EFFECT_SQL = """select patient, feature, avg(case when treatment = 'PRE' then mass end) as mb, avg(case when treatment = 'GILT' then mass end) as ma
    from (select patient, concat('M', cast(visit_day % 3 as varchar)) as feature, treatment, log2(loading_mass) as mass from visits) group by all"""


@query(
    "patient_effect",
    with_views(
        f"select patient, feature, {r6('mb')} as mean_before, {r6('ma')} as mean_after, {r6('ma - mb')} as effect from e where mb is not null and ma is not null",
        "visits", e=EFFECT_SQL,
    ),
)
def patient_effect(spark, d):
    rows = views.visits(spark, d).select(
        "patient", "treatment", F.concat(F.lit("M"), (F.col("visit_day") % 3).cast("string")).alias("feature"), F.log2("loading_mass").alias("value")
    )
    effects = differential.patient_effects(rows, F.col("treatment") == "PRE", F.col("treatment") == "GILT")
    return rounded(effects, "mean_before", "mean_after", "effect")


@query(
    "bh_adjust",
    with_views(f"select comparison, feature, {r6('p')} as p, {r6('p_adj')} as p_adj from adjusted", "meas", **BH_VIEWS),
)
def bh_adjust(spark, d):
    return rounded(adjusted(spark, d).select("comparison", "feature", "p", "p_adj"), "p", "p_adj")


@query(
    "significant_hits",
    with_views(
        f"select comparison, feature, {r6('log_fc')} as log_fc, {r6('p_adj')} as p_adj from adjusted where p_adj < 0.9 and abs(log_fc) > 0.5",
        "meas", **BH_VIEWS,
    ),
)
def significant_hits(spark, d):
    hits = filters.significant(adjusted(spark, d), "p_adj", 0.9, "log_fc", 0.5)
    return rounded(hits.select("comparison", "feature", "log_fc", "p_adj"), "log_fc", "p_adj")


@query("significance_mark", with_views("select comparison, feature, case when p < 0.05 then '*' else '' end as mark from with_p", "meas", **P_VIEWS))
def mark_significance(spark, d):
    return with_p(spark, d).select("comparison", "feature", significance_mark(F.col("p")).alias("mark"))


LABEL_SQL = """select comparison, feature, log_fc, case when log_fc > 0 then 'UpReg' else 'DownReg' end as direction,
    case when p < 0.1 then 'Significant' else 'Non-significant' end as significance from with_p"""


def labelled(spark, d):
    return differential.label_direction(with_p(spark, d), p="p", cutoff=0.1)


@query("label_direction", with_views("select comparison, feature, direction, significance from labels_", "meas", **P_VIEWS, labels_=LABEL_SQL))
def label_direction(spark, d):
    return labelled(spark, d).select("comparison", "feature", "direction", "significance")


FLOW = ["R1_R0", "R2_R0", "R12_R0", "R34_R12"]


@query(
    "direction_flow",
    with_views(
        f"select {', '.join(FLOW)}, count(*) as n from (select feature, "
        + ", ".join(f"coalesce(max(case when comparison = '{c}' then direction end), 'absent') as {c}" for c in FLOW)
        + " from labels_ where significance = 'Significant' group by feature) group by all",
        "meas", **P_VIEWS, labels_=LABEL_SQL,
    ),
)
def direction_flow(spark, d):
    return differential.direction_flow(labelled(spark, d), FLOW)


@query(
    "logfc_histogram",
    with_views("select comparison, significance, cast(floor((log_fc + 5) / 0.25) as bigint) as bin, count(*) as n from labels_ group by all", "meas", **P_VIEWS, labels_=LABEL_SQL),
)
def logfc_histogram(spark, d):
    return aggregate.histogram(labelled(spark, d), ["comparison", "significance"], "log_fc", 0.25, -5.0)


@query(
    "effect_density",
    with_views(
        f"select comparison, significance, i::integer as i, {r6('x')} as x, {r6('coalesce(density, 0)')} as density from grid left join sums using (comparison, significance, i)",
        "meas", **P_VIEWS, labels_=LABEL_SQL,
        stats="""select comparison, significance, count(*) as n, stddev_samp(log_fc) as sd, min(log_fc) as low, max(log_fc) as high,
            (quantile_cont(log_fc, 0.75) - quantile_cont(log_fc, 0.25)) / 1.34 as iq from labels_ group by all""",
        wide="""select *, 0.9::double * case when coalesce(sd, 0) <= 0 then 1 when iq > 0 then least(sd, iq) else sd end * pow(n::double, -0.2) as h from stats""",
        grids="select *, low - 3 * h as start, (high + 3 * h - (low - 3 * h)) / 127 as step from wide",
        grid="select comparison, significance, i, start + i * step as x from grids, range(128) t(i)",
        placed="select comparison, significance, (log_fc - start) / step as at_ from labels_ join grids using (comparison, significance)",
        dealt="""select comparison, significance, j, sum(w) as w from (
            select comparison, significance, least(floor(at_), 126)::integer as j, 1 - (at_ - least(floor(at_), 126)) as w from placed
            union all select comparison, significance, least(floor(at_), 126)::integer + 1, at_ - least(floor(at_), 126) from placed) group by all""",
        sums="""select comparison, significance, g.i, sum(w * exp(-pow((g.i - j) * step / h, 2) / 2) / (sqrt(2 * pi()) * h * n)) as density
            from dealt join grids using (comparison, significance) join grid g using (comparison, significance)
            where abs(g.i - j) <= floor(4 * h / step) group by all""",
    ),
)
def effect_density(spark, d):
    """Density of effects by comparison and significance, the data of a ridge plot."""
    found = aggregate.kernel_density(labelled(spark, d), ["comparison", "significance"], "log_fc")
    return rounded(found, "x", "density")


@query(
    "ranked_features",
    with_views(
        f"""select comparison, feature, {r6('round(log_fc, 9)')} as log_fc, row_number() over (partition by comparison order by round(log_fc, 9) desc, md5(feature), feature) as rank,
            count(*) over (partition by comparison) as n from tested""",
        "meas", **TEST_VIEWS,
    ),
)
def ranked_features(spark, d):
    return rounded(ranked(spark, d), "log_fc")


def ranked(spark, d):
    effects = tested(spark, d).select("comparison", "feature", F.round("log_fc", 9).alias("log_fc"))
    return grouped_rank(effects, "comparison", "log_fc", "feature", total="n")


@query(
    "union_comparisons",
    with_views(
        f"""select 'pooled' as kind, comparison, feature, {r6('log_fc')} as log_fc, d from tested
            union all select 'all_samples', 'overall', feature, {r6('avg(value)')}, null from meas group by feature""",
        "meas", **TEST_VIEWS,
    ),
)
def union_comparisons(spark, d):
    overall = views.meas(spark, d).groupBy("feature").agg(F.avg("value").alias("log_fc"))
    overall = overall.select(F.lit("overall").alias("comparison"), "feature", "log_fc", F.lit(None).cast("long").alias("d"))
    parts = {"pooled": tested(spark, d).select("comparison", "feature", "log_fc", "d"), "all_samples": overall}
    return rounded(joins.union_by_label(parts, "kind"), "log_fc")


SLICE_VIEWS = {
    "cells": CELLS_SQL,
    "meas_n": "select feature, sample, plex, value - median(value) over (partition by sample) as value from cells",
    "catalogue": CATALOGUE_SQL,
    "sided": SIDED_SQL.replace("from meas ", "from meas_n "),
    "tested": TESTED_SQL,
    "with_p": WITH_P_SQL,
    "adjusted": bh_sql("with_p"),
}


@query(
    "entry_slice",
    with_views(
        f"select comparison, feature, {r6('log_fc')} as log_fc, {r6('t')} as t, {r6('p')} as p, {r6('p_adj')} as p_adj from adjusted", "meas", **SLICE_VIEWS
    ),
)
def entry_slice(spark, d):
    """Long table, sample medians out, all comparisons, pooled t, adjusted p."""
    centred = normalize.center_samples(cells(views.meas(spark, d))).withColumn("condition", prefixed("R", "plex"))
    catalogue = design.checked_catalogue(design.comparison_catalogue(spark, COMPARISONS), conditions(spark, d))
    test = differential.pooled_test(differential.comparison_stats(differential.condition_stats(centred, collapsed=True), catalogue))
    test = test.withColumn("p", t_two_sided_p(F.col("t"), F.col("d").cast("double")))
    out = differential.bh_adjust(test, "comparison").select("comparison", "feature", "log_fc", "t", "p", "p_adj")
    return rounded(out, "log_fc", "t", "p", "p_adj")
