"""Queries on cross-products, components, clusters, distances and networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from abundix.operators import aggregate, multivar, network, principal, reshape
from abundix.plans import views
from abundix.plans.registry import prefixed, query, r6, rounded
from abundix.plans.shaping import DENSE_CELLS_SQL, VARIANCE_SQL
from abundix.plans.statistics import P_VIEWS, with_p
from abundix.plans.views import SAMPLES, table, with_views
from abundix.session import cut_lineage

POSITIONS = [str(i) for i in range(64)]
MATRIX_SQL = """select vec_id as feature, generate_subscripts(embedding, 1) - 1 as sample, cast(unnest(embedding) as double) as value from embeddings"""


def matrix(spark, d):
    """Embeddings as a long table: feature = vector, sample = position."""
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    return rows.select(F.col("vec_id").alias("feature"), F.col("pos").cast("string").alias("sample"), F.col("value").cast("double").alias("value"))


def packed(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("feature"), F.col("embedding").cast("array<double>").alias("vec"))


@query(
    "gram_matrix",
    with_views(
        f"""select cast(x.sample as varchar) as a, cast(y.sample as varchar) as b, {r6('sum(x.c * y.c)')} as product from centred x
            join centred y on x.feature = y.feature group by all""",
        matrix=MATRIX_SQL, centred="select feature, sample, value - avg(value) over (partition by feature) as c from matrix",
    ),
)
def gram_matrix(spark, d):
    return rounded(multivar.gram_matrix(matrix(spark, d), POSITIONS), "product")


def _leading_sql(matrix: str, name: str, squarings: int = 24) -> dict[str, str]:
    """Leading eigenvector of a matrix (i, j, v): squared again and again, it becomes that of its vector alone."""
    steps = {f"{name}0": f"select i, j, v / sqrt(sum(v * v) over ()) as v from {matrix}"}
    for k in range(squarings):
        steps[f"{name}{k + 1}"] = f"""select i, j, v / sqrt(sum(v * v) over ()) as v from (
            select x.i, y.j, sum(x.v * y.v) as v from {name}{k} x join {name}{k} y on x.j = y.i group by all)"""
    last = f"{name}{squarings}"
    steps[f"{name}_raw"] = f"""select i, v / sqrt((select max(v) from {last} where i = j)) as x from {last}
        where j = (select j from {last} where i = j order by v desc limit 1)"""
    steps[f"{name}_vector"] = f"select i, x / sqrt(sum(x * x) over ()) as x from {name}_raw"
    steps[f"{name}_value"] = f"select sum(a.v * p.x * q.x) as l from {matrix} a join {name}_vector p on a.i = p.i join {name}_vector q on a.j = q.i"
    return steps


PCA_VIEWS = {
    "matrix": MATRIX_SQL,
    "centred": "select feature, sample, value - avg(value) over (partition by feature) as c from matrix",
    "products": "select x.sample as i, y.sample as j, sum(x.c * y.c) as v from centred x join centred y on x.feature = y.feature group by all",
    **_leading_sql("products", "first"),
    "deflated": "select a.i, a.j, v - l * p.x * q.x as v from products a join first_vector p on a.i = p.i join first_vector q on a.j = q.i, first_value",
    **_leading_sql("deflated", "second"),
    "raw": """select i, 1 as component, x * sqrt(l) as s, l from first_vector, first_value
        union all select i, 2, x * sqrt(l), l from second_vector, second_value""",
    "signed": "select *, sign(arg_max(s, abs(s)) over (partition by component)) as way from raw",
}


@query(
    "pca_scores",
    with_views(
        f"""select cast(i as varchar) as sample, component, {r6('s * way')} as score, {r6('l / (select sum(v) from products where i = j)')} as share from signed""",
        **PCA_VIEWS,
    ),
)
def pca_scores(spark, d):
    return rounded(principal.component_scores(matrix(spark, d), 2), "score", "share")


@query(
    "pca_distances",
    with_views(
        """select cast(x.sample as varchar) as a, cast(y.sample as varchar) as b, round(sqrt(sum((x.c - y.c) * (x.c - y.c))), 5) as distance from centred x
           join centred y on x.feature = y.feature and x.sample < y.sample group by all""",
        matrix=MATRIX_SQL, centred="select feature, sample, value - avg(value) over (partition by feature) as c from matrix",
    ),
)
def pca_distances(spark, d):
    """Distances between samples in the space of all components equal those between their centred columns."""
    scores = principal.component_scores(matrix(spark, d), len(POSITIONS))
    moments = multivar.pair_moments(scores, POSITIONS, row="component", column="sample", value="score", about="row")
    ordered = multivar.euclidean_distance(moments)
    return ordered.select("a", "b", F.round("distance", 5).alias("distance"))


@query("kmeans_assign")
def kmeans_assign(spark, d):
    return multivar.kmeans_clusters(packed(spark, d), KS)


@query(
    "nearest_centroid",
    with_views(
        f"""select feature, cluster, {r6('distance')} as distance from (
              select feature, cluster, distance, row_number() over (partition by feature order by distance, cluster) as rn from (
                select m.feature, c.label::bigint as cluster, sum((m.value - c.value) * (m.value - c.value)) as distance from matrix m
                join centres c on m.sample = c.sample group by all)) where rn = 1""",
        matrix=MATRIX_SQL,
        centres="select label, sample, avg(value) as value from matrix join embeddings on feature = vec_id group by all",
    ),
)
def nearest_centroid(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "value"))
    means = rows.groupBy("label", "pos").agg(F.avg(F.col("value").cast("double")).alias("value"))
    pairs = F.array_sort(F.collect_list(F.struct("pos", "value")))
    centres = means.groupBy("label").agg(F.transform(pairs, lambda p: p["value"]).alias("centre")).withColumnRenamed("label", "cluster")
    return rounded(multivar.nearest_centroid(packed(spark, d), centres), "distance")


KS = range(3, 13)


def _kmeans_sql(steps: int = 40) -> dict[str, str]:
    """Lloyd's steps of every K from given starts; settled centres stay as they are."""
    out = {
        "rows_": "select vec_id as feature, list_transform(embedding, lambda x: x::double) as x from embeddings where embedding is not null",
        "starts": f"select feature, x, row_number() over (order by md5(concat('s', cast(feature as varchar))), feature) as e from rows_ qualify e <= {max(KS)}",
        "centres0": f"select k, e, x as c from starts, range({min(KS)}, {max(KS) + 1}) t(k) where e <= k",
    }
    near = """select k, feature, any_value(x) as x, arg_min(e, {{'d': d, 'e': e}}) as e from (
        select k, feature, x, e, list_distance(x, c) as d from rows_, centres{i}) group by k, feature"""
    for i in range(steps):
        out[f"near{i}"] = near.format(i=i)
        out[f"means{i}"] = f"""select k, e, list(m order by j) as c from (
            select k, e, j, avg(x[j]) as m from near{i}, range(1, 65) t(j) group by k, e, j) group by k, e"""
        out[f"centres{i + 1}"] = f"select b.k, b.e, coalesce(m.c, b.c) as c from centres{i} b left join means{i} m using (k, e)"
    out["last"] = near.format(i=steps)
    out["numbered"] = f"select k, e, row_number() over (partition by k order by c) as cluster from centres{steps}"
    out["clusters"] = "select k, feature, cluster from last join numbered using (k, e)"
    return out


KMEANS_VIEWS = _kmeans_sql()


def clusters_from_starts(spark, d):
    """Clusters of every K from one start that SQL can repeat: the vectors with the least md5."""
    rows = packed(spark, d).where(F.col("vec").isNotNull())
    digest = F.md5(F.concat(F.lit("s"), F.col("feature").cast("string")).cast("binary"))
    starts = [r["feature"] for r in rows.select("feature", digest.alias("md5")).orderBy("md5", "feature").limit(max(KS)).collect()]
    return multivar.kmeans_clusters(rows, KS, starts=starts)


@query("kmeans_from_starts", with_views("select k, feature, cluster from clusters", **KMEANS_VIEWS))
def kmeans_from_starts(spark, d):
    return clusters_from_starts(spark, d)


@query(
    "targeted_by_cluster",
    with_views(
        """select k, cluster, count(*) as size, string_agg(v, '; ' order by v) as members from (
             select distinct k, cluster, concat('V', cast(feature as varchar)) as v from clusters where feature in (select doc_id from labels where quality = 1))
           group by k, cluster""",
        **KMEANS_VIEWS,
    ),
)
def targeted_by_cluster(spark, d):
    """Where the listed rows lie, for every K."""
    listed = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("feature"))
    members = clusters_from_starts(spark, d).join(listed, "feature", "left_semi")
    return reshape.collapse_members(members.select("k", "cluster", prefixed("V", "feature").alias("v")), ["k", "cluster"], "v")


@query(
    "corr_distance",
    with_views(
        f"""select a, b, n, case when n >= 3 and va > 1e-9 and vb > 1e-9 then {r6('1 - r')} end as distance from (
              select x.sample as a, y.sample as b, count(*) as n, corr(x.value, y.value) as r, var_pop(x.value) * count(*) as va, var_pop(y.value) * count(*) as vb
              from dense x join dense y on x.feature = y.feature and x.k < y.k group by all)""",
        "meas",
        dense="select feature, sample, cast(substr(sample, 2) as int) as k, avg(value) as value from meas group by all",
    ),
)
def corr_distance(spark, d):
    """Between samples, over the features that both have."""
    moments = multivar.pair_moments(views.meas(spark, d), SAMPLES)
    return rounded(multivar.correlation_distance(moments), "distance")


@query(
    "euclid_distance",
    with_views(
        f"""select x.feature as a, y.feature as b, count(*) as n, {r6('sqrt(sum((x.value - y.value) * (x.value - y.value)))')} as distance
            from picked x join picked y on x.sample = y.sample and x.feature < y.feature group by all""",
        "meas_dense", dense=DENSE_CELLS_SQL, spread=VARIANCE_SQL,
        picked="select * from dense where feature in (select feature from spread order by spread.variance desc, feature limit 150)",
    ),
)
def euclid_distance(spark, d):
    """Between the most variable features; their names, 150 at most, are the axis."""
    rows = views.meas_dense(spark, d)
    names = sorted(row["feature"] for row in aggregate.top_variable(rows, 150).collect())
    picked = rows.where(F.col("feature").isin(names))
    moments = multivar.pair_moments(picked, names, row="sample", column="feature", about="row")
    return rounded(multivar.euclidean_distance(moments), "distance")


# --- networks --------------------------------------------------------------------------------------------

HITS_SQL = "select comparison as condition, feature from with_p where p < 0.2"
SUBNET_SQL = """select h.condition, a, b from edges join hits h on a = h.feature join hits g on b = g.feature and g.condition = h.condition"""


def hits(spark, d):
    return with_p(spark, d).where("p < 0.2").select(F.col("comparison").alias("condition"), "feature")


@query("signif_subnetwork", with_views("select condition, a, b from subnet", "meas", "edges", **P_VIEWS, hits=HITS_SQL, subnet=SUBNET_SQL))
def signif_subnetwork(spark, d):
    return network.hit_edges(views.edges(spark, d), hits(spark, d))


@query(
    "subnetwork_nodes",
    with_views(
        "select condition, node, count(*) as degree from (select condition, a as node from subnet union all select condition, b from subnet) group by all",
        "meas", "edges", **P_VIEWS, hits=HITS_SQL, subnet=SUBNET_SQL,
    ),
)
def subnetwork_nodes(spark, d):
    return network.node_degrees(network.hit_edges(views.edges(spark, d), hits(spark, d)))


@query(
    "linker_nodes",
    with_views(
        """select condition, node, count(distinct feature) as n_hits from (select a as node, b as feature from edges union all select b, a from edges)
           join hits using (feature) where (condition, node) not in (select condition, feature from hits) group by all having count(distinct feature) >= 2""",
        "meas", "edges", **P_VIEWS, hits=HITS_SQL,
    ),
)
def linker_nodes(spark, d):
    return network.linker_nodes(views.edges(spark, d), hits(spark, d))


SPARSE_HITS_SQL = "select comparison as condition, feature from with_p where p < 0.02"


@query(
    "components",
    with_views(
        "select condition, node, min(other) as component from walk group by all",
        "meas", "edges", **P_VIEWS, hits=SPARSE_HITS_SQL, subnet=SUBNET_SQL,
        arcs="select condition, a as node, b as other from subnet union select condition, b, a from subnet",
        walk="""with recursive w(condition, node, other) as (select condition, node, node from arcs
            union select w.condition, w.node, arcs.other from w join arcs on arcs.condition = w.condition and arcs.node = w.other) select * from w""",
    ),
)
def components(spark, d):
    strict = with_p(spark, d).where("p < 0.02").select(F.col("comparison").alias("condition"), "feature")
    return network.connected_components(network.hit_edges(views.edges(spark, d), strict))


@query("component_null")
def component_null(spark, d):
    """The same subnetworks against 1,000 sets of nodes with like degrees."""
    strict = with_p(spark, d).where("p < 0.02").select(F.col("comparison").alias("condition"), "feature")
    return network.component_null(views.edges(spark, d), cut_lineage(strict), draws=1000)
