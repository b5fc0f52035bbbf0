"""Subnetworks of significant features, their connected components, and what random nodes would give."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from abundix.operators.multivar import beside
from abundix.session import cut_lineage

# edges of one draw that a task takes; edges of the graph that a task holds; conditions that share the bits of a number
MOST_EDGES, HELD_EDGES, BITS = 1 << 22, 1 << 23, 31
_SENT = 1 << 18


def hit_edges(edges: DataFrame, hits: DataFrame, *, condition: str = "condition", feature: str = "feature") -> DataFrame:
    """Edges whose two ends are hits of the same condition, rows (condition, a, b)."""
    marked = hits.select(condition, feature).distinct()
    return edges.join(marked.withColumnRenamed(feature, "a"), "a").join(
        marked.withColumnRenamed(feature, "b"), [condition, "b"]
    ).select(condition, "a", "b")


def linker_nodes(
    edges: DataFrame, hits: DataFrame, *, condition: str = "condition", feature: str = "feature", at_least: int = 2
) -> DataFrame:
    """Nodes that are no hit themselves but touch ``at_least`` hits, with the number of hits."""
    marked = hits.select(condition, feature).distinct()
    directed = edges.select(F.col("a").alias("node"), F.col("b").alias(feature)).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias(feature))
    )
    touched = directed.distinct().join(marked, feature).groupBy(condition, "node").agg(F.count(F.lit(1)).alias("n_hits"))
    return touched.where(F.col("n_hits") >= at_least).join(
        marked.withColumnRenamed(feature, "node"), [condition, "node"], "left_anti"
    )


def node_degrees(edges: DataFrame, condition: str = "condition") -> DataFrame:
    ends = edges.select(condition, F.col("a").alias("node")).unionByName(edges.select(condition, F.col("b").alias("node")))
    return ends.groupBy(condition, "node").agg(F.count(F.lit(1)).alias("degree"))


def connected_components(edges: DataFrame, condition: str = "condition", max_rounds: int = 100) -> DataFrame:
    """Smallest node name of the component per node, rows (condition, node, component).

    Large-star and small-star rounds (Kiveris et al. 2014): every node hands the least name around it to
    its neighbours, which ends after about log rounds, not after the diameter of the graph. Each star is a
    map-side minimum and a join; each round is checkpointed.
    """
    both = [condition, "node"]

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy(*both).agg(F.min("other").alias("__m")).withColumn("__m", F.least("__m", "node"))

    def large_star(e: DataFrame) -> DataFrame:
        pairs = e.select(condition, F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            e.select(condition, F.col("b").alias("node"), F.col("a").alias("other"))
        )
        moved = pairs.where(F.col("other") > F.col("node")).join(least(pairs), both)
        return moved.select(condition, F.col("other").alias("a"), F.col("__m").alias("b")).distinct()

    def small_star(e: DataFrame) -> DataFrame:
        pairs = e.select(
            condition, F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")
        ).where(F.col("node") != F.col("other"))
        joined = pairs.join(least(pairs), both)
        moved = joined.select(condition, F.col("other").alias("a"), F.col("__m").alias("b"))
        own = joined.select(condition, F.col("node").alias("a"), F.col("__m").alias("b"))
        return moved.unionByName(own).where(F.col("a") != F.col("b")).distinct()

    edges = cut_lineage(edges.select(condition, "a", "b").distinct())
    current = edges.where(F.col("a") != F.col("b"))
    nodes = edges.select(condition, F.col("a").alias("node")).unionByName(edges.select(condition, F.col("b").alias("node"))).distinct()
    previous = None
    for _ in range(max_rounds):
        current = cut_lineage(small_star(large_star(current)))
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64(condition, "a", "b").cast("decimal(38,0)"))).first()
        if mark == previous:
            break
        previous = mark
    else:
        raise RuntimeError("components did not settle")
    labels = current.select(condition, F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(labels, both, "left").withColumn("component", F.coalesce("component", "node"))


def degree_bins(edges: DataFrame) -> DataFrame:
    """Nodes of the graph with the power of two that their degree reaches: (node, bin)."""
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    degrees = ends.groupBy("node").agg(F.count(F.lit(1)).alias("__degree"))
    return degrees.select("node", F.floor(F.log2(F.col("__degree").cast("double")) + 1e-9).cast("int").alias("bin"))


def random_hits(nodes: DataFrame, hits: DataFrame, draws: int, *, condition: str = "condition", feature: str = "feature", seed: int = 1) -> DataFrame:
    """Sets of nodes with as many of every bin as the hits have: rows (condition, draw, node).

    ``nodes`` is (node, bin). A draw takes the nodes of a bin with the least hashes of (seed, draw, node); conditions
    share the order of a draw, each takes its own number. Hits that are no node of the graph are left out.
    """
    wanted = wanted_nodes(nodes, hits, condition, feature)
    ranked = drawn_nodes(nodes, wanted, draws, seed)
    return ranked.select("draw", "bin", "node", "__i").join(wanted, "bin").where(F.col("__i") <= F.col("__m")).select(condition, "draw", "node")


def wanted_nodes(nodes: DataFrame, hits: DataFrame, condition: str, feature: str) -> DataFrame:
    """Number ``__m`` of hits per condition and bin."""
    found = hits.select(condition, F.col(feature).alias("node")).distinct().join(nodes, "node")
    return found.groupBy(condition, "bin").agg(F.count(F.lit(1)).alias("__m"))


def drawn_nodes(nodes: DataFrame, wanted: DataFrame, draws: int, seed: int) -> DataFrame:
    """The first nodes of every draw and bin in the order ``__i`` of their hashes, as many as any condition wants.

    Hashes are evenly spread, so nodes above a bound are not sorted. A draw that the bound leaves too few nodes of a bin
    takes all of them.
    """
    sizes = nodes.groupBy("bin").agg(F.count(F.lit(1)).alias("__nodes"))
    most = wanted.groupBy("bin").agg(F.max("__m").alias("__most")).join(sizes, "bin")
    share = (F.col("__most") + 8 * F.sqrt("__most") + 32) / F.col("__nodes")
    bound = F.when(share < 1, F.floor((share - 0.5) * 2.0**64)).otherwise(F.lit((1 << 63) - 1))
    most = cut_lineage(most.select("bin", "__most", bound.cast("long").alias("__bound")))
    mark = F.xxhash64(F.lit(seed), "draw", "node")
    every = F.sequence(F.lit(1), F.lit(draws))
    dealt = nodes.join(most, "bin").withColumn("draw", F.explode(every)).withColumn("__hash", mark)
    columns = [*nodes.columns, "draw", "__hash"]
    near = cut_lineage(dealt.where(F.col("__hash") <= F.col("__bound")).select(columns))
    counts = near.groupBy("draw", "bin").agg(F.count(F.lit(1)).alias("__n"))
    cells = most.withColumn("draw", F.explode(every)).join(counts, ["draw", "bin"], "left")
    short = cut_lineage(cells.where(F.coalesce("__n", F.lit(0)) < F.col("__most")).select("draw", "bin"))
    if not short.isEmpty():
        rest = nodes.join(most, "bin").join(short, "bin").withColumn("__hash", mark).where(F.col("__hash") > F.col("__bound"))
        near = near.unionByName(rest.select(columns))
    order = W.partitionBy("draw", "bin").orderBy("__hash", "node")
    ranked = near.withColumn("__i", F.row_number().over(order)).join(F.broadcast(most), "bin").where(F.col("__i") <= F.col("__most"))
    return ranked.drop("__most", "__bound", "__hash")


def numbered(nodes: DataFrame) -> DataFrame:
    """A checkpointed copy of the rows, with numbers ``__id`` from 0 without gaps."""
    held = cut_lineage(nodes.withColumns({"__part": F.spark_partition_id(), "__k": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = held.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    placed = held.join(starts, "__part").withColumn("__id", (F.col("__start") + F.col("__k")).cast("int"))
    return cut_lineage(placed.drop("__part", "__k", "__n", "__start"))


def component_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Number of components of the edges (a, b), and nodes of the largest."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, least = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        x, y = least[a], least[b]
        if np.array_equal(x, y):
            break
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(least, after := least[least]):
            least = after
    sizes = np.bincount(least)
    return int(np.count_nonzero(sizes)), int(sizes.max(initial=0))


def drawn_edges(edges: DataFrame, marked: DataFrame, n_nodes: int, n_edges: int) -> DataFrame:
    """Edges (a, b) with both ends in a draw: rows (__g, draw, a, b, bits), where bits are those that both ends have.

    ``edges`` has numbers of nodes, ``marked`` is (__g, draw, __id, bits). The edges are dealt to tasks, and every draw goes to
    each of these as one packed row; a task holds its edges by their first node and looks up the neighbours of the drawn
    nodes only. No row is made for an edge with one end in a draw.
    """
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(min(width, 12), -(-n_edges // HELD_EDGES))
    # numbers that a shuffle by them deals to one partition each
    tried = edges.sparkSession.range(64 * parts).select(F.col("id").cast("int").alias("part"))
    deals = F.pmod(F.hash("part"), F.lit(parts))
    slots = [r["part"] for r in tried.groupBy(deals.alias("slot")).agg(F.min("part").alias("part")).orderBy("slot").collect()]

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("__id").to_numpy())
        # steps between numbers are small: their upper bytes, kept apart, take no room once they are compressed
        ids = np.diff(table.column("__id").to_numpy()[order], prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T
        own = table.column("bits").to_numpy()[order].astype(np.int32)
        columns = {"__g": pa.array([key[0].as_py()], pa.int64()), "draw": pa.array([key[1].as_py()], pa.int32())}
        return pa.table({**columns, "ids": pa.array([ids.tobytes()], pa.binary()), "bits": pa.array([own.tobytes()], pa.binary())})

    lists = marked.groupBy("__g", "draw").applyInArrow(pack, "__g long, draw int, ids binary, bits binary")
    lists = lists.select(
        F.explode(F.array(*map(F.lit, slots))).alias("part"), F.lit(1).alias("kind"), "__g", "draw", F.lit(0).alias("a"), F.lit(0).alias("b"), "ids", "bits"
    )
    held = edges.select(
        F.element_at(F.array(*map(F.lit, slots)), F.pmod(F.hash("a"), F.lit(len(slots))) + 1).alias("part"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("__g"),
        F.lit(0).alias("draw"), "a", "b", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("bits"),
    )
    work = held.unionByName(lists).repartition(parts, "part").sortWithinPartitions("part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, starts, ends, flags, found = None, [], None, np.zeros(n_nodes, dtype=np.int32), []

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(x)) for x in zip(*found)]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, names=["__g", "draw", "a", "b", "bits"])

        for batch in batches:
            part, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            group, draw = batch.column("__g").to_numpy(), batch.column("draw").to_numpy()
            cuts = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0)).tolist()
            for low, high in zip(cuts, [*cuts[1:], len(part)]):
                if part[low] != here:
                    here, starts, ends = part[low], [], None
                if not kind[low]:
                    rows = batch.slice(low, high - low)
                    starts.append((rows.column("a").to_numpy(), rows.column("b").to_numpy()))
                    continue
                if ends is None:
                    a, b = (np.concatenate(x) for x in zip(*starts)) if starts else (np.zeros(0, np.int32), np.zeros(0, np.int32))
                    ends, starts = b[np.argsort(a, kind="stable")], []
                    first = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n_nodes))])
                for i in range(low, high):
                    steps = np.frombuffer(batch.column("ids")[i].as_buffer(), dtype=np.uint8).reshape(4, -1).T
                    ids = np.cumsum(np.ascontiguousarray(steps).view("<i4")[:, 0], dtype=np.int32)
                    own = np.frombuffer(batch.column("bits")[i].as_buffer(), dtype=np.int32)
                    flags[ids] = own
                    begin = first[ids]
                    counts = first[ids + 1] - begin
                    some = np.flatnonzero(counts)
                    source = np.repeat(some, counts[some])
                    at = np.arange(len(source)) + (begin - np.cumsum(counts) + counts)[source]
                    other = ends[at]
                    both = flags[other] & own[source]
                    good = np.flatnonzero(both)
                    flags[ids] = 0
                    found.append((np.full(len(good), group[i]), np.full(len(good), draw[i]), ids[source[good]], other[good], both[good].astype(np.int64)))
                    if sum(len(x[0]) for x in found[-64:]) > _SENT or len(found) >= 64:
                        yield flushed()
        if found:
            yield flushed()

    return work.mapInArrow(run, "__g long, draw int, a int, b int, bits long")


def drawn_sizes(edges: DataFrame, nodes: DataFrame, wanted: DataFrame, draws: int, condition: str, seed: int) -> DataFrame:
    """``component_sizes`` of the edges inside the random nodes of every condition and draw.

    ``nodes`` is numbered. Conditions are bits, so they share draws. A draw with no more than ``MOST_EDGES`` edges is solved
    inside a task; larger ones take the rounds of ``connected_components``.
    """
    order = W.orderBy(condition)
    named = wanted.where(F.col(condition).isNotNull()).select(condition).distinct().withColumn("__c", F.row_number().over(order) - 1)
    named = cut_lineage(named.select(condition, F.floor(F.col("__c") / BITS).alias("__g"), (F.col("__c") % BITS).alias("__bit")))
    limits = wanted.join(named, condition).groupBy("bin", "__g").agg(F.collect_list(F.struct("__m", "__bit")).alias("__limits"))
    ranked = drawn_nodes(nodes, wanted, draws, seed).join(limits, "bin")
    bits = F.expr("aggregate(__limits, 0L, (s, x) -> s + if(x.__m >= __i, shiftleft(1L, cast(x.__bit as int)), 0L))")
    marked = ranked.select("__g", "draw", "__id", bits.alias("bits")).where("bits <> 0")
    numbers = nodes.select("node", "__id")
    ends = edges.join(numbers.toDF("a", "__a"), "a").join(numbers.toDF("b", "__b"), "b").select(F.col("__a").alias("a"), F.col("__b").alias("b"))
    inside = cut_lineage(drawn_edges(ends, marked, nodes.count(), edges.count()))
    counts = inside.groupBy("__g", "draw").agg(F.count(F.lit(1)).alias("__n"))
    large = cut_lineage(counts.where(F.col("__n") > MOST_EDGES).select("__g", "draw"))
    some = not large.isEmpty()
    small = inside.join(large, ["__g", "draw"], "left_anti") if some else inside

    def solve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a, b, bits = (table.column(c).to_numpy() for c in ("a", "b", "bits"))
        found = []
        for bit in range(BITS):
            own = (bits >> bit & 1).astype(bool)
            if own.any():
                found.append((key[0].as_py(), key[1].as_py(), bit, *component_counts(a[own], b[own]), int(own.sum())))
        kinds = {"__g": "int64", "draw": "int32", "__bit": "int32", "n_components": "int64", "largest": "int64", "n_edges": "int64"}
        return pa.table({k: pa.array(v, k_type) for (k, k_type), v in zip(kinds.items(), zip(*found))})

    solved = small.groupBy("__g", "draw").applyInArrow(solve, "__g long, draw int, __bit int, n_components long, largest long, n_edges long")
    columns = [condition, "draw", "n_components", "largest", "n_edges"]
    sizes = solved.join(named, ["__g", "__bit"]).select(columns)
    if some:
        rest = inside.join(large, ["__g", "draw"]).join(named, "__g").where("shiftright(bits, cast(__bit as int)) & 1 = 1")
        rest = rest.select(condition, "draw", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
        sizes = sizes.unionByName(component_sizes(rest, [condition, "draw"]).select(columns))
    return sizes


def component_sizes(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: ``n_components`` with an edge, nodes of the ``largest``, and ``n_edges``; keys without an edge have no row."""
    one = edges.withColumn("__key", F.to_json(F.struct(*keys)))
    sizes = connected_components(one, "__key").groupBy("__key", "component").agg(F.count(F.lit(1)).alias("__size"))
    counted = sizes.groupBy("__key").agg(F.count(F.lit(1)).alias("n_components"), F.max("__size").alias("largest"))
    named = one.groupBy("__key", *keys).agg(F.count(F.lit(1)).alias("n_edges"))
    return named.join(counted, "__key").select(*keys, "n_components", "largest", "n_edges")


def component_null(
    edges: DataFrame, hits: DataFrame, *, draws: int = 1000, condition: str = "condition", feature: str = "feature", seed: int = 1
) -> DataFrame:
    """How the hits of each condition hang together, against as many random nodes of like degrees.

    Number of components, size of the largest and number of edges among the hits, their means over the draws, and p of
    a largest component (``p_largest``) and of a number of edges (``p_edges``) that are as large or larger:
    (1 + draws beyond) / (1 + draws). All draws are rows of one job; hits without any edge between them have zeros.
    """
    edges = cut_lineage(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    nodes = numbered(degree_bins(edges))
    near = edges.join(beside(hits.select(F.col(feature).alias("a")).distinct(), 1 << 18), "a", "left_semi")
    found = component_sizes(hit_edges(near, hits, condition=condition, feature=feature), [condition])
    listed = hits.select(condition).distinct()
    found = listed.join(found, condition, "left").na.fill(0, ["n_components", "largest", "n_edges"])
    wanted = cut_lineage(wanted_nodes(nodes, hits, condition, feature))
    null = drawn_sizes(edges, nodes, wanted, draws, condition, seed)
    named = null.select(condition, *[F.col(c).alias(f"__{c}") for c in ("n_components", "largest", "n_edges")])
    beyond = lambda c: F.count_if((F.col(f"__{c}") >= F.col(c)) & (F.col(c) > 0))
    joined = cut_lineage(found).join(named, condition, "left").groupBy(condition, "n_components", "largest", "n_edges")
    sums = joined.agg(
        *[(F.coalesce(F.sum(f"__{c}"), F.lit(0)) / draws).alias(f"mean_{c}") for c in ("n_components", "largest", "n_edges")],
        beyond("largest").alias("__l"),
        beyond("n_edges").alias("__e"),
    )
    # every draw is as large as nothing
    p = lambda c, n: F.when(F.col(n) > 0, (1 + F.col(c)) / F.lit(1.0 + draws)).otherwise(F.lit(1.0))
    return sums.withColumn("p_largest", p("__l", "largest")).withColumn("p_edges", p("__e", "n_edges")).drop("__l", "__e")
