"""Random hit sets against enumeration on a small graph."""

import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from abundix.operators import network

# a clique of four, a path, and single edges
EDGES = [*itertools.combinations("ABCD", 2), ("E", "F"), ("F", "G"), ("G", "H"), ("I", "J"), ("K", "L"), ("D", "E")]


def largest(chosen):
    seen, best = set(), 0
    for start in chosen:
        if start in seen:
            continue
        todo, own = [start], {start}
        while todo:
            node = todo.pop()
            for a, b in EDGES:
                for x, y in ((a, b), (b, a)):
                    if x == node and y in chosen and y not in own:
                        own.add(y)
                        todo.append(y)
        seen |= own
        best = max(best, len(own) if len(own) > 1 else 0)
    return best


def bins():
    degree = Counter(x for e in EDGES for x in e)
    out = {}
    for node, n in degree.items():
        out.setdefault(n.bit_length() - 1, []).append(node)
    return out, {node: n.bit_length() - 1 for node, n in degree.items()}


@pytest.fixture(scope="module")
def graph(spark):
    edges = spark.createDataFrame(EDGES + [("A", "B"), ("A", "A")], "a string, b string")
    hits = {"tight": ["A", "B", "C", "E", "F"], "loose": ["A", "G", "I", "L"], "none": ["I", "K", "gone"]}
    rows = [(c, n) for c, own in hits.items() for n in own] + [("tight", "A")]
    return edges, spark.createDataFrame(rows, "condition string, feature string"), hits


def test_draws_keep_degree_bins(spark, graph):
    edges, hits, named = graph
    of_bin, bin_of = bins()
    clean = edges.where("a <> b").distinct()
    drawn = network.random_hits(network.degree_bins(clean), hits, 300).collect()
    for condition, own in named.items():
        wanted = Counter(bin_of[n] for n in own if n in bin_of)
        sets = {}
        for r in drawn:
            if r["condition"] == condition:
                sets.setdefault(r["draw"], []).append(r["node"])
        assert len(sets) == 300
        for chosen in sets.values():
            assert len(set(chosen)) == len(chosen) and Counter(bin_of[n] for n in chosen) == wanted
    again = network.random_hits(network.degree_bins(clean.repartition(5)), hits, 300).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, drawn))


def test_p_against_enumeration(graph):
    edges, hits, named = graph
    of_bin, bin_of = bins()
    got = {r["condition"]: r for r in network.component_null(edges, hits, draws=1500).collect()}
    for condition, own in named.items():
        own = [n for n in own if n in bin_of]
        wanted = Counter(bin_of[n] for n in own)
        choices = [list(itertools.combinations(of_bin[b], m)) for b, m in wanted.items()]
        sizes = [largest({n for part in parts for n in part}) for parts in itertools.product(*choices)]
        r, mine = got[condition], largest(set(own))
        assert r["largest"] == mine
        exact = sum(s >= mine for s in sizes) / len(sizes) if mine else 1.0
        assert r["p_largest"] == pytest.approx(exact, abs=0.05)
        assert r["mean_largest"] == pytest.approx(sum(sizes) / len(sizes), abs=0.15)
    assert got["none"]["n_edges"] == 0 and got["none"]["p_edges"] == 1.0


def test_no_hits(spark, graph):
    edges, hits, _ = graph
    assert network.component_null(edges, hits.where(F.lit(False)), draws=5).collect() == []


def by_key(df):
    return sorted((r["condition"], r["draw"], r["n_components"], r["largest"], r["n_edges"]) for r in df.collect())


@pytest.mark.parametrize("most_edges, bits", [(1 << 22, 32), (5, 2)])
def test_draws_against_rounds(spark, graph, monkeypatch, most_edges, bits):
    """Components of draws that tasks solve, or that are too large for one, are those of the edges between drawn nodes."""
    edges, hits, _ = graph
    clean = edges.where("a <> b").distinct().unionByName(spark.createDataFrame([("B", "A")], "a string, b string"))
    nodes = network.numbered(network.degree_bins(clean))
    assert sorted(r["__id"] for r in nodes.collect()) == list(range(12))
    drawn = network.random_hits(nodes, hits, 40)
    inside = clean.join(drawn.withColumnRenamed("node", "a"), "a").join(drawn.withColumnRenamed("node", "b"), ["condition", "draw", "b"])
    slow = by_key(network.component_sizes(inside.select("condition", "draw", "a", "b"), ["condition", "draw"]))
    monkeypatch.setattr(network, "MOST_EDGES", most_edges)
    monkeypatch.setattr(network, "BITS", bits)
    wanted = network.wanted_nodes(nodes, hits, "condition", "feature")
    assert by_key(network.drawn_sizes(clean, nodes, wanted, 40, "condition", 1)) == slow and len(slow) > 40


def test_draws_take_no_rounds(graph, monkeypatch):
    edges, hits, _ = graph
    calls, rounds = [], network.connected_components
    monkeypatch.setattr(network, "connected_components", lambda *a, **b: calls.append(a) or rounds(*a, **b))
    assert network.component_null(edges, hits, draws=30).count() == 3
    assert len(calls) == 1  # of the hits


def test_first_nodes_of_large_bins(spark):
    """Nodes beyond the bound of the hashes are not needed, and the first ones are the first of all."""
    nodes = spark.range(4000).selectExpr("concat('n', id) as node", "cast(id % 2 as int) as bin")
    wanted = spark.createDataFrame([("x", 0, 3), ("y", 0, 40), ("y", 1, 2000)], "condition string, bin int, __m long")
    got = {(r["draw"], r["bin"], r["node"], r["__i"]) for r in network.drawn_nodes(nodes, wanted, 7, 5).collect()}
    marked = nodes.crossJoin(spark.range(1, 8).selectExpr("cast(id as int) as draw")).withColumn("h", F.xxhash64(F.lit(5), "draw", "node")).collect()
    expected = set()
    for draw in range(1, 8):
        for b, most in ((0, 40), (1, 2000)):
            own = sorted((r["h"], r["node"]) for r in marked if r["draw"] == draw and r["bin"] == b)[:most]
            expected |= {(draw, b, node, i + 1) for i, (_, node) in enumerate(own)}
    assert got == expected


def test_component_counts():
    import numpy as np

    path = np.arange(5000)
    shuffled = np.random.default_rng(1).permutation(6000)
    assert network.component_counts(shuffled[path], shuffled[path + 1]) == (1, 5001)
    assert network.component_counts(np.array([1, 7, 7, 1]), np.array([2, 8, 9, 2])) == (2, 3)
