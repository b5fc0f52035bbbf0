"""Running totals, ranks and quantiles against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from abundix.functions.numeric import order_cell
from abundix.operators import ordered
from abundix.operators.differential import bh_adjust
from abundix.operators.identify import target_decoy_q


def values(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice("abc"), f"f{i}", rng.choice([0.0, -1.5, 2.5, rng.gauss(0, 3), rng.gauss(0, 1e-6), rng.gauss(0, 1e9)])) for i in range(n)]


def test_cells_never_fall(spark):
    rng = np.random.default_rng(1)
    numbers = np.concatenate([rng.normal(size=2000) * 10.0 ** rng.integers(-30, 30, 2000), [0.0, -0.0, 1e308, -1e308, 5e-324]])
    rows = spark.createDataFrame([(float(v),) for v in numbers], "v double").select("v", order_cell(F.col("v")).alias("c")).collect()
    ranked = sorted((r["v"], r["c"]) for r in rows)
    assert all(a[1] <= b[1] for a, b in zip(ranked, ranked[1:]))


def test_scan(spark):
    rows = sorted({(g, round(v, 3)) for g, _, v in values(2)})
    df = spark.createDataFrame([(g, v, i % 7) for i, (g, v) in enumerate(rows)], "g string, v double, w long")
    for descending in (False, True):
        out = ordered.prefix_scan(
            ordered.cut_ranges(df, "g", "v"), "g", "v", {"s": ("sum", F.col("w")), "lo": ("min", F.col("w")), "hi": ("max", F.col("w"))},
            descending=descending,
        ).collect()
        for group in "abc":
            mine = sorted((r for r in out if r["g"] == group), key=lambda r: -r["v"] if descending else r["v"])
            w = [r["w"] for r in mine]
            assert [r["s"] for r in mine] == list(np.cumsum(w))
            assert [r["lo"] for r in mine] == list(np.minimum.accumulate(w))
            assert [r["hi"] for r in mine] == list(np.maximum.accumulate(w))
            assert {r["s_total"] for r in mine} == {sum(w)}


def test_rank_with_heavy_ties(spark):
    rows = values(3)
    df = spark.createDataFrame(rows + [("a", "missing", None), ("a", "nan", float("nan"))], "g string, f string, v double")
    out = ordered.grouped_rank(df, "g", "v", "f", total="n").collect()
    assert len(out) == len(rows)
    for group in "abc":
        expected = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[2], hashlib.md5(r[1].encode()).hexdigest(), r[1]))
        mine = sorted((r for r in out if r["g"] == group), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(expected) + 1))
        assert [r["f"] for r in mine] == [e[1] for e in expected]
        assert {r["n"] for r in mine} == {len(expected)}


def test_quantiles(spark):
    rows = values(4) + [("one", "x", 5.0), ("two", "x", 1.0), ("two", "y", 2.0)]
    df = spark.createDataFrame(rows + [("a", "none", None), ("b", "nan", float("nan"))], "g string, f string, v double")
    probs = {"min": 0.0, "q1": 0.25, "median": 0.5, "p90": 0.9, "max": 1.0}
    for r in ordered.grouped_quantiles(df, "g", "v", probs, count="n").collect():
        mine = [v for g, _, v in rows if g == r["g"]]
        assert r["n"] == len(mine)
        assert np.allclose([r[k] for k in probs], np.quantile(mine, list(probs.values())), rtol=1e-9, atol=1e-12)


def test_quantiles_without_key(spark):
    df = spark.createDataFrame([(float(v),) for v in range(10)], "v double")
    assert ordered.grouped_median(df, None, "v").first()["median"] == 4.5


def brute_bh(p):
    order = sorted(range(len(p)), key=lambda i: p[i])
    out, running = [0.0] * len(p), 1.0
    for place in range(len(p), 0, -1):
        running = min(running, p[order[place - 1]] * len(p) / place)
        out[order[place - 1]] = running
    return out


def test_bh(spark):
    rng = random.Random(5)
    p = [rng.choice([1.0, 0.03, rng.random(), rng.random() ** 6, 0.0]) for _ in range(300)]
    df = spark.createDataFrame([(i, "c", v) for i, v in enumerate(p)] + [(-1, "c", None), (-2, "c", float("nan"))], "i long, c string, p double")
    got = {r["i"]: r["p_adj"] for r in bh_adjust(df, "c").collect()}
    assert got.pop(-1) is None and got.pop(-2) is None
    assert np.allclose([got[i] for i in range(len(p))], brute_bh(p))
    assert all(got[i] >= p[i] for i in range(len(p)))


def test_target_decoy(spark):
    rng = random.Random(6)
    rows = [(i, round(rng.gauss(0, 1), 1), rng.random() < 0.3) for i in range(300)] + [(999, 50.0, True)]
    df = spark.createDataFrame(rows, "i long, score double, is_decoy boolean")
    got = {r["i"]: r["q_value"] for r in target_decoy_q(df).collect()}

    def rate(cut):
        decoys = sum(1 for _, s, d in rows if s >= cut and d)
        targets = sum(1 for _, s, d in rows if s >= cut and not d)
        return decoys / targets if targets else float("inf")

    for i, score, _ in rows:
        assert got[i] == pytest.approx(min(rate(cut) for _, cut, _ in rows if cut <= score))


@pytest.mark.parametrize("partitions", ["1", "4", "50"])
def test_partitioning_does_not_matter(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(values(7), "g string, f string, v double").repartition(int(partitions))
        out = sorted((r["g"], r["rank"], r["f"]) for r in ordered.grouped_rank(df, "g", "v", "f").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = sorted(
        (g, i + 1, f)
        for g in "abc"
        for i, (_, f, _) in enumerate(sorted((r for r in values(7) if r[0] == g), key=lambda r: (-r[2], hashlib.md5(r[1].encode()).hexdigest())))
    )
    assert out == expected


@pytest.mark.parametrize("start", [1.7e9, 1e-300, -5.0])
def test_ranges_split_what_stands_close_together(spark, start):
    """One group of 40,000 values that differ only in their last digits must not end in one range."""
    df = spark.range(40_000).select(F.lit("g").alias("g"), (F.lit(start) * (1 + F.col("id") * 1e-9)).alias("v"))
    sizes = [r["count"] for r in ordered.cut_ranges(df, "g", "v").groupBy("__range").count().collect()]
    assert max(sizes) < 2 * 40_000 / 8
