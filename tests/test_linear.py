"""Designs and contrasts against numpy's least squares, and the two ways to write a comparison against each other."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from abundix.operators import differential, linear


def study(seed=1, n_features=60, n_samples=24, gaps=0.35):
    rng = random.Random(seed)
    dim = [(f"S{i}", "abc"[i % 3], f"P{i // 3}", float(rng.randrange(5))) for i in range(n_samples)]
    effects = {"a": 0.0, "b": 1.0, "c": -0.5}
    cells = []
    for f in range(n_features):
        base = 1e6 if f == 3 else 0.0
        for sample, group, block, mass in dim:
            if rng.random() > (gaps if f != 7 else 0.97):
                cells.append((f"F{f}", sample, base + effects[group] + 0.1 * mass + rng.gauss(0, 1) + int(block[1:])))
    return dim, cells


def frames(spark, dim, cells):
    return (
        spark.createDataFrame(dim, "sample string, group string, block string, mass double"),
        spark.createDataFrame(cells, "feature string, sample string, value double").repartition(3),
    )


def by_lstsq(design, cells, wanted):
    """n, rank, s2, effect, unscaled variance by feature, where the contrast is estimable."""
    out = {}
    at = {s: i for i, s in enumerate(design.samples)}
    for feature in {c[0] for c in cells}:
        own = [(at[s], v) for f, s, v in cells if f == feature and s in at]
        x, y = design.matrix[[i for i, _ in own]], np.array([v for _, v in own])
        pinv = np.linalg.pinv(x, rcond=1e-10)
        rank = np.linalg.matrix_rank(x)
        if not np.allclose(wanted @ pinv @ x, wanted, atol=1e-7):
            continue
        beta = pinv @ (y - y.mean())
        rest = y - y.mean() - x @ beta
        free = len(own) - rank
        s2 = float(rest @ rest) / free if free else None
        mean = wanted @ pinv @ np.full(len(own), y.mean())
        out[feature] = (len(own), rank, s2, float(wanted @ beta + mean), float(wanted @ pinv @ pinv.T @ wanted))
    return out


@pytest.mark.parametrize("terms, intercept", [(["group", "block", "mass"], False), (["group", "mass"], True), (["block", "group"], True)])
def test_contrasts_against_least_squares(spark, terms, intercept):
    dim, cells = study()
    frame, df = frames(spark, dim, cells)
    design = linear.study_design(frame, terms, intercept=intercept)
    if intercept:
        wanted = {"b": {"group:b": 1.0}, "c_b": {"group:c": 1.0, "group:b": -1.0}}
    else:
        wanted = {"b": linear.difference("group", "b", "a"), "c_b": linear.difference("group", "c", "b")}
    got = linear.contrast_fits(df, design, wanted).collect()
    for (name, _), weights in zip(wanted.items(), design.weights(wanted)):
        expected = by_lstsq(design, cells, weights)
        found = {r["feature"]: r for r in got if r["comparison"] == name}
        assert set(found) == set(expected) and len(found) > 40
        for feature, (n, rank, s2, effect, unscaled) in expected.items():
            r = found[feature]
            assert (r["n"], r["rank"], r["d"]) == (n, rank, n - rank)
            assert r["log_fc"] == pytest.approx(effect, abs=1e-7) and r["unscaled"] == pytest.approx(unscaled, rel=1e-7)
            assert (r["s2"] is None) == (s2 is None) and (s2 is None or r["s2"] == pytest.approx(s2, rel=1e-6, abs=1e-12))


def test_contrast_is_the_coefficient(spark):
    dim, cells = study(4)
    frame, df = frames(spark, dim, cells)
    first = linear.contrast_fits(df, linear.study_design(frame, ["group", "block"], intercept=False), {"x": linear.difference("group", "c", "a")})
    second = linear.contrast_fits(df, linear.study_design(frame, ["block", "group"]), {"x": {"group:c": 1.0}})
    a, b = ({r["feature"]: r.asDict() for r in differential.moderated_test(x).collect()} for x in (first, second))
    assert a.keys() == b.keys() and len(a) > 40
    for feature, row in a.items():
        for name, number in row.items():
            other = b[feature][name]
            assert other == number if not isinstance(number, float) else other == pytest.approx(number, rel=1e-6, abs=1e-9), (feature, name)


def test_block_design_is_the_paired_test(spark):
    rng = random.Random(8)
    dim = [(f"P{i // 2}{'ab'[i % 2]}", "ab"[i % 2], f"P{i // 2}", 0.0) for i in range(16)]
    cells = [(f"F{f}", s, rng.gauss(0, 1) + (g == "b")) for f in range(20) for s, g, _, _ in dim if rng.random() > 0.15 or f == 0]
    frame, df = frames(spark, dim, cells)
    fits = linear.contrast_fits(df, linear.study_design(frame, ["block", "group"]), {"x": {"group:b": 1.0}})
    own = {r["feature"]: r for r in fits.collect()}
    paired = {r["feature"]: r for r in differential.paired_test(df.join(frame, "sample"), F.col("group") == "b", block="block").collect()}
    assert own.keys() == paired.keys()
    for feature, r in paired.items():
        assert own[feature]["d"] == r["d"]
        for name in ("log_fc", "s2", "unscaled", "t"):
            assert own[feature][name] == pytest.approx(r[name], rel=1e-8)
    # with one value per block and arm this is the paired t-test on differences
    gaps = [dict((g, v) for f, s, v in cells for t, g, p, _ in dim if f == "F0" and s == t and p == block) for block in {r[2] for r in dim}]
    diffs = np.array([x["b"] - x["a"] for x in gaps])
    assert own["F0"]["t"] == pytest.approx(diffs.mean() / (diffs.std(ddof=1) / math.sqrt(len(diffs))), rel=1e-8)


def test_moderated_without_groups(spark):
    dim, cells = study(5)
    frame, df = frames(spark, dim, cells)
    fits = linear.contrast_fits(df, linear.study_design(frame, ["group"]), {"x": {"group:b": 1.0}})
    one = {r["feature"]: r["p_adj"] for r in differential.moderated_test(fits).collect()}
    assert one == {r["feature"]: r["p_adj"] for r in differential.moderated_test(fits.drop("comparison"), None).collect()}


def test_awkward_input(spark):
    dim, cells = study(6, 5)
    frame, df = frames(spark, dim, cells)
    design = linear.study_design(frame, ["group"])
    extra = [("F0", "S0", None), ("F0", "S1", float("nan")), ("F9", "S0", 1.0), ("F8", "unknown", 2.0), ("F0", None, 3.0)]
    more = df.unionByName(spark.createDataFrame(extra, "feature string, sample string, value double"))
    wanted = {"x": {"group:b": 1.0}}
    read = lambda x: {r["feature"]: (r["n"], round(r["log_fc"], 9)) for r in linear.contrast_fits(x, design, wanted).collect()}
    assert read(more) == read(df)
    assert linear.contrast_fits(df.where("feature = 'none'"), design, wanted).count() == 0
    with pytest.raises(KeyError):
        linear.contrast_fits(df, design, {"x": {"group:z": 1.0}})
    with pytest.raises(ValueError):
        linear.study_design(frame.unionByName(spark.createDataFrame([("S0", "b", "P0", 0.0)], frame.schema)), ["group"])
    # repeated cells count once, by their mean
    twice = df.withColumn("value", F.col("value") + 1).unionByName(df.withColumn("value", F.col("value") - 1))
    assert read(twice) == read(df)
