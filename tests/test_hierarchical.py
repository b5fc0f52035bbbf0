"""The joint prior of removed coefficients against a plain EM, with features that lack levels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from abundix.operators.normalize import hierarchical_removal, sum_coded


def plain_em(groups, q, steps):
    """``groups``: feature to (kept matrix, removed matrix, y). Returns posterior means by feature."""
    info, eta, rss, free = {}, {}, {}, {}
    for f, (k, r, y) in groups.items():
        out = np.eye(len(y)) - k @ np.linalg.pinv(k)
        info[f], eta[f] = r.T @ out @ r, r.T @ out @ y
        whole = np.concatenate([k, r], axis=1)
        rest = y - whole @ np.linalg.pinv(whole) @ y
        rss[f], free[f] = rest @ rest, len(y) - np.linalg.matrix_rank(whole)
    pooled = sum(rss[f] for f in rss if free[f] > 0) / sum(d for d in free.values() if d > 0)
    s2 = {f: rss[f] / free[f] if free[f] > 0 and rss[f] > 1e-20 else pooled for f in rss}
    mean, cov = np.zeros(q), np.eye(q)
    post = lambda f: (lambda v: (v @ (eta[f] / s2[f] + np.linalg.solve(cov, mean)), v))(np.linalg.inv(info[f] / s2[f] + np.linalg.inv(cov)))
    for _ in range(steps):
        found = [post(f) for f in groups]
        new = np.mean([m for m, _ in found], axis=0)
        cov = np.mean([v + np.outer(m - new, m - new) for m, v in found], axis=0)
        mean = new
    return {f: post(f)[0] for f in groups}


def test_every_feature_stays_and_takes_what_the_prior_says(spark):
    rng = np.random.default_rng(5)
    batches, rows = ["a", "b", "c"], []
    shift = {"a": 1.0, "b": -0.5, "c": 0.0}
    for f in range(40):
        own = {b: shift[b] + rng.normal(0, 0.3) for b in batches}
        seen = batches if f % 4 else batches[: 1 + f % 3]  # some lack batches, some have one
        for i in range(12 if f else 2):
            b = seen[i % len(seen)]
            rows.append((f"f{f}", f"s{i}", b, float(i % 2), float(5 * f + own[b] + 0.7 * (i % 2) + rng.normal(0, 0.2))))
    df = spark.createDataFrame(rows, "feature string, sample string, batch string, kind double, value double").repartition(3)
    got = {(r["feature"], r["sample"]): r["value"] for r in hierarchical_removal(df, sum_coded("batch", batches), {"kind": F.col("kind")}, steps=12).collect()}
    assert len(got) == len(rows)
    code = {"a": (1.0, 0.0), "b": (0.0, 1.0), "c": (-1.0, -1.0)}
    groups = {}
    for f in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == f]
        groups[f] = (np.array([[1.0, r[3]] for r in own]), np.array([code[r[2]] for r in own]), np.array([r[4] for r in own]))
    effects = plain_em(groups, 2, 12)
    for f, s, b, _, value in rows:
        assert got[f, s] == pytest.approx(value - np.dot(code[b], effects[f]), abs=1e-6)


def test_missing_values_and_empty_tables(spark):
    rows = [("f", f"s{i}", "ab"[i % 2], float(i)) for i in range(6)] + [("g", "s0", "a", 1.0), ("h", "s0", "a", None)]
    df = spark.createDataFrame(rows, "feature string, sample string, batch string, value double")
    got = hierarchical_removal(df, sum_coded("batch", ["a", "b"]), {}, steps=3).collect()
    assert len(got) == len(rows) and [r["value"] for r in got if r["feature"] == "h"] == [None]
    assert hierarchical_removal(df.where("feature = 'x'"), sum_coded("batch", ["a", "b"]), {}).count() == 0
