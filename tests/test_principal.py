"""Principal components against numpy's, in one step and by iteration over many blocks of samples."""

import numpy as np
import pytest

from abundix.operators.principal import component_scores, orthonormal, triangle


def long_rows(spark, x, more=()):
    rows = [(f"f{i}", f"s{j:04d}", float(v)) for i, line in enumerate(x) for j, v in enumerate(line)]
    return spark.createDataFrame([*rows, *more], "feature string, sample string, value double").repartition(4)


def check(got, x, n_components, tolerance=1e-6):
    c = x - x.mean(axis=1, keepdims=True)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    found = np.zeros((x.shape[1], n_components))
    for r in got:
        found[int(r["sample"][1:]), r["component"] - 1] = r["score"]
        share = s[r["component"] - 1] ** 2 / (s * s).sum() if r["component"] <= len(s) else 0.0
        assert r["share"] == pytest.approx(share, abs=1e-9)
    assert len(got) == x.shape[1] * n_components
    # A v = l v, and the scores of two components are orthogonal
    image = c.T @ (c @ found)
    for k in range(n_components):
        l = s[k] ** 2 if k < len(s) else 0.0
        assert np.abs(image[:, k] - l * found[:, k]).max() <= tolerance * s[0] ** 3
        assert np.linalg.norm(found[:, k]) == pytest.approx(np.sqrt(l), rel=1e-7, abs=1e-6 * s[0])
        assert found[np.argmax(np.abs(found[:, k])), k] >= 0
    cross = found.T @ found
    assert np.abs(cross - np.diag(np.diag(cross))).max() <= tolerance * s[0] ** 2


def test_few_samples(spark):
    x = np.random.default_rng(1).normal(size=(40, 9)) + 1e4
    gaps = [("gap", "s0000", 1.0), ("gap", "s0001", None), ("f0", "s0000", float(x[0, 0])), ("f1", None, 2.0)]
    check(component_scores(long_rows(spark, x, gaps), 3).collect(), x, 3)


def test_iteration_over_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)) * [9, 5, 3, 2] @ rng.normal(size=(4, 130)) + 0.3 * rng.normal(size=(60, 130))
    check(component_scores(long_rows(spark, x), 2, exact=10, width=12, sample_block=32).collect(), x, 2)


def test_more_components_than_rank(spark):
    x = np.random.default_rng(3).normal(size=(2, 6))
    check(component_scores(long_rows(spark, x), 4).collect(), x, 4)


def test_nothing(spark):
    empty = long_rows(spark, np.zeros((0, 0)))
    assert component_scores(empty, 2).collect() == []
    flat = component_scores(long_rows(spark, np.ones((3, 2))), 2).collect()
    assert len(flat) == 4 and all(r["score"] == 0.0 for r in flat)


def test_tree_of_triangles(spark):
    rng = np.random.default_rng(4)
    tall = rng.normal(size=(700, 5)) @ np.diag([1e4, 1, 1, 1e-3, 1])
    blocks = [(i, np.ascontiguousarray(tall[7 * i : 7 * i + 7]).tobytes()) for i in range(100)]
    basis = spark.createDataFrame([(i, bytearray(b)) for i, b in blocks], "sb int, m binary").repartition(6)
    r = triangle(basis, 5)
    assert r.T @ r == pytest.approx(tall.T @ tall, rel=1e-9, abs=1e-6)
    q = np.concatenate([np.frombuffer(x["m"]).reshape(-1, 5) for x in sorted(orthonormal(basis, 5).collect(), key=lambda x: x["sb"])])
    assert q.T @ q == pytest.approx(np.eye(5), abs=1e-12)
