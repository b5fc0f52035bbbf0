"""Operators on small literal rows, with missing values, ties, empty groups and odd strings."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from abundix.functions import numeric, text
from abundix.operators import (
    aggregate, design, differential, enrich, filters, identify, joins, multivar, network, normalize, principal, quantify, reshape,
)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


# --- strings and numbers ---------------------------------------------------------------------------------


def test_sites_and_names(spark):
    df = spark.createDataFrame([("MAP1A", "MAP1A-S2323sS2330s"), ("HLA-A", "HLA-A-S12s"), ("X", "X-Y5yT9t")], "gene string, site string")
    out = df.select(text.site_residues(F.col("site"), F.col("gene")).alias("r"), text.before_last_hyphen(F.col("site")).alias("g"))
    assert rows(out, "r", "g") == [("S12", "HLA-A"), ("S2323;S2330", "MAP1A"), ("Y5;T9", "X")]
    names = spark.createDataFrame([("GILT + DEC",), ("1-URGENT",), ("a b",)], "n string")
    assert rows(names.select(text.syntactic_name(F.col("n")).alias("n")), "n") == [("GILT...DEC",), ("X1.URGENT",), ("a.b",)]


def test_visit_parts_and_plex(spark):
    df = spark.createDataFrame([("P2 Cycle 1 Day 28",), ("cell line",)], "d string")
    out = df.select(*[c.alias(n) for n, c in text.visit_parts(F.col("d")).items()]).collect()
    assert tuple(out[0]) == ("P2", "1", "28") and tuple(out[1]) == (None, None, None)
    plex = spark.createDataFrame([("EX_Plex3_F01",), ("EX_P4_F02",)], "d string")
    assert rows(plex.select(text.plex_name(F.col("d")).alias("p")), "p") == [("Plex3",), ("Plex4",)]


def test_replace_first_only(spark):
    df = spark.createDataFrame([("banana",), ("xyz",)], "s string")
    assert rows(df.select(text.replace_first(F.col("s"), "an", "$1").alias("s")), "s") == [("b$1ana",), ("xyz",)]


def test_signif(spark):
    df = spark.createDataFrame([(0.0,), (123456.0,), (-0.0012345,), (9.996,), (None,)], "v double")
    got = [r["v"] for r in df.select(numeric.signif(F.col("v"), 3).alias("v")).collect()]
    assert got[0] == 0.0 and got[1] == 123000.0 and got[2] == pytest.approx(-0.00123) and got[3] == pytest.approx(10.0) and got[4] is None


# --- filters and joins -----------------------------------------------------------------------------------


def test_missing_and_text_numbers(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.0)], "i int, value double")
    assert rows(filters.drop_missing(df), "i") == [(3,)]
    numbers = spark.createDataFrame([("1,5",), ("NA",), (None,)], "v string")
    assert [r["v"] for r in filters.cast_text_numbers(numbers, ["v"], ",").collect()] == [1.5, None, None]


def test_presence_filters(spark):
    data = [("a", "s1", "x", 1.0), ("a", "s2", "y", 2.0), ("b", "s1", "x", 1.0), ("b", "s2", "y", None), ("c", "s3", "y", None), ("d", "s3", "y", 3.0)]
    df = spark.createDataFrame(data, "feature string, sample string, batch string, value double")
    assert {r[0] for r in rows(filters.present_in_share(df, 0.5), "feature")} == {"a"}
    assert {r[0] for r in rows(filters.present_in_every_batch(df, "batch"), "feature")} == {"a"}


def test_key_joins(spark):
    fact = spark.createDataFrame([("01", 1.0), ("7", 2.0), ("x", 3.0)], "sample string, v double")
    dim = spark.createDataFrame([("1", "one")], "id string, name string")
    assert rows(joins.join_on_number(fact, dim, "sample", "id").fillna({"name": "-", "sample": -1}), "sample", "name") == [(-1, "-"), (1, "one"), (7, "-")]
    base = spark.createDataFrame([("f", 0, "old"), ("f", 5, "A")], "feature string, minute int, arm string")
    assert rows(joins.replicate_baseline(base, F.col("minute") == 0, "arm", ["A", "B"]), "minute", "arm") == [(0, "A"), (0, "B"), (5, "A")]


def test_align_keeps_first_keys(spark):
    df = spark.createDataFrame([("t1", "p1", 1.0), ("t2", "p1", 2.0), ("t1", "p2", 3.0), ("t3", "p2", 4.0)], "term string, patient string, v double")
    out = {r["term"]: (r["p1"], r["p2"]) for r in joins.align_results(df, "term", "patient", "v", ["p1", "p2"]).collect()}
    assert out == {"t1": (1.0, 3.0), "t2": (2.0, None)}


# --- reshape ---------------------------------------------------------------------------------------------


def test_wide_and_back(spark):
    data = [("a", "s1", 1.0), ("a", "s1", 3.0), ("a", "s1", 3.0), ("a", "s2", 4.0), ("b", "s2", None)]
    df = spark.createDataFrame(data, "feature string, sample string, value double")
    wide = reshape.to_wide(df, ["s1", "s2"])
    assert {r["feature"]: (r["s1"], r["s2"]) for r in wide.collect()} == {"a": (7 / 3, 4.0), "b": (None, None)}
    filled = reshape.to_wide(df, ["s1", "s2"], fill=0.0, distinct=True)
    assert {r["feature"]: (r["s1"], r["s2"]) for r in filled.collect()} == {"a": (2.0, 4.0), "b": (0.0, 0.0)}
    assert rows(reshape.to_long(wide, ["feature"]), "feature", "sample") == [("a", "s1"), ("a", "s2")]


def test_pool_ratio(spark):
    data = [("g", "pool", 10.0), ("g", "s", 1000.0), ("h", "s", 5.0), ("k", "pool", 0.0), ("k", "s", 5.0)]
    df = spark.createDataFrame(data, "gene string, sample string, value double")
    out = {r["gene"]: r["log_ratio"] for r in reshape.pool_log_ratio(df, F.col("sample") == "pool", group=["gene"]).collect()}
    assert out["g"] == pytest.approx(2.0) and out["h"] is None and out["k"] is None


def test_mean_of_means_is_strict(spark):
    data = [("t", "p1", "s1", 1.0), ("t", "p1", "s1", 3.0), ("t", "p2", "s1", 4.0), ("t", "p1", "s2", 9.0)]
    df = spark.createDataFrame(data, "target string, part string, sample string, value double")
    out = {r["sample"]: r["value"] for r in reshape.mean_of_means_strict(df, target="target", part="part").collect()}
    assert out == {"s1": 3.0, "s2": None}


def test_collapse_gives_one_row_at_any_size(spark):
    data = [("big", f"m{i:05d}") for i in range(20_000)] + [("small", "b"), ("small", "a"), ("small", "a"), ("small", None)]
    df = spark.createDataFrame(data, "g string, m string")
    out = {r["g"]: r for r in reshape.collapse_members(df, "g", "m").collect()}
    assert (out["small"]["members"], out["small"]["size"]) == ("a; b", 2)
    assert out["big"]["members"].split("; ") == [f"m{i:05d}" for i in range(20_000)] and out["big"]["size"] == 20_000
    listed = reshape.member_rows(df, "g", "m")
    assert rows(listed.where("g = 'small'"), "m", "position", "size") == [("a", 1, 2), ("b", 2, 2)]
    assert rows(listed.where("m = 'm19999'"), "position", "size") == [(20_000, 20_000)]


def test_wide_keeps_or_refuses_every_sample(spark):
    df = spark.createDataFrame([("f", "s1", 1.0), ("f", "s3", 3.0), ("g", "s2", 2.0)], "feature string, sample string, value double")
    assert reshape.to_wide(df).columns == ["feature", "s1", "s2", "s3"]
    with pytest.raises(Exception, match="not among the given columns: s3"):
        reshape.to_wide(df, ["s1", "s2"]).collect()
    with pytest.raises(Exception, match="not among the given columns: s2"):
        df.select(*normalize.sum_coded("sample", ["s1", "s3"]).values()).collect()


def test_near_rows_of_large_values(spark):
    data = [(f"f{i}", s, 1e6 + i + (1e-4 if s == "b" else 0.0)) for i in range(200) for s in "ab"]
    df = spark.createDataFrame(data, "feature string, sample string, value double")
    far = [r["distance"] for r in multivar.euclidean_distance(multivar.pair_moments(df, ["a", "b"], about="row")).collect()]
    assert far == [pytest.approx(0.0014142, rel=1e-4)]
    near = [r["distance"] for r in multivar.correlation_distance(multivar.pair_moments(df, ["a", "b"])).collect()]
    assert near == [pytest.approx(0.0, abs=1e-9)]


def test_products_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(multivar, "BLOCK", 3)
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(20, 8))
    df = spark.createDataFrame([(i % 2, row.tolist()) for i, row in enumerate(matrix)], "k int, vec array<double>")
    for keys in ([], ["k"]):
        got = {(r["k"] if keys else 0, r["i"], r["j"]): r["product"] for r in multivar.outer_sums(df, keys, "vec", 8).collect()}
        assert len(got) == 64 * (2 if keys else 1)
        for (k, i, j), product in got.items():
            own = matrix[k::2] if keys else matrix
            assert product == pytest.approx(own[:, i] @ own[:, j])


def test_set_padding(spark):
    df = spark.createDataFrame([("KEGG_A_B", ["x", "null", "", None]), ("GO_A", ["y"])], "term string, members array<string>")
    assert rows(enrich.sets_by_prefix(df, "KEGG_"), "term", "label", "gene") == [("KEGG_A_B", "A B", "x")]


# --- design ----------------------------------------------------------------------------------------------


def test_first_and_centred(spark):
    data = [("p", "s2", 5, 10.0), ("p", "s1", 2, 4.0), ("q", "s3", 1, 1.0)]
    df = spark.createDataFrame(data, "patient string, sample string, day int, value double")
    assert rows(design.first_per_group(df, "patient", "day", "sample"), "patient", "sample") == [("p", "s1"), ("q", "s3")]
    out = design.center_to_first(df, ["patient"], "day", "sample")
    assert rows(out, "sample", "x", "delta") == [("s1", 1, 0.0), ("s2", 2, 6.0), ("s3", 1, 0.0)]


def test_catalogue_refuses_unknown_conditions(spark):
    samples = spark.createDataFrame([("s1", "A"), ("s2", "B")], "sample string, condition string")
    good = design.comparison_catalogue(spark, {"A_B": (["A"], ["B"])})
    assert rows(design.comparison_samples(good, samples), "comparison", "side", "sample") == [("A_B", 1, "s1"), ("A_B", 2, "s2")]
    bad = design.comparison_catalogue(spark, {"A_C": (["A"], ["C"])})
    with pytest.raises(Exception, match="no sample has condition C"):
        design.comparison_samples(bad, samples).collect()


def test_levels(spark):
    df = spark.createDataFrame([("GILT",), ("PRE",), ("new",)], "t string")
    assert {r["t"]: r["ord"] for r in design.with_level_order(df, "t", ["PRE", "GILT"]).collect()} == {"PRE": 1, "GILT": 2, "new": None}


# --- identification --------------------------------------------------------------------------------------


def greedy_cover(pairs):
    left, chosen = set(pairs), set()
    while left:
        counts = {}
        for peptide, accession in left:
            counts[accession] = counts.get(accession, 0) + 1
        best = min(counts, key=lambda a: (-counts[a], a))
        covered = {p for p, a in left if a == best}
        chosen |= {(p, best) for p in covered}
        left = {(p, a) for p, a in left if p not in covered}
    return chosen


@pytest.mark.parametrize("seed", range(4))
def test_parsimony_equals_one_at_a_time_greedy(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"pep{rng.randrange(40)}", f"acc{rng.randrange(15)}") for _ in range(90)}
    df = spark.createDataFrame(sorted(pairs), "peptide string, accession string")
    got = {(r["peptide"], r["accession"]) for r in identify.parsimonious_accessions(df).collect()}
    assert got == greedy_cover(pairs)
    # larger components by rounds, and many small ones in one stream
    mixed = identify.parsimonious_accessions(df, most_pairs=20).collect()
    assert {(r["peptide"], r["accession"]) for r in mixed} == got
    copies = {(f"{p}_{i}", f"{a}_{i}") for p, a in pairs for i in range(20)}
    more = identify.parsimonious_accessions(spark.createDataFrame(sorted(copies) + [("lone", None), (None, "acc")], df.schema)).collect()
    assert {(r["peptide"], r["accession"]) for r in more} == greedy_cover(copies)


def test_cover_in_pieces_of_any_size(spark, monkeypatch):
    rng = random.Random(5)
    pairs = {(f"pep{i}_{rng.randrange(6)}", f"acc{i}_{rng.randrange(4)}") for i in range(60) for _ in range(9)}
    assert identify.greedy_cover(*zip(*[(a, p) for p, a in sorted(pairs)])) == [dict(greedy_cover(pairs))[p] for p, _ in sorted(pairs)]
    df = spark.createDataFrame(sorted(pairs), "peptide string, accession string").repartition(2)
    got = {(r["peptide"], r["accession"]) for r in identify.parsimonious_accessions(df).collect()}
    assert got == greedy_cover(pairs)


def test_prior_and_unique(spark):
    df = spark.createDataFrame([("p1", "a"), ("p1", "b"), ("p2", "b"), ("p3", "c"), ("p3", "d")], "peptide string, accession string")
    prior = spark.createDataFrame([("b",)], "accession string")
    assert rows(identify.unique_peptides(df), "peptide") == [("p2",)]
    assert rows(identify.prefer_prior(df, prior), "peptide", "accession") == [("p1", "b"), ("p2", "b"), ("p3", "c"), ("p3", "d")]


def test_modified_sites(spark):
    peptides = [("G", "K.AS*PT*R.V"), ("G", "R.WWW*.K"), ("G", "K.ASPTR.V")]
    df = spark.createDataFrame(peptides, "gene string, peptide string")
    seq = spark.createDataFrame([("G", "MKASPTRVASPTR")], "gene string, sequence string")
    assert rows(identify.map_modified_sites(df, seq), "peptide", "site_id") == [("K.AS*PT*R.V", "G-S4sT6t")]


def test_best_site_and_longest(spark):
    df = spark.createDataFrame([("s", "B", 2.0), ("s", "A", 2.0), ("s", "C", 1.0)], "spec string, site string, score double")
    assert rows(identify.best_site_per_spectrum(df, ["spec"], "score", "site"), "site", "score") == [("A", 2.0)]
    seq = spark.createDataFrame([("P2", "AAA"), ("P1", "CCC"), ("P3", "D")], "accession string, sequence string")
    mapping = spark.createDataFrame([("P1", "G"), ("P2", "G"), ("P3", "G")], "accession string, symbol string")
    assert rows(identify.longest_per_symbol(seq, mapping), "symbol", "accession") == [("G", "P1")]


def test_reporter_ratios(spark):
    linked = spark.createDataFrame(
        [("g", "Plex1", "c1", "ref", 2.0), ("g", "Plex1", "c2", "s2", 8.0), ("g", "Plex1", "c2", "s2", 8.0), ("h", "Plex1", "c2", "s2", 1.0)],
        "gene string, plex_id string, channel string, measurement string, intensity double",
    )
    refs = spark.createDataFrame([("Plex1", "c1")], "plex_id string, reference string")
    assert {r["gene"]: r["log_ratio"] for r in quantify.reporter_ratios(linked, refs, ["gene"]).collect()} == {"g": 3.0, "h": None}


# --- normalisation ---------------------------------------------------------------------------------------


def matrix(seed=0, features=12, samples=9, missing=0.1):
    rng = np.random.default_rng(seed)
    return [
        (f"f{i:02d}", f"s{j}", f"b{j % 3}", f"k{j % 2}", float(rng.normal() + i + 2 * (j % 3)))
        for i in range(features) for j in range(samples) if rng.random() > missing
    ]


def frame(spark, data):
    return spark.createDataFrame(data, "feature string, sample string, batch string, kind string, value double")


def test_medians_become_zero(spark):
    out = normalize.center_samples(frame(spark, matrix()))
    by_sample = {}
    for r in out.collect():
        by_sample.setdefault(r["sample"], []).append(r["value"])
    assert all(abs(np.median(v)) < 1e-12 for v in by_sample.values())


def test_polish_settles(spark):
    data = matrix(1)
    out = normalize.median_polish(frame(spark, data), tolerance=1e-3, max_passes=60).collect()
    start = {(f, s): v for f, s, _, _, v in data}
    for r in out:
        assert r["value"] + r["row_effect"] + r["col_effect"] == pytest.approx(start[r["feature"], r["sample"]])
    for key in ("feature", "sample"):
        groups = {}
        for r in out:
            groups.setdefault(r[key], []).append(r["value"])
        assert all(abs(np.median(v)) < 0.35 for v in groups.values())


def test_removed_covariates_match_least_squares(spark):
    data = matrix(2)
    df = frame(spark, data)
    remove, keep = normalize.sum_coded("batch", ["b0", "b1", "b2"]), normalize.sum_coded("kind", ["k0", "k1"])
    got = {(r["feature"], r["sample"]): r["value"] for r in normalize.remove_covariates(df, remove, keep).collect()}

    def code(level, levels):
        return [1.0 if level == x else (-1.0 if level == levels[-1] else 0.0) for x in levels[:-1]]

    for feature in sorted({d[0] for d in data}):
        mine = [d for d in data if d[0] == feature]
        b = np.array([code(d[2], ["b0", "b1", "b2"]) for d in mine])
        k = np.array([code(d[3], ["k0", "k1"]) for d in mine])
        y = np.array([d[4] for d in mine])
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(y)), b, k]), y, rcond=None)[0]
        for d, value in zip(mine, y - b @ beta[1:3]):
            assert got[d[0], d[1]] == pytest.approx(value, abs=1e-8)


def test_shrinking_pulls_towards_the_mean(spark):
    data = matrix(3, features=30, missing=0.0)
    df = frame(spark, data)
    remove = normalize.sum_coded("batch", ["b0", "b1", "b2"])
    plain = {(r["feature"], r["sample"]): r["value"] for r in normalize.remove_covariates(df, remove, {}).collect()}
    shrunk = {(r["feature"], r["sample"]): r["value"] for r in normalize.remove_covariates(df, remove, {}, shrink=True).collect()}
    start = {(d[0], d[1]): d[4] for d in data}
    x = np.array([[1.0, *{"b0": [1, 0], "b1": [0, 1], "b2": [-1, -1]}[f"b{j % 3}"]] for j in range(9)])
    inverse = np.linalg.inv(x.T @ x)
    features = sorted({d[0] for d in data})
    y = np.array([[start[f, f"s{j}"] for j in range(9)] for f in features])
    beta = y @ x @ inverse
    s2 = ((y - beta @ x.T) ** 2).sum(axis=1) / 6
    for j in (1, 2):
        noise = s2 * inverse[j, j]
        prior = max(beta[:, j].var(ddof=1) - noise.mean(), 0.0)
        beta[:, j] = beta[:, j].mean() + prior / (prior + noise) * (beta[:, j] - beta[:, j].mean())
    expected = y - beta[:, 1:] @ x[:, 1:].T
    for i, f in enumerate(features):
        for j in range(9):
            assert shrunk[f, f"s{j}"] == pytest.approx(expected[i, j], abs=1e-7)
    assert plain != shrunk


# --- tests -----------------------------------------------------------------------------------------------


def test_paired_equals_t_on_differences(spark):
    rng = np.random.default_rng(3)
    before, after = rng.normal(size=8), rng.normal(1, 1, size=8)
    data = [("f", f"p{i}", arm, float(v)) for i in range(8) for arm, v in (("PRE", before[i]), ("GILT", after[i]))] + [("f", "lonely", "PRE", 99.0)]
    df = spark.createDataFrame(data, "feature string, patient string, arm string, value double")
    r = differential.paired_test(df, F.col("arm") == "GILT").first()
    d = after - before
    assert r["log_fc"] == pytest.approx(d.mean())
    assert r["t"] == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(8)))
    assert r["d"] == 7


def test_group_tests_with_small_groups(spark):
    data = [("a", "s1", "A", 1.0), ("a", "s2", "A", 3.0), ("a", "s3", "B", 10.0), ("a", "s4", "B", 14.0), ("b", "s1", "A", 1.0), ("b", "s3", "B", 2.0),
            ("c", "s1", "A", 5.0), ("d", "s1", "A", 2.0), ("d", "s2", "A", 2.0), ("d", "s3", "B", 2.0), ("d", "s4", "B", 2.0)]
    df = spark.createDataFrame(data, "feature string, sample string, condition string, value double")
    catalogue = design.comparison_catalogue(spark, {"A_B": (["A"], ["B"])})
    pairs = differential.comparison_stats(differential.condition_stats(df), catalogue)
    pooled = {r["feature"]: r for r in differential.pooled_test(pairs).collect()}
    assert set(pooled) == {"a", "b", "d"}
    assert pooled["a"]["t"] == pytest.approx(10 / math.sqrt(5 * 1.0))
    assert pooled["b"]["t"] is None and pooled["d"]["t"] is None
    welch = {r["feature"]: r for r in differential.welch_test(pairs).collect()}
    assert welch["a"]["df"] == pytest.approx((1 + 4) ** 2 / (1 + 16)) and welch["b"]["t"] is None and welch["c"]["effect"] is None


def test_merged_conditions_equal_pooled_samples(spark):
    rng = np.random.default_rng(4)
    data = [("f", f"s{i}", "ABC"[i % 3], float(1e6 + rng.normal(0, 0.01))) for i in range(15)]
    df = spark.createDataFrame(data, "feature string, sample string, condition string, value double")
    catalogue = design.comparison_catalogue(spark, {"x": (["A"], ["B", "C"])})
    r = differential.comparison_stats(differential.condition_stats(df), catalogue).first()
    side2 = [d[3] for d in data if d[2] in "BC"]
    assert r["n2"] == 10 and r["m2"] == pytest.approx(np.mean(side2)) and r["v2"] == pytest.approx(np.var(side2, ddof=1))


def test_flow_and_histogram(spark):
    data = [("f1", "c1", 1.0, 0.01), ("f1", "c2", -1.0, 0.01), ("f2", "c1", 1.0, 0.01), ("f2", "c2", 1.0, 0.9), ("f3", "c1", 1.0, 0.9)]
    df = spark.createDataFrame(data, "feature string, comparison string, log_fc double, p_adj double")
    labelled = differential.label_direction(df)
    assert rows(differential.direction_flow(labelled, ["c1", "c2"]), "c1", "c2", "n") == [("UpReg", "DownReg", 1), ("UpReg", "absent", 1)]
    assert rows(aggregate.histogram(df, ["comparison"], "log_fc", 0.5), "comparison", "bin", "n") == [("c1", 2, 3), ("c2", -2, 1), ("c2", 2, 1)]


# --- enrichment ------------------------------------------------------------------------------------------


def brute_score(weights, hits):
    total, n = sum(weights[i] for i in hits), len(weights)
    s, up, down = 0.0, 0.0, 0.0
    for i in range(n):
        s += weights[i] / total if i in hits else -1.0 / (n - len(hits))
        up, down = max(up, s), min(down, s)
    return up if up >= -down else down


def test_ranked_scores(spark):
    rng = random.Random(8)
    weights = sorted((rng.gauss(0, 1) for _ in range(60)), reverse=True)
    ranked = spark.createDataFrame([("c", f"g{i}", i + 1, 60, w) for i, w in enumerate(weights)], "comparison string, feature string, rank long, n long, v double")
    sets = {f"t{k}": set(rng.sample(range(60), k)) for k in (1, 3, 10, 40)}
    sets["top"] = {0, 1, 2}
    table = spark.createDataFrame([(t, f"g{i}") for t, members in sets.items() for i in members] + [("t3", "unmeasured")], "term string, gene string")
    scores = enrich.ranked_set_scores(ranked, table, value="v")
    got = {r["term"]: r["es"] for r in scores.collect()}
    for term, members in sets.items():
        assert got[term] == pytest.approx(brute_score([abs(w) for w in weights], members))
        assert -1 <= got[term] <= 1
    null = enrich.null_set_scores(ranked, scores, value="v", n_perm=50)
    drawn = null.collect()
    assert len(drawn) == 50 * len({len(m) for m in sets.values()})
    tested = {r["term"]: r for r in enrich.normalised_set_scores(scores, null).collect()}
    same = [d["es"] for d in drawn if d["h"] == 3 and d["es"] > 0]
    assert tested["top"]["nes"] == pytest.approx(tested["top"]["es"] / np.mean(same))
    assert tested["top"]["p"] == pytest.approx((1 + sum(s >= tested["top"]["es"] for s in same)) / (1 + len(same)))


def test_null_does_not_depend_on_partitions(spark):
    ranked = spark.createDataFrame([("c", f"g{i}", i + 1, 30, float(15 - i)) for i in range(30)], "comparison string, feature string, rank long, n long, v double")
    sizes = spark.createDataFrame([("c", 30, 4)], "comparison string, n long, h long")
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for width in ("1", "4", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            seen.append(rows(enrich.null_set_scores(ranked, sizes, value="v", n_perm=20), "perm", "es"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] and len({es for _, es in seen[0]}) > 10


def test_correlation_without_pairs(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=8)
    x = {f"g{i}": base * (1 if i < 4 else 0) + rng.normal(size=8) for i in range(10)}
    data = [(g, f"s{j}", "c", float(v)) for g, line in x.items() for j, v in enumerate(line)] + [("gap", "s0", "c", 1.0)]
    df = spark.createDataFrame(data, "feature string, sample string, cohort string, value double")
    sets = spark.createDataFrame([("t", f"g{i}") for i in range(4)] + [("t", "gap")], "term string, gene string")
    r = enrich.set_correlation_test(df, sets).first()
    inside = [np.corrcoef(x[a], x[b])[0, 1] for a, b in itertools.combinations([f"g{i}" for i in range(4)], 2)]
    everything = [np.corrcoef(x[a], x[b])[0, 1] for a, b in itertools.combinations(x, 2)]
    assert r["n_members"] == 4 and r["n_features"] == 10
    assert r["correlation"] == pytest.approx(np.mean(inside)) and r["background"] == pytest.approx(np.mean(everything))
    spread = np.var(inside, ddof=1) / len(inside) + np.var(everything, ddof=1) / len(everything)
    assert r["t"] == pytest.approx((np.mean(inside) - np.mean(everything)) / math.sqrt(spread))


@pytest.mark.parametrize("tile, most_masks, gaps", [(1024, 64, 0.3), (5, 0, 0.3), (5, 64, 0.0)])
def test_correlation_with_gaps(spark, tile, most_masks, gaps):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(23, 7)) + 1e5
    x[rng.random(x.shape) < gaps] = np.nan
    if not gaps:  # few patterns of gaps
        x[::3, 0] = x[1::4, 2] = np.nan
    x[4] = np.where(np.isnan(x[4]), np.nan, 3.0)  # no spread
    data = [(f"g{i}", f"s{j}", "c", float(v)) for i, line in enumerate(x) for j, v in enumerate(line) if not np.isnan(v)] + [("g0", None, "c", None), ("g1", "s1", "c", None)]
    df = spark.createDataFrame(data, "feature string, sample string, cohort string, value double")
    packed = multivar.packed_features(df, by="cohort", least=3)
    got = multivar.pair_correlations(packed, ["cohort"], tile=tile, most_masks=most_masks).collect()
    r = []
    for a, b in itertools.combinations(range(23), 2):
        both = ~np.isnan(x[a]) & ~np.isnan(x[b])
        if both.sum() >= 3 and np.ptp(x[a][both]) > 0 and np.ptp(x[b][both]) > 0:
            r.append(np.corrcoef(x[a][both], x[b][both])[0, 1])
    assert len(got) == 1 and got[0]["n_rows"] == sum((~np.isnan(line)).sum() >= 3 for line in x) and got[0]["pairs"] == len(r)
    assert got[0]["mean"] == pytest.approx(np.mean(r)) and got[0]["var"] == pytest.approx(np.var(r, ddof=1))
    assert multivar.pair_correlations(packed.where("feature = 'none'"), ["cohort"]).collect() == []


def test_kernel_density(spark):
    rng = np.random.default_rng(14)
    groups = {"a": rng.normal(3, 2, 400), "b": rng.exponential(1, 37), "same": np.full(5, 2.5), "one": np.array([1.0])}
    data = [(g, float(v)) for g, own in groups.items() for v in own] + [("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(data, "g string, v double")
    got = aggregate.kernel_density(df, ["g"], "v").collect()
    for g, own in groups.items():
        n, sd = len(own), own.std(ddof=1) if len(own) > 1 else 0.0
        iqr = np.subtract(*np.quantile(own, [0.75, 0.25])) / 1.34
        h = 0.9 * (1.0 if sd == 0 else min(sd, iqr) if iqr > 0 else sd) * n**-0.2
        mine = sorted((r["i"], r["x"], r["density"]) for r in got if r["g"] == g)
        assert [i for i, _, _ in mine] == list(range(128))
        x, density = (np.array([r[k] for r in mine]) for k in (1, 2))
        assert x[0] == pytest.approx(own.min() - 3 * h) and x[-1] == pytest.approx(own.max() + 3 * h)
        exact = np.exp(-(((x[:, None] - own) / h) ** 2) / 2).sum(axis=1) / (math.sqrt(2 * math.pi) * h * n)
        assert np.abs(density - exact).max() < 0.02 * exact.max()
        assert (density[1:] + density[:-1]).sum() * (x[1] - x[0]) / 2 == pytest.approx(1, abs=0.01)


def test_consensus_drops_incomplete_terms(spark):
    data = [("a", "p1", 3.0, 0.001), ("a", "p2", -4.0, 0.2), ("b", "p1", 9.0, 0.001), ("c", "p1", 1.0, 0.9), ("c", "p2", 1.0, 0.9)]
    df = spark.createDataFrame(data, "term string, patient string, score double, p double")
    assert rows(enrich.consensus_terms(df), "term", "max_abs_score") == [("a", 4.0)]


def test_kinases(spark):
    sites = spark.createDataFrame([("c", "G", "S1;S2", 2.0), ("c", "G", "S1", 4.0), ("c", "H", "S9", -1.0), ("c", "H", "T3", 0.0)], "comparison string, gene string, residue string, value double")
    ks = spark.createDataFrame([("K", "G", "S1"), ("K", "G", "S2"), ("L", "H", "S9")], "kinase string, gene string, residue string")
    got = {r["kinase"]: r for r in enrich.kinase_test(enrich.kinase_scores(sites, ks)).collect()}
    everything = [3.0, 2.0, -1.0, 0.0]
    z = (2.5 - 1.0) * math.sqrt(2) / np.std(everything, ddof=1)
    assert got["K"]["m"] == 2 and got["K"]["z"] == pytest.approx(z) and got["K"]["p"] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)))


# --- multivariate and networks ---------------------------------------------------------------------------


def test_scores_keep_distances(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(20, 5))
    data = [(f"f{i}", f"s{j}", float(x[i, j])) for i in range(20) for j in range(5)] + [("half", "s0", 1.0)]
    df = spark.createDataFrame(data, "feature string, sample string, value double")
    out = principal.component_scores(df, 5).collect()
    scores = np.zeros((5, 5))
    for r in out:
        scores[int(r["sample"][1:]), r["component"] - 1] = r["score"]
    centred = (x - x.mean(axis=1, keepdims=True)).T
    for a, b in itertools.combinations(range(5), 2):
        assert np.linalg.norm(scores[a] - scores[b]) == pytest.approx(np.linalg.norm(centred[a] - centred[b]))
    assert all(scores[np.argmax(np.abs(scores[:, c])), c] > 0 for c in range(4))


def test_pair_moments_with_gaps(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(15, 4))
    x[rng.random(x.shape) < 0.2] = np.nan
    data = [(f"f{i}", f"s{j}", float(x[i, j])) for i in range(15) for j in range(4) if not np.isnan(x[i, j])]
    df = spark.createDataFrame(data, "feature string, sample string, value double")
    moments = multivar.pair_moments(df, [f"s{j}" for j in range(4)])
    for r in multivar.correlation_distance(moments).collect():
        a, b = x[:, int(r["a"][1:])], x[:, int(r["b"][1:])]
        both = ~np.isnan(a) & ~np.isnan(b)
        assert r["n"] == both.sum() and r["distance"] == pytest.approx(1 - np.corrcoef(a[both], b[both])[0, 1])
    for r in multivar.euclidean_distance(multivar.pair_moments(df, [f"s{j}" for j in range(4)], about="row")).collect():
        a, b = x[:, int(r["a"][1:])], x[:, int(r["b"][1:])]
        both = ~np.isnan(a) & ~np.isnan(b)
        assert r["distance"] == pytest.approx(np.linalg.norm(a[both] - b[both]))


def test_outer_sums_flush(spark, monkeypatch):
    monkeypatch.setattr(multivar, "_MAX_HELD", 8)
    data = [(k, [float(i), float(k)]) for k in range(6) for i in range(5)]
    df = spark.createDataFrame(data, "k long, vec array<double>").repartition(3)
    got = {(r["k"], r["i"], r["j"]): r["product"] for r in multivar.outer_sums(df, ["k"], "vec", 2).collect()}
    assert got[4, 0, 0] == 30.0 and got[4, 0, 1] == 40.0 and got[4, 1, 1] == 80.0 and len(got) == 24


def test_clusters(spark):
    rng = np.random.default_rng(12)
    points = [(f"g{i}", [float(v) for v in rng.normal(size=3) * 0.1 + 10 * (i % 3)]) for i in range(60)]
    df = spark.createDataFrame(points, "feature string, vec array<double>")
    got = {(r["k"], r["feature"]): r["cluster"] for r in multivar.kmeans_clusters(df, [2, 3], restarts=4).collect()}
    assert all(got[3, f"g{i}"] == i % 3 + 1 for i in range(60))
    centres = spark.createDataFrame([(i, [10.0 * i] * 3) for i in range(3)], "cluster int, centre array<double>")
    near = {r["feature"]: r["cluster"] for r in multivar.nearest_centroid(df, centres).collect()}
    assert all(near[f"g{i}"] == i % 3 for i in range(60))


def test_kmeans_steps_are_those_of_lloyd(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(80, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "feature long, vec array<double>")
    got = {(r["k"], r["feature"]): r["cluster"] for r in multivar.kmeans_clusters(df, [2, 4], restarts=6, max_iter=40).collect()}
    assert len(got) == 160 and all(v in range(1, k + 1) for (k, _), v in got.items())
    for k in (2, 4):
        label = np.array([got[k, i] for i in range(80)])
        centres = np.array([x[label == c].mean(axis=0) for c in range(1, k + 1)])
        assert (np.argmin(((x[:, None] - centres[None]) ** 2).sum(axis=2), axis=1) + 1 == label).all()
        assert [tuple(c) for c in centres] == sorted(tuple(c) for c in centres)
    assert multivar.kmeans_clusters(df.where("feature = 99"), [2]).count() == 0


def union_find(pairs):
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {v: find(v) for v in parent}


def test_components(spark):
    rng = random.Random(13)
    pairs = [(f"n{rng.randrange(80):02d}", f"n{rng.randrange(80):02d}") for _ in range(60)] + [(f"z{i:02d}", f"z{i + 1:02d}") for i in range(40)] + [("y", "y")]
    df = spark.createDataFrame([("c1", a, b) for a, b in pairs] + [("c2", "n00", "z39")], "condition string, a string, b string")
    got = {(r["condition"], r["node"]): r["component"] for r in network.connected_components(df).collect()}
    expected = {("c1", v): root for v, root in union_find(pairs).items()}
    expected.update({("c2", "n00"): "n00", ("c2", "z39"): "n00"})
    assert got == expected


def test_linkers(spark):
    edges = spark.createDataFrame([("h1", "x"), ("x", "h2"), ("h1", "h2"), ("y", "h1")], "a string, b string")
    hits = spark.createDataFrame([("c", "h1"), ("c", "h2")], "condition string, feature string")
    assert rows(network.linker_nodes(edges, hits), "node", "n_hits") == [("x", 2)]
    assert rows(network.hit_edges(edges, hits), "a", "b") == [("h1", "h2")]


def test_set_correlation_reads_rows_twice(spark):
    """Once for the names of the samples, once for the cells; patterns and pairs come from a copy of the packed rows."""
    read = spark.sparkContext.accumulator(0)

    def counted(row):
        read.add(1)
        return row

    rng = random.Random(4)
    cells = [(c, f"f{i}", f"s{s}", rng.random()) for c in "xy" for i in range(60) for s in range(6) if rng.random() < 0.8]
    df = spark.createDataFrame(spark.sparkContext.parallelize(cells, 3).map(counted), "cohort string, feature string, sample string, value double")
    sets = spark.createDataFrame([(t, f"f{i}") for t, step in (("two", 2), ("three", 3)) for i in range(0, 60, step)], "term string, gene string")
    got = {(r["cohort"], r["term"]): r for r in enrich.set_correlation(df, sets).collect()}
    assert read.value <= 2 * len(cells)
    for cohort in "xy":
        own = {}
        for c, f, s, v in cells:
            if c == cohort:
                own.setdefault(f, {})[s] = v
        own = {f: v for f, v in own.items() if len(v) >= 3}
        found = {}
        for f, g in itertools.combinations(own, 2):
            both = [s for s in own[f] if s in own[g]]
            if len(both) >= 3:
                found[f, g] = np.corrcoef([own[f][s] for s in both], [own[g][s] for s in both])[0, 1]
        for term, step in (("two", 2), ("three", 3)):
            inside = [r for (f, g), r in found.items() if int(f[1:]) % step == 0 and int(g[1:]) % step == 0]
            r = got[cohort, term]
            assert (r["pairs"], r["all_pairs"]) == (len(inside), len(found))
            assert r["correlation"] == pytest.approx(np.mean(inside)) and r["background"] == pytest.approx(np.mean(list(found.values())))
