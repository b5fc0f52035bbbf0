"""The pipeline's stages, one by one and as a whole, against plain Python on a small corpus."""

import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402
import plainly  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PASSAGE = " ".join(f"bench{i}" for i in range(20))


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    rows = []
    for i in range(60):
        own = [word() for _ in range(rng.randint(30, 120))]
        if i % 10 == 4:
            own[10:10] = PASSAGE.split()
        text = " ".join(own)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        if i % 6 == 0:
            own[3] = "edited"
            rows.append((100 + i, " ".join(own), "en", f"s{i % 3}", len(text)))
    rows += [(200, "too short", "en", "s1", 9), (201, None, None, None, None), (202, "", "en", "s1", 0), (203, "same words again " * 30, "en", None, 9)]
    rows += [rows[5], (None, " ".join(word() for _ in range(40)), "en", None, 3)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(
        f"{path}/documents.parquet"
    )
    spark.createDataFrame([(7, PASSAGE)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_stages_against_plain_python(spark, folder, tmp_path):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), corpus()
    steps = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == COLUMNS
        steps.append(rows_of(docs))

    def good(row):
        m = plainly.measures(row[1])
        return m["n_words"] >= 20 and 100 * m["n_repeat_words"] <= 30 * m["n_words"]

    kept = [r for r in kept if good(r)]
    assert steps[0] == sorted(kept, key=str)
    found = plainly.jaccard_components([(r[0], r[1]) for r in kept], 5, 80)
    kept = list(dict.fromkeys(r for r, (_, c) in zip(kept, found) if r[0] is None or r[0] == c))
    assert steps[1] == sorted(kept, key=str)
    bad = {key for key, _ in plainly.contaminated([(r[0], r[1]) for r in kept], [(7, PASSAGE)])}
    kept = [r for r in kept if r[0] not in bad]
    assert bad and steps[2] == sorted(kept, key=str)
    times = Counter(steps[3])
    assert set(times) <= set(kept) and max(times.values()) <= 2
    size, taken = defaultdict(int), defaultdict(int)
    for r in kept:
        if r[0] is not None:
            size[r[3]] += len(r[1].split())
            taken[r[3]] += times[r] * len(r[1].split())
    assert all(taken[s] <= 2 * n for s, n in size.items())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.15 * sum(size.values())
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter(r["doc_id"] for r in placed) == Counter(r[0] for r in steps[3])
    slots = defaultdict(list)
    for r in placed:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


def test_mix_stage_deals_the_pieces_in_order(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40 + i % 7)), "en", f"s{i % 3}", i) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    pieces = corpus_pipeline.dealt(docs).collect()
    got = [r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()]
    assert len(got) > 90 and {p["__shard"] for p in pieces} == {0}
    assert got == [int(p["__id"][33:]) for p in sorted(pieces, key=lambda p: p["__slot"])]


def test_rows_without_or_with_clashing_keys(spark, tmp_path):
    text = lambda name, n=40: " ".join(f"{name}{j}" for j in range(n))
    rows = [(None, text("copied"), "en", "s0", 1), (3, text("copied"), "en", "s0", 1), (None, text("bad") + " " + PASSAGE, "en", "s0", 2)]
    rows += [(7, text("clash"), "en", "s1", 3), (7, text("other"), "en", "s1", 4), (7, text("dirty") + " " + PASSAGE, "en", "s1", 5)]
    rows += [(None, text("alone"), None, "s2", 6), (None, text("again"), "en", "s2", 7), (None, text("again"), "en", "s2", 7), (7, "short", "en", "s1", 8)]
    rows += [(1, text("copied"), None, "s1", 9), (1, text("copied"), "s1", None, 9)]
    rows += [(None, text(f"more{i}x"), "en", f"s{i % 3}", 10 + i) for i in range(60)]
    spark.createDataFrame([(PASSAGE, 7)], "text string, item_id long").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), []
    docs.repartition(3).write.parquet(f"{tmp_path}/0")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, spark.read.parquet(f"{tmp_path}/{i}"), str(tmp_path)).write.parquet(f"{tmp_path}/{i + 1}")
        seen.append(spark.read.parquet(f"{tmp_path}/{i + 1}"))
    name = lambda r: (r[0], r[1].split()[0])
    more = {(None, f"more{i}x0") for i in range(60)}
    assert Counter(rows_of(seen[0])) == Counter(r for r in rows if r[1] != "short")
    kept = {(7, "clash0"), (7, "other0"), (None, "alone0"), (None, "again0"), (1, "copied0")} | more
    assert Counter(map(name, rows_of(seen[1]))) == Counter(kept | {(None, "bad0"), (7, "dirty0")})
    assert Counter(map(name, rows_of(seen[2]))) == Counter(kept)
    pieces = corpus_pipeline.dealt(spark.read.parquet(f"{tmp_path}/3")).count()
    drawn = [name(r) for r in rows_of(seen[3])]
    assert len(drawn) == pieces == seen[4].count() and set(drawn) <= kept and sum(key is None for key, _ in drawn) > 60


def test_mix_of_equal_rows(spark, tmp_path):
    rows = [(None, f"same{i // 3} " * 300, "en", "s0", 1) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).count() == corpus_pipeline.dealt(docs).count() > 75


def test_run_and_empty_tables(spark, folder, tmp_path):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 30 and {"doc_id", "shard", "slot"} <= set(out.columns)
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
