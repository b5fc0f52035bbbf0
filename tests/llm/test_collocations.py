"""Phrase collocations against plain Python, on awkward rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from abundix.llm import collocations as c

SCHEMA = "doc_id long, lang string, text string, phrase int, f string, n int, hash string, words int, shard int"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def counts(rows, longest=5):
    sizes, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            own = re.findall("[^ \t]+", piece)
            sizes[lang] += len(own)
            for k in range(1, longest + 1):
                f.update((lang, tuple(own[i : i + k])) for i in range(len(own) - k + 1))
    return sizes, f


def plainly(rows, support=100, top=2000, longest=5):
    sizes, f = counts(rows, longest)
    good = {p: a for p, a in f.items() if a >= support and len(p[1]) > 1}
    found = {}
    for (lang, own), a in good.items():
        cuts = []
        for k in range(1, len(own)):
            left, right = f[lang, own[:k]], f[lang, own[k:]]
            cuts.append((1000 * a * sizes[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(own).encode(), left, right, own))
    out = []
    for lang, rows_of in found.items():
        longer = [(own, a) for (spoken, own), a in good.items() if spoken == lang]
        inside = lambda own, a: any(len(b) > len(own) and n >= a and any(b[i : i + len(own)] == own for i in range(len(b))) for b, n in longer)
        left_over = sorted(r for r in rows_of if not inside(r[5], -r[1]))
        out += [(lang, i + 1, r[2].decode(), -r[1], r[3], r[4], sizes[lang], -r[0]) for i, r in enumerate(left_over[:top])]
    return sorted(out)


def some_rows(n=400, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["The", "of", "Été", "ß#", "naïve\x1cword", "日本"]
    fixed = ["new york city hall", "once upon a time there was", "kick the bucket", "ad hoc"]
    rows = []
    for i in range(n):
        said = []
        for _ in range(rng.randrange(1, 12)):
            said.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocabulary))
            said.append(rng.choice([" ", " ", " ", "\t ", ". ", ", ", "\n", "\r\n", " ! "]))
        rows.append((rng.choice(["en", "de", None, "und", ""]), "".join(said)))
    rows += [("en", None), (None, ""), ("de", " .\n; "), ("xx", "alone"), ("en", "a a a a a a a a"), ("en", "New York " * 4000)]
    return rows + [rows[3]] * 150 + [("fr", "." * 3000 + "x" * 2_000_000)]


def frame(spark, rows, parts):
    return spark.createDataFrame([(i, *r, 1, "x", 2, "y", 3, 4) for i, r in enumerate(rows)], SCHEMA).repartition(parts)


def run(df, **more):
    return sorted(tuple(r) for r in c.collocations(df, **more).collect())


@pytest.mark.parametrize("parts, file_bytes, shard_words", [(1, 16 << 20, 8_000_000), (4, 16 << 20, 8_000_000), (3, 4000, 900)])
def test_collocations(spark, parts, file_bytes, shard_words):
    rows = some_rows()
    found = run(frame(spark, rows, parts), file_bytes=file_bytes, shard_words=shard_words)
    assert found == plainly(rows) and len(found) > 5


def test_support_top_and_length(spark):
    rows = some_rows(200, 9)
    df = frame(spark, rows, 4)
    for more in ({"support": 7, "top": 30}, {"support": 3, "longest": 3}, {"support": 1, "top": 50, "longest": 2}, {"support": 10**6}):
        assert run(df, file_bytes=3000, shard_words=2000, **more) == plainly(rows, **more)


def test_nothing(spark):
    assert run(frame(spark, [], 1)) == []
    assert run(frame(spark, [(None, None), ("en", ""), ("en", " . ")], 2)) == []


def test_shards_report_less_than_they_hold(spark, monkeypatch):
    """Mining at the local support spares most phrases the global count, and loses none that is frequent."""
    rows = some_rows(1500, 2)
    corpus = c.Corpus(frame(spark, rows, 4), "lang", "text", 100, "und", 10_000, 2_500)
    assert corpus.shards.count() > 4
    assert max(v for r in corpus.shards.collect() for v in r["local"].values()) > 5
    none = spark.sparkContext.broadcast(corpus.frequent)
    wanted = corpus.candidates(1, none)
    _, f = counts(rows, 1)
    found = corpus.counted(1, none, spark.sparkContext.broadcast(wanted)).collect()
    assert {(r["lang"], (r["phrase"],)): r["f"] for r in found} == {p: a for p, a in f.items() if a >= 100}
    reported = int(np.unpackbits(wanted).sum())
    assert len(found) <= reported < len(f)


def test_counts_of_files_are_merged():
    rng = np.random.default_rng(1)
    found = []
    for n in (30, 0, 50, 1):
        keys = np.unique(rng.integers(0, 60, n).astype(np.uint64))
        found.append((keys, np.arange(len(keys)), rng.integers(1, 9, len(keys))))
    total, told = Counter(), {}
    for i, (keys, _, n) in enumerate(found):
        for j, (k, m) in enumerate(zip(keys.tolist(), n.tolist())):
            total[k] += m
            told.setdefault(k, (i, j))
    got = {(i, int(j)): int(m) for i, (which, sums) in enumerate(c.merged(found)) for j, m in zip(which, sums)}
    assert got == {told[k]: m for k, m in total.items()}
    assert [len(w) for w, _ in c.merged([(np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)])] == [0]


def test_shard_file_round_trip(tmp_path):
    table = pa.table({"__lang": ["en", "de", "en"], "__text": ["A b. c  a", None, "b,b\tA"]})
    name = f"file://{tmp_path}/shard"
    assert c.write_shard(name, table) == {"en": 7}
    shard = c.open_shard(name)
    said = [shard.words[int(t)].as_py() for t in shard.tokens]
    assert said == [b"", b"a", b"b", b"", b"c", b"a", b"", b"b", b"", b"b", b"a"]


def spread_rows(seed=3):
    """Words ``often*`` 120 times and ``rare*`` 72 times, spread over all rows by chance."""
    rng = random.Random(seed)
    rows = [("en" if i % 3 else "de", f"often{i} rare{i} often{i}") for i in range(30) for _ in range(60)]
    rows += [("en" if i % 3 else "de", f"rare{i}") for i in range(30) for _ in range(12)]
    rng.shuffle(rows)
    return rows


def test_candidates_are_few_more_than_the_frequent_phrases(spark):
    """Many shards have low local supports: what one of them finds frequent by chance is no candidate yet."""
    rows = spread_rows()
    corpus = c.Corpus(frame(spark, rows, 3), "lang", "text", 100, "und", 500, 250)
    assert corpus.count > 15
    none = spark.sparkContext.broadcast(corpus.frequent)
    wanted = corpus.candidates(1, none)
    _, f = counts(rows, 1)
    frequent = {p: a for p, a in f.items() if a >= 100}
    assert len(frequent) == 30 and len(f) == 60
    assert 30 <= int(np.unpackbits(wanted).sum()) <= 36
    found = corpus.counted(1, none, spark.sparkContext.broadcast(wanted)).collect()
    assert {(r["lang"], (r["phrase"],)): r["f"] for r in found} == frequent


@pytest.mark.parametrize("most_held", [1 << 21, 8])
def test_counting_rows_follow_tasks_and_not_shards(spark, monkeypatch, most_held):
    rows = spread_rows()
    monkeypatch.setattr(c, "MOST_HELD", most_held)
    corpus = c.Corpus(frame(spark, rows, 3), "lang", "text", 100, "und", 500, 250)
    tasks = corpus.groups.rdd.getNumPartitions()
    assert sum(r["shard"] is not None for r in corpus.groups.collect()) == corpus.count
    none = spark.sparkContext.broadcast(corpus.frequent)
    every = spark.sparkContext.broadcast(np.full(len(corpus.frequent), 255, dtype=np.uint8))
    made = corpus.partial(1, none, every)
    if most_held > 8 and tasks < corpus.count:
        assert made.count() <= 60 * tasks
    got = {r["hash"]: r["f"] for r in made.selectExpr("hash", f"packed & {(1 << 36) - 1} as f").groupBy("hash").sum("f").withColumnRenamed("sum(f)", "f").collect()}
    _, f = counts(rows, 1)
    assert sorted(got.values()) == sorted(f.values())


def test_phrases_at_the_support_in_uneven_shards(spark):
    """A phrase with exactly the support is found wherever its occurrences lie, one below it is not."""
    rng = random.Random(8)
    for where in ("one", "first", "all"):
        rows = [(rng.choice(["en", "en", "de"]), " ".join(rng.choice("pqrstuv") + str(rng.randrange(40)) for _ in range(9))) for _ in range(900)]
        at = {"one": [450] * 20, "first": list(range(0, 60, 3)), "all": list(range(0, 900, 45))}[where]
        for i, j in enumerate(at):
            rows.insert(j, ("en", "ever green"))
            if i:
                rows.insert(j, ("en", "never red"))
        assert run(frame(spark, rows, 1), support=20, file_bytes=900, shard_words=300) == plainly(rows, 20)


def test_shares_of_a_place_add_up(spark):
    bits, rng = 10, np.random.default_rng(5)
    places, shares = rng.integers(0, 1 << bits, 3000), rng.integers(1, c.FULL // 2, 3000)
    rows = [r for x in range(0, 3000, 500) for r in c.segments(places[x : x + 500], shares[x : x + 500], bits).to_pylist()]
    df = spark.createDataFrame([(r["segment"], r["places"], r["shares"]) for r in rows], c.SEGMENT).repartition(4)
    held = np.unpackbits(c.bitmap_of(df, bits), bitorder="little").astype(bool)
    assert (held == (np.bincount(places, shares, 1 << bits) >= c.FULL)).all() and 0 < held.sum() < 1 << bits


def test_sums_of_several_shards():
    rng = np.random.default_rng(2)
    held, total, most = [], Counter(), {}
    for n in (30, 0, 50, 1):
        keys = rng.choice(70, n, replace=False).astype(np.uint64)
        held.append((keys, rng.integers(1, 9, n), rng.integers(0, 20, n)))
        for k, m, number in zip(*(x.tolist() for x in held[-1])):
            total[k] += m
            most[k] = max(most.get(k, 0), number)
    keys, sums, numbers = (x.tolist() for x in c.summed(held))
    assert dict(zip(keys, sums)) == total and dict(zip(keys, numbers)) == most and keys == sorted(total)
    assert [len(x) for x in c.summed([held[1]])] == [0, 0, 0]
