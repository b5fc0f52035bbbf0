"""Every operator on awkward rows: NULLs, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import plainly  # noqa: E402
from abundix.llm import simple8b, warc_zstd  # noqa: E402
from abundix.llm.anchors import repeats  # noqa: E402
from abundix.llm.class_lm import score_documents  # noqa: E402
from abundix.llm.hilbert import hilbert_shards  # noqa: E402
from abundix.llm.host_rules import kept_documents, quality_rules  # noqa: E402
from abundix.llm.jaccard_rtree import jaccard_components  # noqa: E402
from abundix.llm.mixing import Mix, cycled_weights, with_word_counts  # noqa: E402
from abundix.llm.perspectives import rotate  # noqa: E402
from abundix.llm.spaced_seeds import contaminated  # noqa: E402

SCHEMA = (
    "doc_id long, source string, lang string, text string, n_words long, size string, slot int, shard int, chunk int, "
    "row long, target int, failures int, kept string, held_out int, node long, hash long, item_id string, url int"
)
PASSAGE = " ".join(f"passage{i}" for i in range(40))
ITEMS = [(1, PASSAGE.upper()), (2, "only five words are here"), (3, "too short"), (4, None), (5, ""), (5, "only five words are here")]


def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)] + ["the", "of", "Été", "ß#", "a|b", "|", "*x*"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = sentence(300)
    near = base.split()
    near[7] = "changed"
    changed = PASSAGE.split()
    changed[3] = changed[30] = "other"
    lines = "\n".join([sentence(6), "again and again", sentence(5), "again and again", "", " \t", "again and again"])
    out = [None, "", "  \n\t ", "one", "one two", "ONE two", "one two three", base, base, base.upper(), " ".join(near), lines]
    out += [sentence(4) + " " + PASSAGE + " " + sentence(9), "\n".join(changed), sentence(40) + " only FIVE words are here",
            "x y " * 60, sentence(25), sentence(5), "long " * 3 + sentence(30_000), "a b c\x85d e\x1cf " * 8, base + " " + PASSAGE]
    return out


@pytest.fixture(scope="module")
def rows():
    out = []
    for i, text in enumerate(texts()):
        source = None if i % 7 == 3 else f"s{i % 3}"
        out.append((i * 50, source, "en" if i % 2 else None, text))
    out += [out[7], out[16]]
    out.append((None, "s1", "de", "a row without a key and with words of its own in a text of some length that is clean and plain enough"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = (9, "size", 1, 2, 3, 4, 5, 6, "kept", 7, 8, 9, "item", 10)
    return spark.createDataFrame([(*r, *clash) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("doc_id = -1")


def pairs(rows):
    return [(r[0], r[3]) for r in rows]


def sized(docs):
    return with_word_counts(docs, "text", "size")


def test_mix_keeps_to_targets(docs, rows):
    mix = Mix(sized(docs), cycled_weights, block_words=64)
    got = mix.taken().collect()
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["lang"] in ("en", "de", None) and r["hash"] == 9
    assert Counter({r["source"]: r["source_size"] for r in got}) == sizes
    assert sum(sizes.values()) == sum(len(plainly.words(t)) for _, t in pairs(rows))
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for source, n in sizes.items():
        assert target[source] <= 2 * n + 1e-6 and abs(taken[source] - target[source]) <= max(64, n / 100)
    assert [tuple(r) for r in Mix(sized(docs.repartition(5)), cycled_weights, block_words=64).taken().orderBy("doc_id", "size", "taken").select("doc_id", "size", "taken").collect()] == sorted(
        ((r["doc_id"], r["size"], r["taken"]) for r in got), key=lambda r: (r[0] is not None, r)
    )


def test_mix_pieces_fill_shards(docs, spark):
    mix = Mix(sized(docs), cycled_weights, block_words=64, shard_words=4000)
    pieces = mix.pieces().collect()
    taken = mix.taken()
    assert sum(p["n_words"] for p in pieces) == taken.agg(F.sum("taken")).first()[0]
    spans, slots = defaultdict(list), defaultdict(list)
    for p in pieces:
        spans[p["doc_id"], p["epoch"], p["source"]].append((p["first_word"], p["first_word"] + p["n_words"]))
        slots[p["shard"]].append(p["slot"])
    for key, own in spans.items():
        own.sort()
        if key[0] not in (350, 800):
            assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))
    assert len(slots) > 3 and all(sorted(s) == list(range(1, len(s) + 1)) for s in slots.values())
    words = Counter()
    for p in pieces:
        words[p["shard"]] += p["n_words"]
    assert max(words.values()) < 1.5 * min(words.values())


def test_mix_taken_is_what_the_pieces_hold(docs):
    mix = Mix(sized(docs), cycled_weights, block_words=64, shard_words=4000)
    got, pieces = mix.taken().collect(), mix.pieces().collect()
    places = [tuple(p) for r in got for p in r["places"]]
    assert sorted(places) == sorted((p["shard"], p["slot"], p["first_word"], p["n_words"]) for p in pieces)
    assert all(r["taken"] == sum(p["n_words"] for p in r["places"]) for r in got)
    assert len({p[:2] for p in places}) == len(places) and len({p[0] for p in places}) > 3


def test_mix_of_nothing(nothing):
    mix = Mix(sized(nothing), cycled_weights)
    assert mix.taken().count() == 0 and mix.pieces().count() == 0


def test_whole_documents(docs):
    got = Mix(sized(docs), cycled_weights, whole_documents=True).taken().collect()
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)


def check_scores(got, rows):
    wanted = plainly.unigram_scores(pairs(rows))
    assert len(got) == len(rows)
    mine = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got)
    assert mine == sorted((str(k), *w[:4], round(w[4], 5)) for (k, _), w in zip(pairs(rows), wanted))


def crc_held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1


def test_scores(docs, rows):
    got = score_documents(docs, crc_held_out(), classes=8, core_words=40, rounds=5).collect()
    check_scores(got, rows)
    assert all(r["score"] < 0 and r["perplexity"] >= 1 for r in got)


def test_scores_without_training(docs, nothing):
    got = score_documents(docs, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["score"] == r["base_score"] and r["n_known"] == 0 for r in got)
    assert score_documents(nothing, crc_held_out()).count() == 0


def test_hilbert(docs, rows, nothing):
    column = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    got = hilbert_shards(docs.withColumn("size", column), ["source", "lang", "size"], 4, ties=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    slots, total = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in got)
    assert all(n <= sum(total.values()) / 4 + largest for n in total.values())
    assert hilbert_shards(nothing.withColumn("size", column), ["source", "size"], 4).count() == 0


def plain_hilbert(rows, shards, bits=8):
    """(row, curve, shard, slot) in the order of the curve, for rows of (source, lang, size, key, text)."""
    import math

    import numpy as np

    from abundix.llm.hilbert import hilbert_index

    octave = lambda n: math.floor(min(math.log2(n * 2.0**40 + 1.0), 1100.0) * 8)
    columns = [[r[0] for r in rows], [r[1] for r in rows], [octave(r[2]) for r in rows]]
    last = lambda x: (x is None, x if x is not None else "")
    cells = [[sum(last(y) < last(x) for y in own) * 2**bits // len(rows) for x in own] for own in columns]
    curve = hilbert_index(np.array(cells).T, bits).tolist()
    first = lambda x: (x is not None, x if x is not None else 0)  # noqa: E731  NULL keys come first
    order = sorted(range(len(rows)), key=lambda i: (curve[i], first(rows[i][3]), (rows[i][4] or "").encode(), rows[i][2]))
    out, before, slots, total = [], 0, Counter(), sum(r[2] for r in rows)
    for i in order:
        shard = min(int((before + rows[i][2] / 2) * (shards / total)), shards - 1)
        out.append((str(rows[i][3]), rows[i][2], curve[i], shard, slots[shard]))
        slots[shard] += 1
        before += rows[i][2]
    return sorted(out)


def test_hilbert_order_against_plain_python(docs, rows):
    column = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    sized = docs.withColumn("size", column).withColumn("body", F.coalesce("text", F.lit("")))
    got = hilbert_shards(sized, ["source", "lang", "size"], 4, ties=["doc_id", "body"]).collect()
    mine = [(r[1], r[2], len((r[3] or "").encode()) + 1, r[0], r[3]) for r in rows]
    assert sorted((str(r["doc_id"]), r["size"], r["curve"], r["shard"], r["slot"]) for r in got) == plain_hilbert(mine, 4)


def test_host_rules(docs, rows, nothing):
    got = quality_rules(docs).collect()
    mine = sorted([str(r["doc_id"]), *[r[m] for m in plainly.measures("")], r["base_failed"]] for r in got)
    wanted = []
    for key, text in pairs(rows):
        found = plainly.measures(text)
        failed = found["n_words"] < 20 or 100 * found["n_repeat_words"] > 30 * found["n_words"]
        wanted.append([str(key), *found.values(), failed])
    assert mine == sorted(wanted)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    kept = kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])
    assert quality_rules(nothing).count() == 0 and kept_documents(nothing).count() == 0


def test_bad_host_must_pass_every_rule(spark):
    clean = lambda i: " ".join(f"{chr(97 + (i + j) % 26)}ord{i}x{j}" for j in range(30))
    rows = [(i, "bad" if i < 40 else "good", clean(i) + (" ##" * 2 + " $$" * 2 if i % 4 or i == 40 else "")) for i in range(41)]
    rows += [(i, "good", clean(i)) for i in range(41, 90)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got == {i: not (i < 40 and i % 4) for i in range(90)}


def test_host_decides_borderline_documents(spark):
    clean = lambda i: " ".join(f"{chr(97 + (i + j) % 26)}ord{i}x{j}" for j in range(30))
    host = lambda i: f"h{i // 40}"
    some = lambda i: " " + "## " * 2 + "$$ " * 2
    rows = [(i, host(i), clean(i) + (some(i) if i < 18 or i == 50 else "")) for i in range(400)]
    rows += [(400, "h1", clean(400) + " ##########"), (401, "h2", "a " * 3 + clean(401))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: (r["kept"], r["host_rate"]) for r in quality_rules(df).collect()}
    assert {i for i, r in got.items() if not r[0]} == {*range(18), 400} and max(r[1] for r in got.values()) <= 0.5
    kept = {r["doc_id"] for r in kept_documents(df).collect()}
    assert kept == {i for i, r in got.items() if r[0]}
    # one host alone, NULL: its rate is the prior's mean, so no borderline document goes, but clear failures do
    alone = {r["doc_id"]: r["kept"] for r in quality_rules(df.withColumn("source", F.lit(None).cast("string"))).collect()}
    assert {i for i, k in alone.items() if not k} == {400}


def test_simple8b_files(docs, rows, nothing, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    keyed = docs.where("doc_id is not null and doc_id not in (350, 800)")
    got = simple8b.read_ids(simple8b.write_ids(keyed, path, file_bytes=40_000)).orderBy("doc_id").collect()
    own = sorted((k, t) for k, t in pairs(rows) if k is not None and k not in (350, 800))
    assert [tuple(r) for r in got] == plainly.encoded(own, plain)
    everything = simple8b.read_ids(simple8b.write_ids(docs, path)).orderBy("start").collect()
    assert everything[0]["doc_id"] is None and len(everything) == len(rows)
    assert simple8b.read_ids(simple8b.write_ids(nothing, path)).count() == 0


def test_rotation(spark):
    said = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (1, 3, None, "x")]
    said += [(2, 0, "system", "alone"), (3, None, "ann\nb", ""), (3, 5000, "bob", "later"), (None, 1, "bob", "lost"), (1, 2, "bob", "yo")]
    df = spark.createDataFrame([(*r, "clash") for r in said], "conv_id long, turn int, role string, text string, mask string")
    got = {(r["conv_id"], r["speaker"], r["part"]): r for r in rotate(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (3, "ann\nb", 0), (3, "bob", 0), (3, "ann\nb", 1), (3, "bob", 1), (None, "bob", 0)}
    ann = got[1, "ann", 0]
    assert ann["rendered"] == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob\nyo<|im_end|>\n"
        "<|im_start|>user name=bob\nyo<|im_end|>\n<|im_start|>user name=unknown\nx<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    )
    assert [ann["rendered"][s["start"] : s["end"]] for s in ann["mask"]] == ["hi < |im_end|><|im_end|>", "<|im_end|>"]
    assert got[3, "bob", 0]["mask"] == [] and "user name=ann b\n" in got[3, "bob", 0]["rendered"]
    assert (got[1, "bob", 0]["n_turns"], got[1, "bob", 0]["n_own"]) == (6, 2)
    assert rotate(df.where("conv_id = 9")).count() == 0


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join(docs, rows, nothing, width, percent):
    got = jaccard_components(docs, width=width, percent=percent).collect()
    wanted = plainly.jaccard_components(pairs(rows), width, percent)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(((k, n, c) for (k, _), (n, c) in zip(pairs(rows), wanted)), key=key)
    assert jaccard_components(nothing).count() == 0


def test_jaccard_chains_and_tiles(spark, monkeypatch):
    from abundix.llm import jaccard_rtree

    monkeypatch.setattr(jaccard_rtree, "TILE", 500)
    rng = random.Random(5)
    rows, text = [], [f"t{i}" for i in range(60)]
    for i in range(90):
        if i % 30 == 0:
            text = [f"{i}t{j}" for j in range(60)]
        text = list(text)
        text[rng.randrange(60)] = f"new{i}"
        rows.append((i, " ".join(text)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: c for (k, _), (_, c) in zip(rows, plainly.jaccard_components(rows))}


def test_decontamination(spark, docs, rows, nothing):
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, hits int")
    got = contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == plainly.contaminated(pairs(rows), ITEMS)
    assert {(600, 1), (650, 1), (700, 2), (700, 5), (1000, 1)} == {(r["doc_id"], r["item_id"]) for r in got}
    exact = next(r for r in got if r["doc_id"] == 600)
    assert (exact["doc_word"], exact["item_word"], exact["n_words"], exact["n_agree"]) == (4, 0, 40, 40)
    assert next(r for r in got if r["doc_id"] == 650)["n_agree"] == 38
    assert contaminated(nothing, items).count() == 0
    assert contaminated(docs, items.where("item_id = 9")).count() == 0


def test_short_items(spark):
    items = [(1, "yes"), (2, "so it is"), (3, "a b c d e f g h"), (4, "k1 k2 k3 k4 k5 k6 k7 k8 k9 k10 k11 k12"), (5, "five words are all here")]
    texts = ["Yes", "yes yes", "so it is", "and so it is", "x a b c d e f g h", "a b c d X f g h y", "a b X d Y f g h", "X b c d e f g h"]
    texts += [f"z {' '.join('other' if i == j else f'k{i}' for i in range(1, 13))} z" for j in range(1, 13)]
    texts += ["five words are not here", "now five words are all here", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    wanted = {(0, 1), (2, 2), (4, 3), (5, 3), (7, 3), (21, 5)} | {(i, 4) for i in range(8, 20)}
    assert {(r["doc_id"], r["item_id"]) for r in got} == wanted and len(got) == len(wanted)


def test_warc_bundles(spark):
    page = "<html>" + "é" * 700
    rows = [(1, "http://a/ x", page), (2, None, page), (3, "u", page), (3, "u", page), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, "u", None), (7, "", ""), (None, "u", page), (8, "u", "y" * 300_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    index = warc_zstd.write_bundles(df, frame_bytes=5000, bundle_bytes=3000)
    got = warc_zstd.read_bundles(index).collect()
    wanted = []
    for key, _, html in rows:
        body = (html or "").encode()
        again = html == page and key in (1, 2)
        wanted.append((key, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", 3 if again else None, True))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))
    assert index.select("bundle", "frame", "offset").distinct().count() == len(rows)
    assert warc_zstd.read_bundles(warc_zstd.write_bundles(df.where("page_id = 99"))).count() == 0


def test_repeats(docs, rows, nothing):
    got = [(str(r["doc_id"]), r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in repeats(docs).collect()]
    wanted = [(str(k), *found) for (k, _), found in zip(pairs(rows), plainly.removed([t for _, t in pairs(rows)]))]
    assert sorted(got) == sorted(wanted)
    spans = {r["doc_id"]: r["spans"] for r in repeats(docs).collect()}
    assert [tuple(s) for s in spans[600]] == [(4, 44)]
    assert repeats(nothing).count() == 0
