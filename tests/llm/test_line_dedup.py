"""Line dedup against plain Python, on awkward rows."""

import hashlib
import random
from collections import defaultdict

import pytest

from abundix.llm.line_dedup import deduplicated

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, n_lines string, kept int, __doc int, __key1 string, __gone int"


def lowered(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def plainly(rows, least_chars=20, least_docs=3):
    holders = defaultdict(set)
    for key, text in rows:
        for line in (text or "").split("\n"):
            if len(lowered(line)) >= least_chars:
                holders[lowered(line)].add(key)
    out = []
    for key, text in rows:
        lines = (text or "").split("\n")
        goes = []
        for line in lines:
            held = holders[lowered(line)]
            goes.append(len(held) >= least_docs and key != max((k for k in held if k is not None), default=None))
        kept = "\n".join(line for line, gone in zip(lines, goes) if not gone)
        out.append((key, len(lines), sum(goes), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def some_rows():
    rng = random.Random(5)
    pool = [f"  Line number {i} of the common pool\t" for i in range(12)] + ["short", "", "\x0b \r", "exactly twenty chars", "nineteen characters", "ÉCLAIR übermäßig groß 日本語 ok", "éCLAIR übermäßig groß 日本語 ok"]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) + (" x" if rng.random() < 0.2 else "") for _ in range(rng.randrange(9))]
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n"), (103, "\n\n"), (104, "LINE NUMBER 1 of the common pool\n" * 3000 + "end"), (105, "word " * 200_000)]
    rows += [(7, "Line number 2 of the common pool\nanother text under a key used before"), rows[3], rows[3], (None, pool[0] + "\nno key"), (None, pool[0] + "\nno key either")]
    rows += [(i, "the one line that a third of all rows have in common\nown " + str(i)) for i in range(200, 240)]
    return rows


@pytest.mark.parametrize("parts", [1, 5])
def test_line_dedup(spark, parts):
    rows = some_rows()
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], SCHEMA).repartition(parts)
    got = deduplicated(df).collect()
    found = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got), key=str)
    assert found == plainly(rows)
    assert sum(r[2] for r in found) > 100


def test_line_dedup_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert deduplicated(df).collect() == []
    nulls = spark.createDataFrame([(None, None), (1, None)], "doc_id long, text string")
    assert sorted(map(str, deduplicated(nulls).collect())) == sorted(map(str, deduplicated(nulls).collect()))
    assert {(r["n_lines"], r["n_dropped"], r["kept"]) for r in deduplicated(nulls).collect()} == {(1, 0, "")}


def test_no_python_worker(spark, capsys):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    deduplicated(df).explain()
    said = capsys.readouterr().out
    assert "Python" not in said and "Arrow" not in said and "Cartesian" not in said and "NestedLoop" not in said
