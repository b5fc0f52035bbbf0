"""Vector codes against plain Python, on awkward rows."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from abundix.llm import lloyd
from abundix.llm.lloyd import Shape, fit, nearest, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code int, error string, __key int, label_error string"


def plainly(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [(k, [math.floor(scale * x) if abs(x) < 2**50 else int(x) * scale for x in v], label) for k, v, label in kept if len(v) == len(kept[0][1])]
    if not kept:
        return []
    size = len(kept[0][1])
    cut = lambda v, p: tuple(v[size * p // parts : size * (p + 1) // parts])
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    best = lambda x, book: min((far(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[best(cut(v, p), books[p])[1]].append(cut(v, p))
            for e, members in groups.items():
                books[p][e] = tuple(sum(c) // len(members) for c in zip(*members))
    said = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    out, sums = [], defaultdict(int)
    for key, v, label in kept:
        found = [best(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        sums[label] += error
        out.append([key, "".join(f"{e:02x}" for _, e in found), error if error < 2**63 else None, label])
    total = lambda label: sums[label] if sums[label] < 2**63 else None
    return sorted(((k, c, e, total(label), said) for k, c, e, label in out), key=str)


def run(df, **more):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes(df, **more).collect()), key=str)


def some_rows(n=300, size=24, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(9)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)], None if i % 11 == 0 else i % 4) for i in range(n)]
    rows += [(1000 + i, list(rows[20][1]), 1) for i in range(150)]  # a third of all rows have one vector
    rows += [rows[5], rows[5], (None, rows[9][1], 2), (7, rows[30][1], 3), (-3, [0.0] * size, 0), (-2, [0.0] * size, None)]
    rows += [(2000, None, 1), (2001, [None] + [0.1] * (size - 1), 1), (2002, [float("nan")] * size, 1), (2003, [float("inf")] + [0.0] * (size - 1), 2)]
    return rows + [(2004, [0.5] * (size - 1), 1), (2005, [], 1)]


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("parts", [1, 4])
def test_vector_codes(spark, parts):
    rows = some_rows()
    assert run(frame(spark, rows, parts)) == plainly(rows)


def test_lengths_that_do_not_divide_and_small_tables(spark):
    assert run(frame(spark, rows := some_rows(40, 11, 3))) == plainly(rows)
    assert run(frame(spark, rows := some_rows(40, 5, 4))) == plainly(rows)
    assert run(frame(spark, rows := [(1, [0.1] * 8, None), (2, [0.2] * 8, None)])) == plainly(rows)
    assert run(frame(spark, rows := [(1, [], None), (2, [], 4)])) == plainly(rows)
    assert run(frame(spark, [(1, None, 1)])) == [] and run(frame(spark, [])) == []


def test_huge_components(spark):
    rows = [(i, [((-1) ** i) * 10.0 ** (i % 40), 1.5 * i, 3.0, -7.25, 1e15 + i, 0.1, 2.0**40 * i, 9.0], i % 3) for i in range(60)]
    assert run(frame(spark, rows)) == plainly(rows)


def test_nearest_is_the_same_in_every_arithmetic():
    rng = np.random.default_rng(2)
    for top in (50, 2**24, 2**30, 2**45):
        members = rng.integers(-top, top, (200, 4))
        book = [[int(x) for x in row] for row in members[:7]]
        book.append(book[2])
        best, far = nearest(members, book)
        for x, b, d in zip(members.tolist(), best.tolist(), far.tolist()):
            assert (d, b) == min((sum((p - q) ** 2 for p, q in zip(x, c)), e) for e, c in enumerate(book))


def test_only_parts_that_change_their_entry_move(spark, monkeypatch):
    """Of each round's members, those that stay are not in the shuffle: a round moves what changed its entry, no more."""
    rows = [r for r in some_rows() if r[1] and None not in r[1] and all(map(math.isfinite, r[1])) and len(r[1]) == 24]
    df = frame(spark, rows).select("embedding")
    shape = Shape(tuple(3 * p for p in range(9)), 16, 4096, 2)
    first = [[math.floor(4096 * x) for x in r[1]] for r in rows[:16]]
    seen = []
    real = lloyd.reassigned

    def counted(residents, shape, books):
        out = real(residents, shape, books)
        sizes = out.map(lambda r: (r[1][0] is None, r[1][1][0])).reduceByKey(lambda a, b: a + b).collectAsMap()
        assert out.filter(lambda r: r[1][0] is not None and shape.place(r[0])[1] == shape.place(r[1][0])[1]).isEmpty()
        seen.append((sizes.get(True, 0), sizes.get(False, 0)))
        return out

    monkeypatch.setattr(lloyd, "reassigned", counted)
    fit(df, first, shape, 6)
    assert len(seen) == 5 and all(a + b == 8 * len(rows) for a, b in seen)
    assert seen[-1][1] < seen[-1][0] / 4
