"""Words, windows and hashes against bytes.split; Simple-8b and Feistel round trips; the Hilbert curve."""

import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))

from abundix.llm import class_lm, host_rules, jaccard_rtree, mixing, simple8b  # noqa: E402
from abundix.llm.hilbert import hilbert_index  # noqa: E402
from abundix.llm.words import windows, word_slices  # noqa: E402
from plainly import measures  # noqa: E402

TEXT = st.one_of(st.none(), st.text(alphabet="ab \n\t\x0b\x85\xa0é#|.", max_size=60))


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=8), st.sampled_from([1, 20, 4096]))
def test_words_are_those_of_bytes_split(texts, size):
    got, keys = [], {}
    for part in word_slices(pa.array(texts, pa.string()), max_bytes=size):
        hashes = part.hashes()
        for low, high in zip(part.bounds[:-1], part.bounds[1:]):
            own = [part.word(i) for i in range(low, high)]
            got.append(own)
            for word, key in zip(own, hashes[low:high].tolist()):
                assert keys.setdefault(word, key) == key
    assert got == [(t or "").encode().split() for t in texts]
    assert len(set(keys.values())) == len(keys)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12), max_size=5), st.integers(1, 5))
def test_windows_stay_in_their_row(rows, width):
    part = next(word_slices(pa.array([b" ".join(r).decode() for r in rows] or [""])))
    starts, keys = windows(part.hashes(), part.bounds, width)
    wanted = [tuple(r[i : i + width]) for r in rows for i in range(len(r) - width + 1)]
    assert len(starts) == len(wanted)
    assert len(set(keys.tolist())) == len(set(wanted)) == len(set(zip(wanted, keys.tolist())))


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_measures(texts):
    for part in word_slices(pa.array(texts, pa.string())):
        found = host_rules.measure(part)
        for i, text in enumerate(texts):
            assert {k: int(found[k][i]) for k in measures(text)} == measures(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_simple8b_round_trip(ids):
    held = np.array(ids, dtype=np.uint64)
    packed, counts, escaped = simple8b.pack(held)
    assert (simple8b.unpack(packed, counts, escaped)[: len(held)] == held).all()
    if len(ids) > 1 and max(ids) < 2**15:
        assert len(packed) * 2 < len(ids) + 2 * len(counts)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 300), st.integers(0, 2**32))
def test_permutation(size, key):
    out = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, np.uint64(key)))
    assert sorted(out.tolist()) == list(range(size))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 99))
def test_splitting_tree_is_exact(quotas, shards, seed):
    out = mixing.split_quotas(np.array(quotas), shards, seed)
    assert out.sum(axis=0).tolist() == quotas and (out >= 0).all()
    sums = out.sum(axis=1)
    assert sums.max() - sums.min() <= 1
    assert (out == mixing.split_quotas(np.array(quotas), shards, seed)).all()


def test_capped_shares():
    shares = mixing.capped_shares([10, 100, 0, 40], [3, 1, 2, 2], 225, 2)
    assert shares == [20, 125, 0, 80]
    assert mixing.capped_shares([], [], 0, 2) == []


def test_hilbert_curve_visits_all_by_single_steps():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    index = hilbert_index(cells, 3)
    assert sorted(index.tolist()) == list(range(512))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    tokens, types = np.array([50.0, 30.0, 7.0]), np.array([5.0, 9.0, 7.0])
    moves = rng.integers(0, 9, (5, 5)).astype(float)
    moves[:, 4] = 0
    chance = 10 ** class_lm.transition_scores(moves.reshape(-1), tokens, types, 12, 3)
    known = (tokens - class_lm.DISCOUNT * types) / tokens
    assert np.allclose(chance[:, :3] @ known + chance[:, 3] + chance[:, 4], 1)
    assert class_lm.transition_scores(None, tokens * 0, types * 0, 0, 3) is None


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 60))
def test_tree_and_pivots_find_the_components(seed, n):
    rng = np.random.default_rng(seed)
    bases = [np.unique(rng.integers(0, 2**52, 40).astype(np.uint64)) for _ in range(4)]
    sets = []
    for _ in range(n):
        base = bases[rng.integers(0, 4)].copy()
        base[rng.integers(0, len(base), rng.integers(0, 8))] = rng.integers(0, 2**52, 1).astype(np.uint64)
        sets.append(np.unique(base))
    parts = jaccard_rtree.Parts(n)
    for i in range(n):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                parts.join(i, j)
    assert (jaccard_rtree.components(sets, 85) == parts.labels()).all()
    at, sizes = jaccard_rtree.points(sets), np.array([len(s) for s in sets])
    tree = jaccard_rtree.Tree(at, sizes)
    for i in range(min(n, 5)):
        near = set(tree.near(at[i], int(sizes[i]), 85).tolist())
        linked = {j for j in range(n) if 100 * len(np.intersect1d(sets[i], sets[j])) * 185 >= 85 * 100 * (sizes[i] + sizes[j])}
        assert linked <= near
