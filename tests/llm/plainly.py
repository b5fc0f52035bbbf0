"""Brute-force versions of the operators, on lists of (doc_id, source, lang, text)."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib

import numpy as np


def words(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def measures(text):
    text = text or ""
    own = words(text)
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    seen = collections.Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
    covered = {i + j for i in range(len(own) - 7) if seen[tuple(own[i : i + 8])] > 1 for j in range(8)}
    return {
        "n_words": len(own),
        "word_chars": sum(len(w.decode()) for w in own),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def removed(texts, width=35):
    starts = collections.Counter()
    for text in texts:
        own = words(text)
        starts.update(tuple(own[i : i + width]) for i in range(len(own) - width + 1))
    out = []
    for text in texts:
        own = words(text)
        gone = [False] * len(own)
        for i in range(len(own) - width + 1):
            if starts[tuple(own[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = b" ".join(w for w, g in zip(own, gone) if not g)
        out.append((len(own), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, width):
    own = words(text, True)
    return frozenset(tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1))) if own else frozenset()


def jaccard_components(docs, width=4, percent=85):
    """(number of shingles, component) for each (key, text)."""
    sets = [shingles(text, width) for _, text in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return [(len(s), least.get(root(i))) for i, s in enumerate(sets)]


def unigram_scores(docs):
    """(held out, tokens, known, training tokens, base) for each (key, text)."""
    out_of = [key is not None and zlib.crc32(str(key).encode()) % 5 == 1 for key, _ in docs]
    tokens = [[*words(text, True), None] for _, text in docs]
    seen = collections.Counter(t for own, out in zip(tokens, out_of) if not out for t in own)
    total, kinds = sum(seen.values()), len(seen)
    score = lambda own: sum(math.log10((seen[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in own)
    return [(out, len(own), sum(seen[t] > 0 for t in own), total, score(own)) for own, out in zip(tokens, out_of)]


def contaminated(docs, items, width=13, errors=2, least=5):
    """Pairs of keys with an overlap, over all diagonals."""
    out = set()
    for key, text in docs:
        own = words(text, True)
        for item, wanted in items:
            other = words(wanted, True)
            if len(other) < least:
                continue
            span, most = min(width, len(other)), errors if len(other) >= width else 0
            for shift in range(-len(other) + 1, len(own)):
                low, high = max(0, -shift), min(len(other), len(own) - shift)
                agree = [own[i + shift] == other[i] for i in range(low, high)]
                if any(sum(agree[i : i + span]) >= span - most for i in range(len(agree) - span + 1)):
                    out.add((key, item))
    return out


def encoded(docs, tokenizer, end=2):
    """(key, start, number, crc32) in ascending order of key."""
    out, start = [], 0
    for key, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out
