"""Class-based bigram model (Brown et al. 1992) with classes from exchange clustering (Kneser, Ney 1993).

P(word | previous) = P(class of word | class of previous) * P(word | class). Training, all in passes over chunks:

1. every distinct word of a chunk, by its 64-bit hash, is counted; the ``core_words`` most frequent are the core;
2. pairs of neighbours in the core are counted; rounds of the exchange then move each core word of one half to
   the class that raises the likelihood most, its own counts taken out of its old class, with the counts of the
   other half standing still (classes as of the last round make the moves of a round independent);
3. every other word is exchanged once: all its core neighbours, over the whole corpus, choose its class;
4. chunks are answered counts and classes of their own words, turn texts into classes, and count transitions.

Emissions are discounted by ``DISCOUNT`` a word; the mass goes to words never seen. Transitions are smoothed with
the classes' own shares; those after an unseen word are taken from what follows words seen once. The text begins
after an end token and ends with one. Probabilities of all words and the unseen word sum to 1 after any word.

Defined results: NULL text is the empty text (the end token alone); a NULL key trains; repeated rows count each;
with nothing to train on, the score is the base; an empty table gives no rows; other columns are not read. What
is held on the driver and sent to tasks depends on ``core_words`` and ``classes`` only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundix.llm.chunks import bucket_count, each_chunk, stage_chunks, visit_answers
from abundix.llm.words import Words, ranges, word_slices
from abundix.session import cut_lineage

DISCOUNT = 0.75
PULL = 2.0
HAPAX = 128


def sum_arrays(df: DataFrame, column: str, kind: str = "<f8", groups: int = 4) -> np.ndarray | None:
    """Sum of equally long packed arrays, one from each task; a few tasks add up groups, the driver the few sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                own = np.frombuffer(packed, dtype=kind)
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    once = df.select(column).repartition(groups).mapInArrow(add, "sum binary")
    parts = [np.frombuffer(r["sum"], dtype=kind) for r in once.collect()]
    return np.sum(parts, axis=0) if parts else None


def training(table: pa.Table) -> pa.Table:
    return table.filter(pa.compute.invert(table.column("held_out")))


def spread_codes(words: Words, codes: np.ndarray, end: int) -> np.ndarray:
    """End, then the codes of each row followed by an end: neighbours in it are the bigrams of all rows."""
    out = np.full(len(codes) + len(words.bounds), end, dtype=np.int64)
    out[np.arange(len(codes)) + words.row + 1] = codes
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def parts_of(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket, then hash, of distinct sorted hashes, and the border of each bucket."""
    owner = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return order, np.searchsorted(owner[order], np.arange(buckets + 1))


def distinct_words(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of all rows of a chunk, and how often each occurs in training rows."""
    held, keys, counts = table.column("held_out").to_numpy(), [], []
    for words in word_slices(table.column("__text"), lower=True):
        trains = ~held[words.first : words.last][words.row]
        own, inverse = np.unique(words.hashes(), return_inverse=True)
        keys.append(own)
        counts.append(np.bincount(inverse, weights=trains, minlength=len(own)).astype(np.int64))
    return summed(np.concatenate(keys), np.concatenate(counts))


class Core:
    """The most frequent words by hash; the end token has the next number."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.size = len(hashes)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 outside the core."""
        if self.size == 0:
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def exchange(pairs: DataFrame, core: Core, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each core word and of the end (``classes``), and the counts of class pairs."""
    size, end, wide = core.size, core.size, classes + 1
    belongs = np.concatenate([np.argsort(np.argsort(-core.counts, kind="stable"), kind="stable") % classes, [classes]])

    def neighbours(belongs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word, how often each class follows and precedes it."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, some = np.zeros((2, (size + 1) * wide)), False
            for batch in batches:
                some = some or batch.num_rows > 0
                for packed, n in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                    keys, n = np.frombuffer(packed, dtype=np.int64), np.frombuffer(n, dtype=np.int64)
                    left, right = keys // (size + 1), keys % (size + 1)
                    out[0] += np.bincount(left * wide + belongs[right], weights=n, minlength=out.shape[1])
                    out[1] += np.bincount(right * wide + belongs[left], weights=n, minlength=out.shape[1])
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

        total = sum_arrays(pairs.mapInArrow(count, "sums binary"), "sums")
        total = np.zeros(2 * (size + 1) * wide) if total is None else total
        after, before = total.reshape(2, size + 1, wide)
        return after, before

    for turn in range(rounds):
        after, before = neighbours(belongs)
        best = better_classes(after, before, belongs, classes)
        half = np.arange(size) % 2 == turn % 2
        moved = half & (best != belongs[:size])
        belongs[:size] = np.where(half, best, belongs[:size])
        if turn > 2 and moved.sum() * 1000 < size:
            break
    after, _ = neighbours(belongs)
    joint = np.zeros((wide, wide))
    np.add.at(joint, belongs, after)
    return belongs, joint


def better_classes(after: np.ndarray, before: np.ndarray, belongs: np.ndarray, classes: int) -> np.ndarray:
    """For each word the class with the largest likelihood, its own counts taken out of the class it is in."""
    size = len(belongs) - 1
    joint = np.zeros((classes + 1, classes + 1))
    np.add.at(joint, belongs, after)
    rows, columns = joint.sum(axis=1), joint.sum(axis=0)
    after, before, own = after[:size], before[:size], belongs[:size]
    score = after @ np.log(joint + 0.5).T + before @ np.log(joint + 0.5)
    score -= after.sum(axis=1)[:, None] * np.log(rows + 1)[None] + before.sum(axis=1)[:, None] * np.log(columns + 1)[None]
    out_row = np.maximum(joint[own] - after, 0)
    out_column = np.maximum(joint.T[own] - before, 0)
    here = (after * np.log(out_row + 0.5)).sum(axis=1) + (before * np.log(out_column + 0.5)).sum(axis=1)
    here -= after.sum(axis=1) * np.log(np.maximum(rows[own] - after.sum(axis=1), 0) + 1)
    here -= before.sum(axis=1) * np.log(np.maximum(columns[own] - before.sum(axis=1), 0) + 1)
    score[np.arange(size), own] = here
    return np.argmax(score[:, :classes], axis=1)


WORDS = "chunk string, bucket int, hashes binary, counts binary, n_near binary, near binary"
SAID = "chunk string, bucket int, counts binary, classes binary, tokens array<double>, types array<double>"


def context_rows(name: str, table: pa.Table, core: Core, belongs: np.ndarray, classes: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """For each bucket: distinct words, counts, and the classes of core neighbours (before: c, after: wide + c)."""
    hashes, counts = distinct_words(table)
    wide, end = classes + 1, classes
    place, near = [], []
    for words in word_slices(training(table).column("__text"), lower=True):
        own = words.hashes()
        codes = core.codes(own)
        kinds = np.where(codes >= 0, belongs[codes], -1)
        line = spread_codes(words, kinds, end)
        at = np.arange(len(own)) + words.row + 1
        rare = np.flatnonzero(codes < 0)
        rank = np.searchsorted(hashes, own[rare])
        for side, shift in ((-1, 0), (1, wide)):
            seen = line[at[rare] + side]
            known = seen >= 0
            place.append(rank[known])
            near.append((seen[known] + shift).astype(np.uint8))
    place = np.concatenate(place) if place else np.zeros(0, dtype=np.int64)
    near = np.concatenate(near) if near else np.zeros(0, dtype=np.uint8)
    near = near[np.argsort(place, kind="stable")]
    n_near = np.bincount(place, minlength=len(hashes)).astype(np.int64)
    begin = np.cumsum(n_near) - n_near
    order, borders = parts_of(hashes, buckets)
    for b in np.flatnonzero(np.diff(borders)).tolist():
        own = order[borders[b] : borders[b + 1]]
        packed = (hashes[own], counts[own].astype(np.uint32), n_near[own].astype(np.uint32), near[ranges(begin[own], n_near[own])])
        arrays = [pa.array([name]), pa.array([b], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in packed]]
        yield pa.RecordBatch.from_arrays(arrays, names=["chunk", "bucket", "hashes", "counts", "n_near", "near"])


def classify(table: pa.Table, core: Core, belongs: np.ndarray, classes: int, gains: np.ndarray) -> pa.Table:
    """Counts and classes of all words of a bucket, for each chunk in its own order, and the sums by class."""
    get = lambda column, kind: [np.frombuffer(x, dtype=kind) for x in table.column(column).to_pylist()]
    hashes, counts, n_near, near = get("hashes", np.uint64), get("counts", np.uint32), get("n_near", np.uint32), get("near", np.uint8)
    vocabulary = np.unique(np.concatenate(hashes))
    total = np.zeros(len(vocabulary), dtype=np.int64)
    places = [np.searchsorted(vocabulary, h) for h in hashes]
    for at, n in zip(places, counts):
        total[at] += n
    codes = core.codes(vocabulary)
    kinds = np.where(codes >= 0, belongs[codes], 0)
    spot = np.concatenate([np.repeat(at, n) for at, n in zip(places, n_near)])
    side = np.concatenate(near).astype(np.int64)
    order = np.argsort(spot, kind="stable")
    spot, side = spot[order], side[order]
    step = 1 << 14
    for low in range(0, len(vocabulary), step):
        a, b = np.searchsorted(spot, [low, low + step])
        seen = np.bincount((spot[a:b] - low) * len(gains) + side[a:b], minlength=step * len(gains)).reshape(step, len(gains))
        seen = seen[: len(vocabulary) - low]
        best = np.argmax(seen @ gains, axis=1)
        outside = codes[low : low + step] < 0
        kinds[low : low + step] = np.where(outside, best, kinds[low : low + step])
    known = total > 0
    tokens = np.bincount(kinds[known], weights=total[known], minlength=classes).tolist()
    types = np.bincount(kinds[known], minlength=classes).astype(float).tolist()
    names = table.column("chunk").to_pylist()
    bucket = table.column("bucket").to_pylist()
    return pa.table(
        [
            pa.array([*names, None], pa.string()),
            pa.array([*bucket, bucket[0]], pa.int32()),
            pa.array([*[total[at].tobytes() for at in places], b""], pa.binary()),
            pa.array([*[kinds[at].astype(np.uint8).tobytes() for at in places], b""], pa.binary()),
            pa.array([*[None] * len(names), tokens], pa.list_(pa.float64())),
            pa.array([*[None] * len(names), types], pa.list_(pa.float64())),
        ],
        names=["chunk", "bucket", "counts", "classes", "tokens", "types"],
    )


def class_gains(joint: np.ndarray, classes: int) -> np.ndarray:
    """Log-likelihood of each class (columns) for a neighbour of each class before and after (rows)."""
    smooth = joint + 0.5
    rows, columns = smooth.sum(axis=1), smooth.sum(axis=0)
    before = np.log(smooth / columns[None])[:, :classes]
    after = np.log(smooth / rows[:, None]).T[:, :classes]
    return np.concatenate([before, after])


def score_documents(
    docs: DataFrame,
    held_out: Column,
    *,
    key: str = "doc_id",
    text: str = "text",
    classes: int = 60,
    core_words: int = 4096,
    rounds: int = 16,
) -> DataFrame:
    """Trains on rows where ``held_out`` is not true and scores all rows.

    Returns key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) and perplexity.
    """
    if not 1 < classes <= 62:
        raise ValueError("between 2 and 62 classes")
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    manifest = stage_chunks(rows, "__text")
    buckets = bucket_count(manifest)
    wide, end = classes + 1, classes

    def count(name: str, table: pa.Table) -> Iterator[pa.RecordBatch]:
        hashes, counts = distinct_words(table)
        hashes, counts = hashes[counts > 0], counts[counts > 0]
        order, borders = parts_of(hashes, buckets)
        used = np.flatnonzero(np.diff(borders)).tolist()
        cut = lambda x, b: x[order[borders[b] : borders[b + 1]]].tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used, pa.int32()),
                pa.array([cut(hashes, b) for b in used], pa.binary()),
                pa.array([cut(counts.astype(np.uint32), b) for b in used], pa.binary()),
            ],
            names=["bucket", "hashes", "counts"],
        )

    def most_frequent(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()])
        n = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in table.column("counts").to_pylist()]).astype(np.int64)
        keys, n = summed(keys, n)
        top = np.argsort(-n, kind="stable")[:core_words]
        return pa.table([pa.array(keys[top].view(np.int64)), pa.array(n[top])], names=["hash", "n"])

    counted = each_chunk(manifest, count, "bucket int, hashes binary, counts binary")
    tops = counted.groupBy("bucket").applyInArrow(most_frequent, "hash long, n long")
    top = tops.orderBy(F.desc("n"), "hash").limit(core_words).collect()
    core = Core(np.array([r["hash"] for r in top], dtype=np.int64).view(np.uint64), np.array([r["n"] for r in top], dtype=np.int64))
    size = core.size

    def pair_rows(name: str, table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = []
        for words in word_slices(training(table).column("__text"), lower=True):
            line = spread_codes(words, core.codes(words.hashes()), size)
            both = (line[:-1] >= 0) & (line[1:] >= 0)
            keys.append((line[:-1] * (size + 1) + line[1:])[both])
        if not keys:
            return
        own, n = np.unique(np.concatenate(keys), return_counts=True)
        owner = own % 64
        for part in range(64):
            here = owner == part
            if here.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([own[here].tobytes()], pa.binary()), pa.array([n[here].astype(np.int64).tobytes()], pa.binary())],
                    names=["part", "keys", "counts"],
                )

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            more = [np.frombuffer(x, dtype=np.int64) for x in batch.column("keys").to_pylist()]
            counts = [np.frombuffer(x, dtype=np.int64) for x in batch.column("counts").to_pylist()]
            keys, n = summed(np.concatenate([keys, *more]), np.concatenate([n, *counts]))
        yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["keys", "counts"])

    pairs = each_chunk(manifest, pair_rows, "part int, keys binary, counts binary").groupBy("part")
    # at most core_words squared pairs, so a few tasks suffice; each sends one table of sums
    pairs = cut_lineage(pairs.applyInArrow(merge, "keys binary, counts binary").coalesce(16))
    belongs, joint = exchange(pairs, core, classes, rounds)
    gains = class_gains(joint, classes)

    def contexts(name: str, table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from context_rows(name, table, core, belongs, classes, buckets)

    def decide(table: pa.Table) -> pa.Table:
        return classify(table, core, belongs, classes, gains)

    said = cut_lineage(each_chunk(manifest, contexts, WORDS).groupBy("bucket").applyInArrow(decide, SAID))
    sums = said.where("chunk is null").select(F.posexplode(F.arrays_zip("tokens", "types")).alias("class", "x"))
    sums = sums.groupBy("class").agg(F.sum("x.tokens").alias("tokens"), F.sum("x.types").alias("types")).collect()
    tokens, types = np.zeros(classes), np.zeros(classes)
    for row in sums:
        tokens[row["class"]], types[row["class"]] = row["tokens"], row["types"]

    docs_trained = each_chunk(manifest, _training_rows, "n long").agg(F.sum("n")).first()[0] or 0
    n_all = int(tokens.sum()) + docs_trained
    v_all = int(types.sum()) + (1 if docs_trained else 0)
    base_floor = np.log10(n_all + 0.5 * (v_all + 1))

    def encode(name: str, table: pa.Table, answers: pa.Table) -> Iterator[pa.RecordBatch]:
        hashes, _ = distinct_words(table)
        order, borders = parts_of(hashes, buckets)
        counts, kinds = np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        for b, n, k in zip(*(answers.column(c).to_pylist() for c in ("bucket", "counts", "classes"))):
            own = order[borders[b] : borders[b + 1]]
            counts[own], kinds[own] = np.frombuffer(n, dtype=np.int64), np.frombuffer(k, dtype=np.uint8)
        base = np.log10(counts + 0.5) - base_floor
        with np.errstate(divide="ignore"):
            emits = np.where(counts > 0, np.log10(np.maximum(counts - DISCOUNT, 1e-9)) - np.log10(np.maximum(tokens[kinds], 1)), 0.0)
        codes = np.where(counts > 0, kinds + HAPAX * (counts == 1), wide)
        base_end = np.log10(docs_trained + 0.5) - base_floor
        for words in word_slices(table.column("__text"), lower=True):
            at = np.searchsorted(hashes, words.hashes())
            line = spread_codes(words, codes[at], end).astype(np.uint8)
            rows_of = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[words.bounds])
            borders_of = words.bounds + np.arange(len(words.bounds))
            part = table.slice(words.first, words.last - words.first)
            known = rows_of((counts[at] > 0).astype(float)).round().astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("__key").combine_chunks(),
                    part.column("held_out").combine_chunks(),
                    pa.array(words.counts.astype(np.int64) + 1),
                    pa.array(known + (1 if docs_trained else 0)),
                    pa.array(rows_of(base[at]) + base_end),
                    pa.array(rows_of(emits[at])),
                    pa.array([line[a + 1 : b + 1].tobytes() for a, b in zip(borders_of[:-1].tolist(), borders_of[1:].tolist())], pa.binary()),
                ],
                names=["__key", "held_out", "n_tokens", "n_known", "base_score", "emitted", "line"],
            )

    kind = rows.schema["__key"].dataType.simpleString()
    coded = f"__key {kind}, held_out boolean, n_tokens long, n_known long, base_score double, emitted double, line binary"
    lines = cut_lineage(visit_answers(manifest, said.where("chunk is not null").select("chunk", "bucket", "counts", "classes"), encode, coded))

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((wide + 1) * (wide + 1))
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                line = joined(batch.slice(low, 1024).column("line").to_pylist(), end)
                plain = np.where(line >= HAPAX, line - HAPAX, line)
                out += np.bincount(plain[:-1] * (wide + 1) + plain[1:], minlength=len(out))
                once = np.flatnonzero(line[:-1] >= HAPAX)
                out += np.bincount(wide * (wide + 1) + plain[once + 1], minlength=len(out))
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    moves = sum_arrays(lines.where(~F.col("held_out")).select("line").mapInArrow(transitions, "sums binary"), "sums")
    table_ = transition_scores(moves, tokens, types, docs_trained, classes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                packed = part.column("line").to_pylist()
                line = joined(packed, end)
                plain = np.where(line >= HAPAX, line - HAPAX, line)
                sums = np.concatenate([[0.0], np.cumsum(table_[plain[:-1], plain[1:]])]) if table_ is not None else np.zeros(len(line))
                found.append(np.diff(sums[np.concatenate([[0], np.cumsum([len(x) for x in packed])])]))
            moved = np.concatenate(found) if found else np.zeros(0)
            total = moved + batch.column("emitted").to_numpy() if table_ is not None else batch.column("base_score").to_numpy()
            kept = [batch.column(i) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [
                    *kept,
                    pa.array(np.full(batch.num_rows, n_all, dtype=np.int64)),
                    batch.column("base_score"),
                    pa.array(total),
                    pa.array(10.0 ** np.minimum(-total / batch.column("n_tokens").to_numpy(), 300)),
                ],
                names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    schema = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return lines.mapInArrow(score, schema)


def _training_rows(name: str, table: pa.Table) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array([training(table).num_rows], pa.int64())], names=["n"])


def joined(packed: list[bytes], end: int) -> np.ndarray:
    """An end, then the lines of all rows, each of which ends with an end."""
    return np.frombuffer(bytes([end]) + b"".join(packed), dtype=np.uint8).astype(np.int64)


def transition_scores(moves: np.ndarray | None, tokens: np.ndarray, types: np.ndarray, ends: int, classes: int) -> np.ndarray | None:
    """log10 of P(class | class before); the last column is P(unseen word | class before), the last row after one."""
    total = tokens.sum() + ends
    if moves is None or total == 0:
        return None
    wide = classes + 1
    counts = moves.reshape(wide + 1, wide + 1)[:, :wide]
    share = np.concatenate([tokens, [ends]]) / total
    chance = (counts + PULL * share[None]) / (counts.sum(axis=1, keepdims=True) + PULL)
    unseen = np.concatenate([DISCOUNT * types / np.maximum(tokens, 1), [0.0]])
    last = chance @ unseen
    return np.log10(np.maximum(np.concatenate([chance, last[:, None]], axis=1), 1e-300))

