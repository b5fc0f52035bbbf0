"""Exact Jaccard join of word-shingle sets with a count-vector R-tree.

A set is a point: its shingles are hashed into groups and counted. The sum of coordinate minima of two points bounds
the overlap of the sets from above, also for a point and the corner of a rectangle, so a tree of rectangles over
the points prunes pairs that cannot reach the threshold; what survives is verified on the sets themselves.

The tree is cut at the top by fine groups (the hashes themselves): the rectangle of group g holds the points with a
count in g. A pair over the threshold shares one of the first n - ceil(t n) + 1 groups of both sets, in any order
that all sets follow, so a set enters only those rectangles. The order puts groups of one point first (an exchange
of packed hashes between chunks finds the others) and those that are frequent in the corpus last, so a set enters
a shared rectangle only if little of it is its own. Points whose rectangles touch form a candidate group; inside each, coordinates are the counts of ``GROUPS`` coarse groups, packed
into pages of ``PAGE`` points. Equal sets are one point, however many documents they stand for.

A candidate group works on its components rather than on all pairs: a few pivots are compared with all points at
once, then only points outside the largest component search the tree, for points of other components. Groups of
more than ``TILE`` shingles in all are split into tiles, every pair of tiles is a task of its own, and the links
of the tiles are joined.

Defined results: sets are the distinct runs of ``width`` lower-cased (A-Z) words, or the whole text if it has fewer;
NULL and empty texts have no set, no links and are their own component; NULL keys take part, the component is the
smallest key that is not NULL; repeated rows are documents; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundix.llm.chunks import REQUEST, answered, bucket_count, each_chunk, is_in, repeated_keys, requests, stage_chunks, visit_answers
from abundix.llm.skew import with_facts
from abundix.llm.words import Words, mix64, windows, word_slices
from abundix.operators.network import connected_components
from abundix.session import cut_lineage

GROUPS, PAGE = 64, 16
CELLS = 1 << 16
ROW_BITS, SET_BITS = 12, 52
TILE = 4_000_000
HALF = np.uint32
_LOW = np.uint64((1 << SET_BITS) - 1)


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of 52 bits, sorted by row and hash, and the border of each row."""
    hashes = words.hashes()
    starts, keys = windows(hashes, words.bounds, width, width)
    rows = np.searchsorted(words.bounds, starts, side="right") - 1
    rows, keys = [rows], [keys]
    for short in range(1, width):
        whole = np.flatnonzero(words.counts == short)
        if len(whole):
            at, own = windows(hashes, words.bounds, short, short)
            keys.append(own[np.searchsorted(at, words.bounds[whole])])
            rows.append(whole)
    joint = (np.concatenate(rows).astype(np.uint64) << np.uint64(SET_BITS)) | (np.concatenate(keys) & _LOW)
    joint = np.sort(joint)
    if len(joint):
        joint = joint[np.concatenate([[True], joint[1:] != joint[:-1]])]
    bounds = np.searchsorted(joint >> np.uint64(SET_BITS), np.arange(len(words.counts) + 1, dtype=np.uint64))
    return joint & _LOW, bounds


def sets_of(table: pa.Table, width: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    for words in word_slices(table.column("__text"), lower=True, max_rows=1 << ROW_BITS):
        yield (words, *shingle_sets(words, width))


def cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(CELLS - 1)).astype(np.int64)


def fingerprints(shingles: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits of each set, whatever the order of its members."""
    sums = []
    for seed in (1, 2):
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(shingles, seed))])
        sums.append(mix64(total[bounds[1:]] - total[bounds[:-1]], seed))
    return [a.tobytes() + b.tobytes() for a, b in zip(*sums)]


def frequency_classes(cells: np.ndarray) -> np.ndarray:
    """0 for cells near the mean, then one class for every doubling of the square of the excess; 15 at most."""
    mean = max(cells.mean(), 1.0)
    excess = np.maximum(cells - mean, 0) / (4 * np.sqrt(mean))
    return np.where(excess <= 1, 0, np.minimum(15, 1 + np.floor(2 * np.log2(np.maximum(excess, 1))))).astype(np.uint64)


def prefix(shingles: np.ndarray, bounds: np.ndarray, shared: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """Places of the shingles that each set is indexed by: the first n - ceil(t n) + 1, rarest first."""
    counts = np.diff(bounds)
    row = np.repeat(np.arange(len(counts)), counts)
    # 12 bits of row, 5 of frequency, 47 of hash; equal keys stay in the order of the whole hash
    often = np.where(shared, np.uint64(16) | classes[cell(shingles)], np.uint64(0))
    key = (row.astype(np.uint64) << np.uint64(52)) | (often << np.uint64(47)) | (shingles >> np.uint64(5))
    order = np.argsort(key, kind="stable")
    length = np.where(counts > 0, counts - -(-percent * counts // 100) + 1, 0)
    inside = np.arange(len(order)) - bounds[:-1][row]
    return order[inside < length[row]]


def points(sets: list[np.ndarray]) -> np.ndarray:
    """Counts of each set in the coarse groups."""
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    group = (mix64(np.concatenate(sets)) % np.uint64(GROUPS)).astype(np.int64)
    return np.bincount(row * GROUPS + group, minlength=len(sets) * GROUPS).reshape(len(sets), GROUPS).astype(np.int32)


class Tree:
    """Pages of points packed by size and coordinates; a page knows its corner and its smallest size."""

    def __init__(self, at: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((at[:, 1], at[:, 0], sizes))
        self.levels = []
        corner, least = at[order], sizes[order]
        self.order = order
        while True:
            self.levels.append((corner, least))
            if len(least) <= PAGE:
                break
            cuts = np.arange(0, len(least), PAGE)
            corner, least = np.maximum.reduceat(corner, cuts), np.minimum.reduceat(least, cuts)

    def near(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Points whose bound lets them reach the threshold with this one."""
        found = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, least = self.levels[depth]
            bound = np.minimum(corner[found], point).sum(axis=1)
            found = found[bound * (100 + percent) >= percent * (size + least[found])]
            if depth:
                below = len(self.levels[depth - 1][1])
                found = (found[:, None] * PAGE + np.arange(PAGE)).reshape(-1)
                found = found[found < below]
        return self.order[found]


class Parts:
    """Union and find over 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)

    def labels(self) -> np.ndarray:
        flat = self.up.copy()
        while True:
            up = flat[flat]
            if (up == flat).all():
                return flat
            flat = up


def linked(overlap, a, b, percent: int):
    return 100 * overlap >= percent * (a + b - overlap)


def components(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Label of each set: the least index that links reach."""
    n = len(sets)
    parts = Parts(n)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    cuts = np.cumsum(sizes) - sizes
    pivots = np.unique(np.linspace(0, n - 1, min(n, 4 + int(n**0.5) // 2)).astype(int))
    for pivot in pivots.tolist():
        overlap = np.add.reduceat(is_in(flat, sets[pivot]).astype(np.int64), cuts)
        for other in np.flatnonzero(linked(overlap, sizes, sizes[pivot], percent)).tolist():
            parts.join(pivot, other)
    labels = parts.labels()
    names, counts = np.unique(labels, return_counts=True)
    if len(names) == 1:
        return labels
    at = points(sets)
    tree = Tree(at, sizes)
    tried = np.zeros(n, dtype=bool)
    tried[pivots] = True
    for i in np.flatnonzero((labels != names[np.argmax(counts)]) & ~tried).tolist():
        labels = parts.labels()
        for j in tree.near(at[i], int(sizes[i]), percent).tolist():
            if labels[j] != labels[i] and not tried[j] and parts.root(i) != parts.root(j):
                overlap = int(is_in(sets[i], sets[j]).sum())
                if linked(overlap, len(sets[i]), len(sets[j]), percent):
                    parts.join(i, j)
        tried[i] = True
    return parts.labels()


POINTS = "print binary, n long, shingles binary, groups array<long>"


def candidate_points(docs: DataFrame, key: str, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All documents (key, n_shingles, print), and the points that share a rectangle with another."""
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    manifest = stage_chunks(rows, "__text")
    kind = rows.schema["__key"].dataType.simpleString()

    def first(name: str, table: pa.Table) -> Iterator[pa.RecordBatch]:
        cells, at = np.zeros(CELLS, dtype=np.int64), 0
        for words, shingles, bounds in sets_of(table, width):
            cells += np.bincount(cell(shingles), minlength=CELLS)
            prints = [p if n else None for p, n in zip(fingerprints(shingles, bounds), np.diff(bounds).tolist())]
            part = table.slice(words.first, words.last - words.first)
            n = part.num_rows
            last = words.last == table.num_rows
            packed = [cells.astype("<u4").tobytes() if last and i == n - 1 else None for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * n),
                    pa.array(np.arange(at, at + n)),
                    part.column("__key").combine_chunks(),
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.array(prints, pa.binary()),
                    pa.array(packed, pa.binary()),
                ],
                names=["chunk", "row", "__key", "n", "print", "cells"],
            )
            at += n

    seen = cut_lineage(each_chunk(manifest, first, f"chunk string, row long, __key {kind}, n long, print binary, cells binary"))
    cells = summed_cells(seen.where("cells is not null"))
    classes = frequency_classes(cells)

    # one document stands for all with the same set
    places = seen.where("n > 0").groupBy("print").agg(F.min(F.struct("chunk", "row")).alias("place"))
    chosen = places.select("place.chunk", "place.row").groupBy("chunk").agg(F.collect_list("row").alias("rows"))
    chosen = cut_lineage(chosen.select("chunk", F.lit(0).alias("tag"), "rows", F.lit(None).cast("binary").alias("keys")))
    buckets = bucket_count(manifest)

    def ask(name: str, table: pa.Table, answers: pa.Table) -> Iterator[pa.RecordBatch]:
        keep, keys = wanted_rows(table, answers), []
        for words, shingles, bounds in sets_of(table, width):
            shingles, bounds = only(shingles, bounds, keep[words.first : words.last])
            keys.append(mix64(shingles, 3))
        every = np.concatenate(keys)
        yield from requests(name, buckets, every, every, HALF)

    shared = repeated_keys(visit_answers(manifest, chosen, ask, REQUEST), HALF)
    shared = shared.select("chunk", F.lit(1).alias("tag"), F.lit(None).cast("array<long>").alias("rows"), "keys")

    def tell(name: str, table: pa.Table, answers: pa.Table) -> Iterator[pa.RecordBatch]:
        keep = wanted_rows(table, answers)
        known = [np.frombuffer(x, dtype=np.uint64) for x in answers.column("keys").to_pylist() if x]
        if not known:
            return
        known = np.sort(np.concatenate(known))
        for words, shingles, bounds in sets_of(table, width):
            shingles, bounds = only(shingles, bounds, keep[words.first : words.last])
            often = is_in(answered(mix64(shingles, 3), buckets, HALF), known)
            place = prefix(shingles, bounds, often, classes, percent)
            place = place[often[place]]
            row = np.searchsorted(bounds, place, side="right") - 1
            order = np.argsort(row, kind="stable")
            own, firsts = np.unique(row[order], return_index=True)
            prints = fingerprints(shingles, bounds)
            lists = pa.ListArray.from_arrays(
                pa.array([*firsts.tolist(), len(row)], pa.int32()), pa.array(shingles[place[order]].astype(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([prints[r] for r in own.tolist()], pa.binary()),
                    pa.array(np.diff(bounds)[own].astype(np.int64)),
                    pa.array([shingles[bounds[r] : bounds[r + 1]].tobytes() for r in own.tolist()], pa.binary()),
                    lists,
                ],
                names=["print", "n", "shingles", "groups"],
            )

    found = visit_answers(manifest, chosen.unionByName(shared), tell, POINTS)
    found = cut_lineage(found.withColumn("node", F.monotonically_increasing_id()))
    return seen.select("__key", "n", "print"), found


def wanted_rows(table: pa.Table, answers: pa.Table) -> np.ndarray:
    keep = np.zeros(table.num_rows, dtype=bool)
    for rows in answers.column("rows").to_pylist():
        if rows:
            keep[rows] = True
    return keep


def only(shingles: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of some rows; the others become empty."""
    counts = np.diff(bounds)
    kept = np.where(keep, counts, 0)
    return shingles[np.repeat(keep, counts)], np.concatenate([[0], np.cumsum(kept)])


def summed_cells(df: DataFrame) -> np.ndarray:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total += np.frombuffer(packed, dtype=np.int64 if len(packed) == 8 * CELLS else "<u4")
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["cells"])

    parts = df.select("cells").mapInArrow(add, "cells binary").repartition(4).mapInArrow(add, "cells binary").collect()
    return np.sum([np.frombuffer(r["cells"], dtype=np.int64) for r in parts], axis=0) if parts else np.zeros(CELLS)


def linked_points(found: DataFrame, percent: int) -> DataFrame:
    """Rows (node, component) of the points that share a rectangle."""
    boxes = found.select(F.explode("groups").alias("g"), "node", "n")
    least = boxes.groupBy("g").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1")
    touch = boxes.join(least, "g").where("node > least").select(F.lit(0).alias("all"), F.col("least").alias("a"), F.col("node").alias("b"))
    groups = connected_components(touch.distinct(), "all").select("node", F.col("component").alias("candidate"))
    groups = cut_lineage(groups)
    weights = groups.join(found.select("node", "n"), "node").groupBy("candidate").agg(F.sum("n").alias("weight"))
    tiles = F.ceil(F.col("weight") / TILE).cast("int")
    placed = groups.join(weights.select("candidate", tiles.alias("tiles")), "candidate")
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "node", "candidate", "tiles", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")
    )

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("node")
        node = table.column("node").to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
        labels = components(sets, percent)
        yield pa.RecordBatch.from_arrays([table.column("tiles").combine_chunks(), pa.array(node), pa.array(node[labels])], names=["tiles", "a", "b"])

    sent = pairs.join(found.select("node", "shingles"), "node")
    links = cut_lineage(sent.groupBy("candidate", "low", "high").applyInArrow(join, "tiles int, a long, b long"))
    whole = links.where("tiles = 1").select(F.col("a").alias("node"), F.col("b").alias("component"))
    split = links.where("tiles > 1").select(F.lit(0).alias("all"), "a", "b")
    if split.isEmpty():
        return whole
    return whole.unionByName(connected_components(split, "all").select("node", "component"))


def jaccard_components(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85
) -> DataFrame:
    """Per document: key, ``n_shingles`` and ``component_id``, the smallest key that links reach.

    Two documents are linked when 100 * intersection >= ``percent`` * union of their sets.
    """
    seen, found = candidate_points(docs, key, text, width, percent)
    joined = cut_lineage(linked_points(found, percent))
    firsts = seen.where("n > 0").groupBy("print").agg(F.min("__key").alias("least"))
    named = firsts.join(found.select("print", "node").join(joined, "node").drop("node"), "print", "left")
    # most points may be in one component, so its rows are dealt apart
    linked = cut_lineage(named.where("component is not null"))
    lowest = cut_lineage(linked.groupBy("component").agg(F.min("least").alias("lowest"), F.count(F.lit(1)).alias("weight")))
    linked = with_facts(linked, lowest, ["component"], "weight", F.xxhash64("print")).select("print", F.coalesce("lowest", "least").alias("component_id"))
    named = linked.unionByName(named.where("component is null").select("print", F.col("least").alias("component_id")))
    with_set = seen.where("n > 0").join(named, "print").select("__key", "n", "component_id")
    without = seen.where("n = 0").select("__key", "n", F.col("__key").alias("component_id"))
    out = with_set.unionByName(without)
    return out.select(F.col("__key").alias(key), F.col("n").alias("n_shingles"), "component_id")
