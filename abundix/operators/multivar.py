"""Cross-products, K-means, correlations and distances."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from abundix.operators.aggregate import collapse_duplicates
from abundix.operators.ordered import keys_of
from abundix.operators.reshape import to_wide
from abundix.session import cut_lineage

BLOCK = 2048
LINES = 64
_MAX_HELD = 32_000_000


def pack_rows(
    df: DataFrame, axis: Sequence[str], *, row: str | Sequence[str] = "feature", column: str = "sample", value: str = "value"
) -> DataFrame:
    """One array per row, in the order of ``axis``; a missing cell is NULL."""
    ids = keys_of(row)
    wide = to_wide(df, axis, feature=ids, sample=column, value=value)
    return wide.select(*ids, F.array(*[F.col(f"`{a}`") for a in axis]).alias("vec"))


def outer_sums(df: DataFrame, keys: Sequence[str], vec: str, size: int) -> DataFrame:
    """Sum of vec * vec' per key as rows (keys, i, j, product).

    The axis is cut into blocks of ``BLOCK`` entries. Each task adds up its own rows with matrix products, one
    partial matrix per key and pair of blocks (upper triangle only); the partial matrices are then summed by
    Spark. No pair of rows is ever formed, and a key or an axis of any size stays spread.
    """
    keys = list(keys)
    blocks = -(-size // BLOCK)
    pairs = F.array(*[F.struct(F.lit(i).alias("bi"), F.lit(j).alias("bj")) for i in range(blocks) for j in range(i, blocks)])
    rows = df.select(*keys, F.col(vec).alias("__vec"), F.explode(pairs).alias("__pair")).select(
        *keys,
        "__pair.bi",
        "__pair.bj",
        F.slice("__vec", F.col("__pair.bi") * BLOCK + 1, F.lit(BLOCK)).alias("__left"),
        F.slice("__vec", F.col("__pair.bj") * BLOCK + 1, F.lit(BLOCK)).alias("__right"),
    )
    names = [*keys, "bi", "bj"]
    held_keys = max(1, _MAX_HELD // (min(size, BLOCK) ** 2))
    fields = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in names)

    def emit(sums: dict) -> pd.DataFrame:
        """Partial matrices, ``LINES`` lines of one in a row."""
        parts = [(name, low, matrix[low : low + LINES].tobytes()) for name, matrix in sums.items() for low in range(0, len(matrix), LINES)]
        out = pd.DataFrame({k: [name[n] for name, _, _ in parts] for n, k in enumerate(names)})
        out["low"] = np.array([low for _, low, _ in parts], dtype=np.int32)
        out["lines"] = [lines for _, _, lines in parts]
        return out

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            if batch.empty:
                continue
            for name, own in batch.groupby(names, sort=False):
                product = np.stack(own["__left"].to_numpy()).astype(float).T @ np.stack(own["__right"].to_numpy()).astype(float)
                sums[name] = sums[name] + product if name in sums else product
                if len(sums) >= held_keys:
                    yield emit(sums)
                    sums = {}
        if sums:
            yield emit(sums)

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = None, None
        for batch in batches:
            for lines in batch.column("lines").to_pylist():
                total = np.frombuffer(lines) if total is None else total + np.frombuffer(lines)
            first = batch.slice(0, 1)
        width = min(BLOCK, size - first.column("bj")[0].as_py() * BLOCK)
        matrix = total.reshape(-1, width)
        low = first.column("low")[0].as_py()
        same = first.take(pa.array(np.zeros(len(matrix), dtype=np.int64)))
        offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * width)
        yield pa.RecordBatch.from_arrays(
            [*[same.column(k) for k in names], pa.array(np.arange(low, low + len(matrix), dtype=np.int32)), pa.ListArray.from_arrays(offsets, pa.array(total))],
            names=[*names, "i", "line"],
        )

    # partial matrices are summed as packed lines; cells become rows only when they are final
    parts = rows.mapInPandas(partial, f"{fields}low int, lines binary")
    lines = parts.groupBy(*names, "low").applyInArrow(add, f"{fields}i int, line array<double>")
    cells = lines.select(*names, "i", F.posexplode("line").alias("j", "product"))
    placed = cells.select(
        *keys, (F.col("bi") * BLOCK + F.col("i")).alias("i"), (F.col("bj") * BLOCK + F.col("j")).alias("j"), "product", (F.col("bi") < F.col("bj")).alias("__off")
    )
    if blocks == 1:
        return placed.drop("__off")
    below = placed.where("__off").select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "product")
    return placed.drop("__off").unionByName(below)


def pair_moments(
    df: DataFrame, axis: Sequence[str], *, row: str = "feature", column: str = "sample", value: str = "value", about: str = "column"
) -> DataFrame:
    """Pairwise-complete n, sums and products for every pair of axis entries (a <= b).

    Values, presence marks and squares stand in one vector, so one cross-product holds all of them. Values are
    first taken from the mean of their axis entry (``about="column"``, for correlations) or of their row
    (``about="row"``, for differences), neither of which changes the result, so that large values with small
    differences lose no digits.
    """
    size = len(axis)
    if about == "column":
        means = df.groupBy(column).agg(F.avg(value).alias("__mean"))
        df = df.join(means, column).withColumn(value, F.col(value) - F.col("__mean")).drop("__mean")
    packed = pack_rows(df, axis, row=row, column=column, value=value)
    if about == "row":
        known = F.filter("vec", lambda x: x.isNotNull())
        mean = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x) / F.nullif(F.size(known), F.lit(0))
        packed = packed.withColumn("__mean", mean).withColumn("vec", F.transform("vec", lambda x: x - F.col("__mean")))
    filled = F.transform("vec", lambda x: F.coalesce(x, F.lit(0.0)))
    marks = F.transform("vec", lambda x: F.when(x.isNull(), 0.0).otherwise(1.0))
    squares = F.transform(filled, lambda x: x * x)
    sums = outer_sums(packed.select(F.concat(filled, marks, squares).alias("vec")), [], "vec", 3 * size)

    def block(i: int, j: int, name: str):
        return F.max(F.when((F.col("bi") == i) & (F.col("bj") == j), F.col("product"))).alias(name)

    named = F.array(*[F.lit(a) for a in axis])
    spread = sums.select(
        F.floor(F.col("i") / size).alias("bi"),
        F.floor(F.col("j") / size).alias("bj"),
        (F.col("i") % size).alias("a"),
        (F.col("j") % size).alias("b"),
        "product",
    ).where(F.col("a") <= F.col("b"))
    moments = spread.groupBy("a", "b").agg(
        block(1, 1, "n"), block(0, 1, "sa"), block(1, 0, "sb"), block(2, 1, "saa"), block(1, 2, "sbb"), block(0, 0, "sab")
    )
    return moments.select(
        F.element_at(named, (F.col("a") + 1).cast("int")).alias("a"),
        F.element_at(named, (F.col("b") + 1).cast("int")).alias("b"),
        F.round("n").cast("long").alias("n"), "sa", "sb", "saa", "sbb", "sab",
    )


def correlation_distance(moments: DataFrame, min_rows: int = 3) -> DataFrame:
    """1 - correlation over rows that both entries have; NULL without variance or with too few rows."""
    va = F.col("saa") - F.col("sa") * F.col("sa") / F.col("n")
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")
    r = (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(va * vb)
    pairs = moments.where((F.col("a") != F.col("b")) & (F.col("n") > 0))
    return pairs.select("a", "b", "n", F.when((F.col("n") >= min_rows) & (va > 1e-9) & (vb > 1e-9), 1 - r).alias("distance"))


def euclidean_distance(moments: DataFrame) -> DataFrame:
    """Distance over rows that both entries have."""
    raw = F.col("saa") + F.col("sbb") - 2 * F.col("sab")
    pairs = moments.where((F.col("a") != F.col("b")) & (F.col("n") > 0))
    return pairs.select("a", "b", "n", F.sqrt(F.greatest(raw, F.lit(0.0))).alias("distance"))


def gram_matrix(
    df: DataFrame, samples: Sequence[str], *, feature: str = "feature", sample: str = "sample", value: str = "value"
) -> DataFrame:
    """Sample x sample products of centred features, over features seen in every sample."""
    packed = pack_rows(df, samples, row=feature, column=sample, value=value)
    complete = packed.where(~F.exists("vec", lambda x: x.isNull()))
    mean = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x) / F.lit(float(len(samples)))
    centred = complete.withColumn("__mean", mean).select(F.transform("vec", lambda x: x - F.col("__mean")).alias("vec"))
    names = F.array(*[F.lit(s) for s in samples])
    return outer_sums(centred, [], "vec", len(samples)).select(
        F.element_at(names, (F.col("i") + 1).cast("int")).alias("a"), F.element_at(names, (F.col("j") + 1).cast("int")).alias("b"), "product"
    )


class _Starts:
    """All fits of K-means side by side: for every K the same restarts, each with its K centres in one block."""

    def __init__(self, ks: Sequence[int], restarts: int):
        self.ks, self.restarts = list(ks), restarts
        self.begin = np.concatenate([[0], np.cumsum([k * restarts for k in self.ks])])

    def nearest(self, points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per point and fit the number of the nearest centre (counted over all fits) and its squared distance."""
        base = (points * points).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(axis=1)[None]
        chosen, least = [], []
        for begin, k in zip(self.begin, self.ks):
            block = base[:, begin : begin + k * self.restarts].reshape(len(points), self.restarts, k)
            best = block.argmin(axis=2)
            chosen.append(begin + np.arange(self.restarts)[None] * k + best)
            least.append(np.maximum(np.take_along_axis(block, best[:, :, None], axis=2)[:, :, 0], 0.0))
        return np.concatenate(chosen, axis=1), np.concatenate(least, axis=1)


def _packed_sum(parts: DataFrame) -> np.ndarray:
    """Sum of equally long packed arrays of doubles, first by groups of eight tasks."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for packed in batch["sums"]:
                own = np.frombuffer(packed)
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"sums": [total.tobytes()]})

    return np.sum([np.frombuffer(r["sums"]) for r in parts.repartition(8).mapInPandas(add, "sums binary").collect()], axis=0)


def _least_rows(rows: DataFrame, row: str, restarts: int, most: int, seed: int) -> DataFrame:
    """The ``most`` rows with the least hashes of each restart, (restart, place, row). Only keys travel, no vectors."""
    keyed = rows.select(row, F.xxhash64(F.lit(seed), row).alias("h"))
    salt = np.random.default_rng(seed).integers(0, 2**63, restarts).astype(np.uint64)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, pa.Array]] = [(np.zeros(0, np.uint64), pa.array([], keyed_type))] * restarts
        for batch in batches:
            if batch.num_rows == 0:
                continue
            own = batch.column(1).to_numpy().view(np.uint64)
            for i in range(restarts):
                x = (own ^ salt[i]) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                x = np.concatenate([held[i][0], x ^ (x >> np.uint64(32))])
                ids = pa.concat_arrays([held[i][1], batch.column(0)])
                best = np.argsort(x, kind="stable")[:most]
                held[i] = (x[best], ids.take(pa.array(best)))
        for i, (x, ids) in enumerate(held):
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i, dtype=np.int32)), pa.array(x.view(np.int64)), ids], names=["restart", "h", row])

    keyed_type = to_arrow_type(keyed.schema[row].dataType)
    kind = keyed.schema[row].dataType.simpleString()
    found = keyed.mapInArrow(least, f"restart int, h long, `{row}` {kind}")
    order = W.partitionBy("restart").orderBy(F.shiftrightunsigned("h", 1), "h", row)  # by the unsigned hash
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("restart", "place", row)


def kmeans_clusters(
    packed: DataFrame,
    ks: Sequence[int],
    *,
    row: str = "feature",
    vec: str = "vec",
    restarts: int = 100,
    max_iter: int = 40,
    seed: int = 1,
    starts: Sequence | None = None,
) -> DataFrame:
    """Cluster of each row for every K, rows (k, row, cluster); the restart with the least cost wins.

    Lloyd's steps of all K and restarts run in one job each, with one pass over the rows per step. The starts are
    the rows with the least hash of (seed, restart, row), or for a single fit of every K the first K of the rows named
    in ``starts``. Only the centres, sum of K x restarts x width numbers, and their sums come to the driver. Clusters
    are numbered by ascending centre, so the number does not depend on the run; a centre without rows stays where it
    is; rows without a vector are left out.
    """
    rows = cut_lineage(packed.where(F.col(vec).isNotNull()).select(row, vec))
    restarts = restarts if starts is None else 1
    fits, most = _Starts(ks, restarts), max(ks)
    if starts is None:
        chosen = _least_rows(rows, row, restarts, most, seed)
    else:
        listed = pa.table({row: pa.array(list(starts)[:most], to_arrow_type(rows.schema[row].dataType)), "place": pa.array(range(1, min(most, len(starts)) + 1), pa.int32())})
        chosen = rows.sparkSession.createDataFrame(listed).withColumn("restart", F.lit(0))
    least = chosen.join(rows, row).select("restart", "place", vec).collect()  # K vectors a restart
    if not least:
        return rows.select(F.lit(0).cast("long").alias("k"), row, F.lit(0).cast("long").alias("cluster")).limit(0)
    points = [[r[vec] for r in sorted((r for r in least if r["restart"] == i), key=lambda r: (r["place"], r[vec]))] for i in range(restarts)]
    centres = np.array([own[j % len(own)] for k in fits.ks for own in points for j in range(k)], dtype=float)
    n, width = centres.shape

    def points_of(batch: pd.DataFrame) -> Iterator[np.ndarray]:
        for low in range(0, len(batch), 1000):
            yield np.stack(batch[vec].to_numpy()[low : low + 1000]).astype(float)

    def step(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums and counts of the rows of each centre, and the cost of each fit."""

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, counts, costs = np.zeros((n, width)), np.zeros(n), np.zeros(len(fits.ks) * restarts)
            for batch in batches:
                for points in points_of(batch):
                    chosen, far = fits.nearest(points, centres)
                    own = np.zeros((len(points), n))
                    np.put_along_axis(own, chosen, 1.0, axis=1)
                    sums += own.T @ points
                    counts += own.sum(axis=0)
                    costs += far.sum(axis=0)
            yield pd.DataFrame({"sums": [np.concatenate([sums.reshape(-1), counts, costs]).tobytes()]})

        total = _packed_sum(rows.select(vec).mapInPandas(partial, "sums binary"))
        return total[: n * width].reshape(n, width), total[n * width : n * width + n], total[n * width + n :]

    for _ in range(max_iter):
        sums, counts, costs = step(centres)
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        settled = np.allclose(moved, centres, rtol=0, atol=1e-12)
        centres = moved
        if settled:
            break
    costs = step(centres)[2].reshape(len(fits.ks), restarts)
    chosen = []
    for begin, k, own in zip(fits.begin, fits.ks, costs):
        best = begin + int(np.argmin(own)) * k
        block = centres[best : best + k]
        chosen.append(block[np.lexsort(block.T[::-1])])
    final = _Starts(fits.ks, 1)
    best_centres = np.concatenate(chosen)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low, points in zip(range(0, len(batch), 1000), points_of(batch)):
                nearest, _ = final.nearest(points, best_centres)
                for i, k in enumerate(final.ks):
                    yield pd.DataFrame(
                        {"k": k, row: batch[row].to_numpy()[low : low + 1000], "cluster": nearest[:, i] - final.begin[i] + 1}
                    )

    kind = rows.schema[row].dataType.simpleString()
    return rows.mapInPandas(assign, f"k long, `{row}` {kind}, cluster long")


def nearest_centroid(packed: DataFrame, centres: DataFrame, *, row: str = "feature", vec: str = "vec") -> DataFrame:
    """Nearest of ``centres`` (cluster, centre) and the squared distance; ties to the lower cluster.

    The centres travel as one array, joined to every row as a scalar.
    """
    listed = centres.agg(F.sort_array(F.collect_list(F.struct("cluster", "centre"))).alias("c")).scalar()
    whole = packed.withColumn("__centres", listed)

    def far(centre: Column) -> Column:
        squares = F.zip_with(F.col(vec), centre, lambda x, c: (x - c) * (x - c))
        return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)

    best = whole.withColumn("__best", F.array_min(F.transform("__centres", lambda c: F.struct(far(c["centre"]).alias("distance"), c["cluster"].alias("cluster")))))
    return best.select(row, F.col("__best.cluster").cast("long").alias("cluster"), F.col("__best.distance").alias("distance"))


def beside(table: DataFrame, most: int = 1 << 16) -> DataFrame:
    """A checkpointed copy, which joins broadcast if it has few rows, so that they leave the other side where it is."""
    held = cut_lineage(table)
    return F.broadcast(held) if held.limit(most + 1).count() <= most else held


def packed_features(
    df: DataFrame, *, by: str | Sequence[str] | None = None, feature: str = "feature", sample: str = "sample", value: str = "value", least: int = 1
) -> DataFrame:
    """One row per (by, feature) that was measured in ``least`` samples or more: its ``cells`` (at, v), gaps left out.

    ``at`` numbers the samples of a group from 0 in the order of their names. Repeated cells are averaged.
    """
    keys = keys_of(by)
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, feature, sample, value)
    # dealt once, by the feature: repeated cells, features and joins by the feature find their rows where they are
    cells = collapse_duplicates(known.repartition(feature), [*keys, feature, sample], value)
    axis = known.select(*keys, sample).distinct()
    axis = axis.withColumn("__at", F.row_number().over(W.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy(sample)) - 1)
    placed = cells.join(beside(axis), [*keys, sample])
    packed = placed.groupBy(*keys, feature).agg(F.collect_list(F.struct(F.col("__at").alias("at"), F.col(value).alias("v"))).alias("cells"))
    return packed.where(F.size("cells") >= least)


def _by_masks(rows: DataFrame, masks: DataFrame, keys: Sequence[str], feature: str, least: int) -> DataFrame:
    """Sums over all pairs of rows (keys, __p, __s, __q) where few patterns of gaps occur.

    Rows of one pattern share their samples with all rows of another, so both are standardised over what the patterns
    have in common, and sums over pairs of rows are products of sums over rows: of vectors for r, of their squares'
    matrices for r^2. The work grows with the rows and with the square of the number of patterns.
    """
    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    places = lambda mask: tuple(int(x) for x in mask.split(",")) if mask else ()

    def named(table: pa.Table, count: int) -> dict:
        return {k: table.column(k).take(pa.array(np.zeros(count, dtype=np.int64))) for k in keys}

    def partial(key: tuple[pa.Scalar, ...], table: pa.Table, group: pa.Table) -> pa.Table:
        listed = group.column("__masks")[0].as_py()
        every = [places(m) for m in listed]
        found = []
        for mask in pc.unique(table.column("__mask")).to_pylist():
            own = places(mask)
            x = table.filter(pc.equal(table.column("__mask"), mask)).column("__v").combine_chunks().flatten().to_numpy().reshape(-1, len(own))
            x = x - x.mean(axis=1, keepdims=True)
            for shared in {tuple(sorted({*own} & {*other})) for other in every}:
                if len(shared) < least:
                    continue
                y = x[:, np.searchsorted(own, shared)]
                y = y - y.mean(axis=1, keepdims=True)
                squares = (y * y).sum(axis=1)
                z = y[squares > 1e-9] / np.sqrt(squares[squares > 1e-9])[:, None]
                found.append((mask, ",".join(map(str, shared)), len(z), z.sum(axis=0).tobytes(), (z.T @ z).tobytes()))
        columns = list(zip(*found)) or [[], [], [], [], []]
        kinds_of = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary())
        out = {n: pa.array(c, t) for n, c, t in zip(("mask", "shared", "n", "u", "m"), columns, kinds_of)}
        masks = pa.array([listed] * len(found), pa.list_(pa.string()))
        return pa.table({**named(group, len(found)), "masks": masks, **out})

    def final(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sums: dict = {}
        for mask, shared, n, u, m in zip(*(table.column(c).to_pylist() for c in ("mask", "shared", "n", "u", "m"))):
            here = (n, np.frombuffer(u), np.frombuffer(m))
            sums[mask, shared] = tuple(a + b for a, b in zip(sums[mask, shared], here)) if (mask, shared) in sums else here
        masks = sorted(table.column("masks")[0].as_py())
        pairs, total, squares = 0, 0.0, 0.0
        for i, a in enumerate(masks):
            for b in masks[i:]:
                shared = ",".join(map(str, sorted({*places(a)} & {*places(b)})))
                if (a, shared) not in sums or (b, shared) not in sums:
                    continue
                (na, ua, ma), (nb, ub, mb) = sums[a, shared], sums[b, shared]
                if a == b:
                    pairs, total, squares = pairs + na * (na - 1) // 2, total + (ua @ ua - na) / 2, squares + (ma @ ma - na) / 2
                else:
                    pairs, total, squares = pairs + na * nb, total + ua @ ub, squares + ma @ mb
        return pa.table({**named(table, 1), "__p": [pairs], "__s": [float(total)], "__q": [float(squares)]})

    parts = F.ceil(F.col("n_rows") / 8192).cast("int")
    part = F.pmod(F.xxhash64(feature), parts).cast("int").alias("__part")
    own = F.transform(F.array_sort("cells"), lambda c: c["v"]).alias("__v")
    # the patterns of a key come to its parts once, not with every row
    dealt = rows.select(*keys, part, "__mask", own).groupBy(*keys, "__part")
    listed = masks.select(*[F.col(k).alias(k) for k in keys], F.explode(F.sequence(F.lit(0), parts - 1)).alias("__part"), "__masks").groupBy(*keys, "__part")
    sums = dealt.cogroup(listed).applyInArrow(partial, f"{kinds}masks array<string>, mask string, shared string, n long, u binary, m binary")
    return sums.groupBy(*keys).applyInArrow(final, f"{kinds}__p long, __s double, __q double")


def pair_correlations(
    packed: DataFrame, keys: Sequence[str], *, feature: str = "feature", least: int = 3, tile: int = 1024, most_masks: int = 64
) -> DataFrame:
    """Correlations of all pairs of rows within each key, over the samples that both have: rows (keys, n_rows, pairs, mean, var).

    Rows of ``packed_features`` are dealt to tiles of about ``tile`` rows; every pair of tiles is a task of its own, so no
    key has to fit in a task, and a pair of tiles costs six matrix products of values, marks and squares. Pairs of rows
    are summed where they arise. A pair counts that shares ``least`` samples in which both vary. Keys whose rows have no
    more than ``most_masks`` patterns of gaps, and more rows than pairs of patterns, need no pairs of rows at all
    (``_by_masks``); the sums are the same.
    """
    keys = list(keys)
    packed = packed.withColumn("__mask", F.array_join(F.array_sort(F.transform("cells", lambda c: c["at"])), ","))
    counts = packed.groupBy(*keys, "__mask").agg(F.count(F.lit(1)).alias("__n"))
    many = F.size("__masks")
    sizes = counts.groupBy(*keys).agg(F.sum("__n").alias("n_rows"), F.collect_list("__mask").alias("__masks"))
    few = (many <= most_masks) & (many * many < F.col("n_rows"))
    sizes = sizes.withColumns({"__few": few, "__tiles": F.ceil(F.col("n_rows") / tile).cast("int")})
    sizes = cut_lineage(sizes.withColumn("__masks", F.when(F.col("__few"), F.col("__masks"))))
    masks, tiled = sizes.where("__few").select(*keys, "__masks", "n_rows"), sizes.where("not __few").select(*keys, "__tiles")
    some_few, some_tiled = not masks.isEmpty(), not tiled.isEmpty()
    rows = packed.join(beside(tiled), keys)
    mine = F.pmod(F.xxhash64(feature), F.col("__tiles")).cast("int")
    rows = rows.select(*keys, "cells", "__tiles", mine.alias("__own"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1)))
    rows = rows.withColumns({"__i": F.least("__own", "__other"), "__j": F.greatest("__own", "__other"), "__left": F.col("__own") <= F.col("__other")})
    kinds = "".join(f"`{k}` {packed.schema[k].dataType.simpleString()}, " for k in keys)

    def dense(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
        cells = table.column("cells").combine_chunks()
        row = np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy())
        flat = cells.flatten()
        at, v = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        # each row from its own mean: correlations stay, digits do too
        counts = np.bincount(row, minlength=len(cells))
        v = v - (np.bincount(row, weights=v, minlength=len(cells)) / np.maximum(counts, 1))[row]
        values, marks = np.zeros((len(cells), width)), np.zeros((len(cells), width))
        values[row, at], marks[row, at] = v, 1.0
        return values, marks

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        both = key[-2].as_py() != key[-1].as_py()
        flat = table.column("cells").combine_chunks().flatten()
        width = int(pc.max(flat.field(0)).as_py()) + 1
        left = table.filter(table.column("__left")) if both else table
        a, ma = dense(left, width)
        b, mb = dense(table.filter(pc.invert(table.column("__left"))), width) if both else (a, ma)
        pairs, total, squares = 0, 0.0, 0.0
        for low in range(0, len(a), 256):
            x, mx = a[low : low + 256], ma[low : low + 256]
            n = mx @ mb.T
            sx, sy = x @ mb.T, mx @ b.T
            vx, vy = (x * x) @ mb.T * n - sx * sx, mx @ (b * b).T * n - sy * sy
            good = (n >= least) & (vx > 1e-9 * n) & (vy > 1e-9 * n)
            if not both:
                good &= np.arange(len(b))[None] > (low + np.arange(len(x)))[:, None]
            r = (x @ b.T * n - sx * sy)[good] / np.sqrt(vx[good] * vy[good])
            pairs, total, squares = pairs + len(r), total + float(r.sum()), squares + float(r @ r)
        columns = {k: [key[i].as_py()] for i, k in enumerate(keys)}
        return pa.table({**{k: pa.array(v, table.schema.field(k).type) for k, v in columns.items()}, "__p": [pairs], "__s": [total], "__q": [squares]})

    parts = rows.groupBy(*keys, "__i", "__j").applyInArrow(work, f"{kinds}__p long, __s double, __q double")
    if some_few:
        simple = _by_masks(packed.join(beside(masks.select(*keys, "n_rows")), keys), masks, keys, feature, least)
        parts = parts.unionByName(simple) if some_tiled else simple
    sums = parts.groupBy(*keys).agg(F.sum("__p").alias("pairs"), F.sum("__s").alias("__s"), F.sum("__q").alias("__q"))
    mean = F.col("__s") / F.nullif(F.col("pairs"), F.lit(0))
    spread = F.greatest(F.col("__q") - F.col("__s") * mean, F.lit(0.0)) / F.nullif(F.col("pairs") - 1, F.lit(0))
    return sums.join(sizes.select(*keys, "n_rows"), keys).select(*keys, "n_rows", "pairs", mean.alias("mean"), spread.alias("var"))
