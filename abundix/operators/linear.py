"""Least squares with any small design, one fit per feature, and contrasts between its coefficients.

A design is a small matrix: one row per sample, one column per coefficient. Each feature is fitted on the samples in
which it was measured. A feature's cells, at most one per sample, are packed into one row; a batch of features then
needs three matrix products for all its normal equations, one stacked eigen-decomposition for the systems, and one
more product for the residuals. What a feature's samples cannot tell apart is left open: a contrast that is not
estimable gets NULL, so the same contrast gives the same result however the design is written.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundix.operators.ordered import keys_of

MOST_SAMPLES = 1 << 14
_BATCH_CELLS = 1 << 21
_RANK = 1e-9


@dataclass(frozen=True)
class Design:
    """``matrix`` has a row for each of ``samples`` and a column for each of ``columns``."""

    samples: tuple
    columns: tuple[str, ...]
    matrix: np.ndarray

    def weights(self, contrasts: Mapping[str, Mapping[str, float]]) -> np.ndarray:
        """A row of column weights for each contrast; an unknown column is an error."""
        out = np.zeros((len(contrasts), len(self.columns)))
        for row, wanted in zip(out, contrasts.values()):
            for column, weight in wanted.items():
                if column not in self.columns:
                    raise KeyError(f"{column} is no column of the design: {', '.join(self.columns)}")
                row[self.columns.index(column)] = weight
        return out


def study_design(
    dim: DataFrame, terms: Sequence[str], *, sample: str = "sample", intercept: bool = True
) -> Design:
    """Design of a sample dimension (one row per sample). Numeric terms are a column, others one per level.

    With an intercept the first level of each factor is the reference; without, only the first factor keeps all its
    levels. The dimension of a study is small and comes to the driver; samples without a value in a term are no part
    of the design.
    """
    rows = dim.select(sample, *terms).dropna().distinct().limit(MOST_SAMPLES + 1).collect()
    if len(rows) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples in the design")
    rows = sorted(rows, key=lambda r: str(r[sample]))
    names = [r[sample] for r in rows]
    if len(set(names)) < len(names):
        raise ValueError("a sample has more than one row in the design")
    columns: dict[str, np.ndarray] = {"intercept": np.ones(len(rows))} if intercept else {}
    whole = not intercept
    for term in terms:
        kind = dim.schema[term].dataType.typeName()
        if kind in ("double", "float", "integer", "long", "short", "byte") or kind.startswith("decimal"):
            columns[term] = np.array([float(r[term]) for r in rows])
            continue
        levels = sorted({str(r[term]) for r in rows})
        for level in levels if whole else levels[1:]:
            columns[f"{term}:{level}"] = np.array([float(str(r[term]) == level) for r in rows])
        whole = False
    matrix = np.stack(list(columns.values()), axis=1) if rows else np.zeros((0, len(columns)))
    return Design(tuple(names), tuple(columns), matrix)


def difference(term: str, up: str, down: str) -> dict[str, float]:
    """The contrast between two levels of a factor that has a column for each."""
    return {f"{term}:{up}": 1.0, f"{term}:{down}": -1.0}


@dataclass
class Fits:
    """Of a batch: number of cells, rank, residual variance; estimates and unscaled variances by contrast, NaN where open."""

    cells: np.ndarray
    rank: np.ndarray
    s2: np.ndarray
    effect: np.ndarray
    unscaled: np.ndarray


def fit_batch(values: np.ndarray, known: np.ndarray, matrix: np.ndarray, contrasts: np.ndarray) -> Fits:
    """Fits of many features at once; ``values`` and ``known`` have a row per feature and a column per sample."""
    n, p = matrix.shape
    # columns of one length, so that the rank does not depend on the unit of a covariate
    length = np.maximum(np.sqrt((matrix * matrix).sum(axis=0)), 1e-300)
    x, wanted = matrix / length, contrasts / length
    marks = known.astype(float)
    centre = np.where(marks.any(axis=1), (values * marks).sum(axis=1) / np.maximum(marks.sum(axis=1), 1), 0.0)
    # an intercept that the design spans takes out the mean exactly, and the residuals lose no digits
    spans = p > 0 and np.allclose(x @ np.linalg.lstsq(x, np.ones(n), rcond=None)[0], 1.0) if n else False
    shift = centre if spans else np.zeros(len(centre))
    y = (values - shift[:, None]) * marks
    normal = (marks @ (x[:, :, None] * x[:, None, :]).reshape(n, p * p)).reshape(-1, p, p)
    roots, axes = np.linalg.eigh(normal)
    kept = roots > _RANK * np.maximum(roots[:, -1:], 1e-300)
    inverse = np.where(kept, 1.0 / np.where(kept, roots, 1.0), 0.0)
    solve = np.einsum("fij,fj,fkj->fik", axes, inverse, axes)
    beta = np.einsum("fij,fj->fi", solve, y @ x)
    rest = (y - (beta @ x.T) * marks) * marks
    beta = beta + np.einsum("fij,fj->fi", solve, rest @ x)  # one step of refinement
    rest = (y - (beta @ x.T) * marks) * marks
    cells, rank = marks.sum(axis=1).astype(np.int64), kept.sum(axis=1)
    rank = np.where(cells == 0, 0, rank)
    free = cells - rank
    s2 = np.where(free > 0, (rest * rest).sum(axis=1) / np.maximum(free, 1), np.nan)
    if spans:  # give the mean back: it is a combination of the columns
        beta = beta + shift[:, None] * np.linalg.lstsq(x, np.ones(n), rcond=None)[0]
    # estimable: the contrast lies in the span of the feature's rows
    inside = np.einsum("fij,fj,fkj->fik", axes, kept.astype(float), axes)
    off = np.abs(np.einsum("ci,fik->fck", wanted, inside) - wanted).max(axis=2) if p else np.ones((len(values), len(wanted)))
    size = np.abs(wanted).max(axis=1) if p else np.ones(len(wanted))
    fits = (off <= 1e-6 * np.maximum(size, 1e-300)) & (cells[:, None] > 0)
    effect = np.where(fits, beta @ wanted.T, np.nan)
    unscaled = np.where(fits, np.einsum("ci,fik,ck->fc", wanted, solve, wanted), np.nan)
    return Fits(cells, rank, s2, effect, unscaled)


def contrast_fits(
    df: DataFrame,
    design: Design,
    contrasts: Mapping[str, Mapping[str, float]],
    *,
    feature: str = "feature",
    sample: str = "sample",
    value: str = "value",
    by: str | Sequence[str] | None = None,
    collapsed: bool = False,
) -> DataFrame:
    """Per feature and contrast, columns as ``pooled_test`` gives them: n, rank, d, s2, log_fc, unscaled, t.

    Repeated cells are averaged first unless ``collapsed``. Values that are missing, and samples that are no part of the
    design, are left out; a contrast that a feature's samples do not determine gives no row.
    """
    if len(design.samples) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples in the design")
    keys = [*keys_of(by), feature]
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    cells = known.select(*keys, sample, F.col(value).cast("double").alias("__v"))
    if not collapsed:
        cells = cells.groupBy(*keys, sample).agg(F.avg("__v").alias("__v"))
    kind = df.schema[sample].dataType
    places = df.sparkSession.createDataFrame(
        pa.table({"__sample": pa.array([str(s) for s in design.samples], pa.string()), "__at": pa.array(range(len(design.samples)), pa.int32())})
    )
    cells = cells.join(places.select(F.col("__sample").cast(kind).alias(sample), "__at"), sample)
    packed = cells.groupBy(*keys).agg(F.collect_list(F.struct("__at", "__v")).alias("__cells"))
    weights, matrix, names = design.weights(contrasts), design.matrix, list(contrasts)
    width = len(design.samples)
    most = max(1, _BATCH_CELLS // max(1, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, most):
                part = batch.slice(low, most)
                lists = part.column(len(keys))
                rows = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                cell = lists.flatten()
                at, values = cell.field(0).to_numpy(), np.zeros((part.num_rows, width))
                marks = np.zeros((part.num_rows, width), dtype=bool)
                values[rows, at] = cell.field(1).to_numpy()
                marks[rows, at] = True
                fits = fit_batch(values, marks, matrix, weights)
                for i, name in enumerate(names):
                    here = np.flatnonzero(~np.isnan(fits.effect[:, i]))
                    own = part.take(pa.array(here))
                    numbers = [fits.cells[here], fits.rank[here], fits.cells[here] - fits.rank[here]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[own.column(k) for k in range(len(keys))],
                            pa.array([name] * len(here), pa.string()),
                            *[pa.array(x.astype(np.int64)) for x in numbers],
                            pa.array(fits.s2[here], mask=np.isnan(fits.s2[here])),
                            pa.array(fits.effect[here, i]),
                            pa.array(fits.unscaled[here, i]),
                        ],
                        names=[*keys, "comparison", "n", "rank", "d", "s2", "log_fc", "unscaled"],
                    )

    schema = packed.select(*keys).schema.add("comparison", "string")
    for name, kind_of in {"n": "long", "rank": "long", "d": "long", "s2": "double", "log_fc": "double", "unscaled": "double"}.items():
        schema = schema.add(name, kind_of)
    fitted = packed.mapInArrow(run, schema)
    return fitted.withColumn("t", F.when(F.col("s2") > 0, F.col("log_fc") / F.sqrt(F.col("s2") * F.col("unscaled"))))
