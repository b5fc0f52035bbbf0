"""Sample normalisation, median polish and batch correction."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abundix.operators.ordered import grouped_median
from abundix.operators.reshape import listed
from abundix.session import cut_lineage


def center_samples(df: DataFrame, *, sample: str = "sample", value: str = "value", medians_from: DataFrame | None = None) -> DataFrame:
    """Subtract each sample's median, taken from ``medians_from`` when another dataset sets the level.

    Samples that the other dataset lacks get NULL.
    """
    medians = grouped_median(df if medians_from is None else medians_from, sample, value, "__median")
    centered = df.join(medians, sample, "left").withColumn(value, F.col(value) - F.col("__median"))
    return centered.select(*df.columns)


def median_polish(
    df: DataFrame,
    *,
    feature: str = "feature",
    sample: str = "sample",
    value: str = "value",
    passes: int | None = None,
    max_passes: int = 20,
    tolerance: float = 0.01,
) -> DataFrame:
    """Take out row medians, then column medians, over and over (Tukey's two-way fit).

    Returns residuals in ``value`` with ``row_effect`` and ``col_effect``. With ``passes`` the number is
    fixed; otherwise it stops when the sum of absolute residuals changes by at most ``tolerance`` of itself, and
    not settling within ``max_passes`` is an error.
    """
    names = {feature: "row_effect", sample: "col_effect"}
    fit = cut_lineage(
        df.where(F.col(value).isNotNull())
        .withColumn("row_effect", F.lit(0.0))
        .withColumn("col_effect", F.lit(0.0))
    )
    previous = None
    for _ in range(passes or max_passes):
        for key, effect in names.items():
            medians = grouped_median(fit, key, value, "__median")
            fit = cut_lineage(
                fit.join(medians, key)
                .withColumn(value, F.col(value) - F.col("__median"))
                .withColumn(effect, F.col(effect) + F.col("__median"))
                .drop("__median")
            )
        if passes is None:
            size = fit.agg(F.sum(F.abs(value))).first()[0] or 0.0
            if size == 0.0 or (previous is not None and abs(previous - size) <= tolerance * size):
                break
            previous = size
    else:
        if passes is None:
            raise RuntimeError(f"median polish did not settle in {max_passes} passes")
    return fit.select(*df.columns, "row_effect", "col_effect")


def center_batches(df: DataFrame, batch: str, *, feature: str = "feature", value: str = "value") -> DataFrame:
    """One-factor batch correction: minus the feature's batch mean, plus its overall mean."""
    per_batch = df.groupBy(feature, batch).agg(F.avg(value).alias("__batch"), F.sum(value).alias("__s"), F.count(value).alias("__n"))
    overall = per_batch.groupBy(feature).agg((F.sum("__s") / F.sum("__n")).alias("__all"))
    shifts = per_batch.join(overall, feature).select(feature, batch, (F.col("__all") - F.col("__batch")).alias("__shift"))
    return df.join(shifts, [feature, batch]).withColumn(value, F.col(value) + F.col("__shift")).select(*df.columns)


def sum_coded(column: str, levels: Sequence[str]) -> dict[str, Column]:
    """Sum-to-zero coding: 1 for the own level, -1 for the last level, 0 for another; no listed level is an error."""
    own = listed(column, levels)
    last = F.when(own == levels[-1], F.lit(-1.0)).when(own.isNotNull(), F.lit(0.0))
    return {f"{column}_{level}": F.when(own == level, F.lit(1.0)).otherwise(last) for level in levels[:-1]}


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _least_squares(xtx: pd.Series, xty: pd.Series) -> pd.Series:
    """Coefficients, then the diagonal of the inverse, for a batch of small systems."""
    y = np.stack(xty.to_numpy())
    p = y.shape[1]
    inverse = np.linalg.pinv(np.stack(xtx.to_numpy()).reshape(-1, p, p), rcond=1e-10, hermitian=True)
    fits = np.concatenate([np.einsum("nij,nj->ni", inverse, y), np.einsum("nii->ni", inverse)], axis=1)
    return pd.Series(list(fits))


def remove_covariates(
    df: DataFrame,
    remove: Mapping[str, Column],
    keep: Mapping[str, Column],
    *,
    feature: str = "feature",
    value: str = "value",
    shrink: bool = False,
) -> DataFrame:
    """Per feature fit value ~ 1 + remove + keep by least squares and subtract the ``remove`` part only.

    The sums of products are ordinary grouped aggregates; only the small p x p systems, one per feature,
    are solved in Python, a batch at a time. Covariates that a feature cannot tell apart share the effect
    (pseudo-inverse). Numeric covariates should come centred. With ``shrink`` each removed coefficient is
    pulled towards its mean over features by the normal-normal posterior weight: the variance of the
    coefficients beyond their mean sampling variance is the prior variance.
    """
    names = ["__one", *[f"__r{i}" for i in range(len(remove))], *[f"__k{i}" for i in range(len(keep))]]
    columns = [F.lit(1.0), *remove.values(), *keep.values()]
    rows = df.select("*", *[c.cast("double").alias(n) for n, c in zip(names, columns)])
    used = rows.where(F.col(value).isNotNull())
    p = len(names)
    sums = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"__x{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [F.sum(F.col(n) * F.col(value)).alias(f"__y{i}") for i, n in enumerate(names)]
    sums += [F.sum(F.col(value) * F.col(value)).alias("__yy"), F.count(F.lit(1)).alias("__n")]
    grouped = used.groupBy(feature).agg(*sums)
    xtx = F.array(*[F.col(f"__x{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)])
    xty = F.array(*[F.col(f"__y{i}") for i in range(p)])
    solved = grouped.withColumn("__fit", _least_squares(xtx, xty))
    explained = F.lit(0.0)
    for i in range(p):
        explained = explained + F.element_at("__fit", i + 1) * F.col(f"__y{i}")
    s2 = F.greatest(F.col("__yy") - explained, F.lit(0.0)) / F.nullif(F.col("__n") - p, F.lit(0))
    betas = [F.element_at("__fit", i + 2).alias(f"__b{i}") for i in range(len(remove))]
    noise = [(F.element_at("__fit", p + i + 2) * s2).alias(f"__v{i}") for i in range(len(remove))]
    fits = solved.select(feature, *betas, *(noise if shrink else []))
    if shrink:
        fits = cut_lineage(fits)
        spread = fits.agg(
            *[F.avg(f"__b{i}").alias(f"m{i}") for i in range(len(remove))],
            *[(F.var_samp(f"__b{i}") - F.avg(f"__v{i}")).alias(f"t{i}") for i in range(len(remove))],
        ).first()  # two numbers per removed covariate
        for i in range(len(remove)):
            mean, prior = F.lit(float(spread[f"m{i}"] or 0.0)), max(float(spread[f"t{i}"] or 0.0), 0.0)
            weight = F.lit(prior) / F.nullif(F.lit(prior) + F.col(f"__v{i}"), F.lit(0.0))
            pulled = mean + F.coalesce(weight, F.lit(1.0)) * (F.col(f"__b{i}") - mean)
            fits = fits.withColumn(f"__b{i}", pulled)
    effect = F.lit(0.0)
    for i in range(len(remove)):
        effect = effect + F.col(f"__r{i}") * F.col(f"__b{i}")
    return rows.join(fits, feature).withColumn(value, F.col(value) - effect).select(*df.columns)


@dataclass(frozen=True)
class Prior:
    """What the removed coefficients of all features have in common."""

    mean: np.ndarray
    cov: np.ndarray


def _packed(*arrays: np.ndarray) -> pd.Series:
    return pd.Series([row.tobytes() for row in np.concatenate([a.reshape(len(a), -1) for a in arrays], axis=1).astype(float)])


def _posterior(info: np.ndarray, eta: np.ndarray, prior: Prior) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of the coefficients given precision ``info`` and information ``eta`` of each feature."""
    inverse = np.linalg.pinv(prior.cov, hermitian=True)
    if not inverse.any():  # no spread at all: the prior mean holds
        return np.tile(prior.mean, (len(info), 1)), np.zeros_like(info)
    cov = np.linalg.inv(info + inverse)
    return np.einsum("fij,fj->fi", cov, eta + inverse @ prior.mean), cov


def hierarchical_removal(
    df: DataFrame,
    remove: Mapping[str, Column],
    keep: Mapping[str, Column],
    *,
    feature: str = "feature",
    value: str = "value",
    steps: int = 25,
) -> DataFrame:
    """``remove_covariates`` with a joint normal prior of the removed coefficients over all features, fitted by EM.

    Every feature stays: one that cannot tell removed covariates apart, or has a single level of them, informs what it
    can, and the prior's mean and covariance fill in the rest. The noise of a feature is its residual variance; where it
    has no degree of freedom left, that of all features together. An EM step is one pass over packed rows of a
    feature's sums; mean and covariance of the prior are all that comes to the driver.
    """
    p, q = 1 + len(keep) + len(remove), len(remove)
    names = ["__one", *[f"__k{i}" for i in range(len(keep))], *[f"__r{i}" for i in range(q)]]
    rows = df.select("*", *[c.cast("double").alias(n) for n, c in zip(names, [F.lit(1.0), *keep.values(), *remove.values()])])
    level = rows.where(F.col(value).isNotNull()).groupBy(feature).agg(F.avg(value).alias("__level"))
    used = rows.where(F.col(value).isNotNull()).join(level, feature).withColumn("__y", F.col(value) - F.col("__level"))
    sums = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"__x{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [F.sum(F.col(n) * F.col("__y")).alias(f"__y{i}") for i, n in enumerate(names)]
    grouped = used.groupBy(feature).agg(*sums, F.sum(F.col("__y") * F.col("__y")).alias("__yy"), F.count(F.lit(1)).alias("__n"))
    xtx = F.array(*[F.col(f"__x{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)])
    xty = F.array(*[F.col(f"__y{i}") for i in range(p)])

    @F.pandas_udf("info binary, rss double, d long")
    def reduced(xtx: pd.Series, xty: pd.Series, yy: pd.Series, n: pd.Series) -> pd.DataFrame:
        """Precision and information of the removed part once the kept part is taken out, without the noise."""
        x, y = np.stack(xtx.to_numpy()).reshape(-1, p, p), np.stack(xty.to_numpy())
        inner = np.linalg.pinv(x[:, : p - q, : p - q], rcond=1e-10, hermitian=True)
        cross = np.einsum("fij,fjk->fik", x[:, p - q :, : p - q], inner)
        info = x[:, p - q :, p - q :] - np.einsum("fij,fjk->fik", cross, x[:, : p - q, p - q :])
        eta = y[:, p - q :] - np.einsum("fij,fj->fi", cross, y[:, : p - q])
        whole = np.linalg.pinv(x, rcond=1e-10, hermitian=True)
        rss = np.maximum(yy.to_numpy() - np.einsum("fi,fij,fj->f", y, whole, y), 0.0)
        rank = np.linalg.matrix_rank(x, tol=1e-9 * np.abs(x).max(axis=(1, 2)), hermitian=True)
        return pd.DataFrame({"info": _packed(info, eta), "rss": rss, "d": n.to_numpy() - rank})

    fits = grouped.select(feature, reduced(xtx, xty, F.col("__yy"), F.col("__n")).alias("__f")).select(feature, "__f.*")
    fits = cut_lineage(fits)
    pooled = fits.where("d > 0").agg((F.sum("rss") / F.sum("d")).alias("s2")).first()["s2"]
    own = F.when((F.col("d") > 0) & (F.col("rss") > 0), F.col("rss") / F.col("d")).otherwise(F.lit(float(pooled or 1.0) or 1.0))
    fits = fits.select(feature, "info", own.alias("s2"))

    def unpacked(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        flat = np.stack([np.frombuffer(x) for x in batch["info"]]) / batch["s2"].to_numpy()[:, None]
        return flat[:, : q * q].reshape(-1, q, q), flat[:, q * q :]

    def expected(prior: Prior) -> tuple[float, np.ndarray, np.ndarray]:
        """Number of features, and sums of the expected coefficients and of their products."""

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(1 + q + q * q)
            for batch in batches:
                if len(batch):
                    m, cov = _posterior(*unpacked(batch), prior)
                    second = (cov + m[:, :, None] * m[:, None, :]).sum(axis=0)
                    total += np.concatenate([[len(m)], m.sum(axis=0), second.reshape(-1)])
            yield pd.DataFrame({"sums": [total.tobytes()]})

        parts = [np.frombuffer(r["sums"]) for r in fits.mapInPandas(partial, "sums binary").collect()]
        total = np.sum([np.zeros(1 + q + q * q), *parts], axis=0)
        return total[0], total[1 : 1 + q], total[1 + q :].reshape(q, q)

    prior = Prior(np.zeros(q), np.eye(q))
    for _ in range(steps):
        n, first, second = expected(prior)
        if n == 0:
            break
        mean = first / n
        prior = Prior(mean, second / n - np.outer(mean, mean))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def effects(info: pd.Series, s2: pd.Series) -> pd.Series:
        return pd.Series(list(_posterior(*unpacked(pd.DataFrame({"info": info, "s2": s2})), prior)[0]))

    found = fits.select(feature, effects("info", "s2").alias("__b"))
    effect = sum((F.col(f"__r{i}") * F.element_at("__b", i + 1) for i in range(q)), F.lit(0.0))
    return rows.join(found, feature, "left").withColumn(value, F.col(value) - F.coalesce(effect, F.lit(0.0))).select(*df.columns)
