"""Quality rules on documents, and verdicts on hosts from the shrunk failure rates of their documents.

Documents are measured once. A host's failures are counted over all its documents; rates of hosts with few
documents are drawn towards the whole by a beta prior fitted to all hosts by moments (Kleinman 1973). The verdict
on the host is joined back and decides the borderline documents: one that fails a base rule, two rules or more, or
a rule clearly goes, one that fails no rule stays whatever its host, and one that fails a single rule by little stays
only if its host's shrunk rate is no more than the prior's mean and spread.

Rules: fewer than 20 words (base); more than 30 % of the words in repeated 8-word windows (base); more than one
symbol in ten words; mean word length outside 2 to 12; more than 30 % repeated lines.

Defined results: NULL text has no words; NULL is a host of its own; repeated rows count as documents of their own;
an empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundix.llm.words import Words, mix64, release, small_batches, windows, word_slices
from abundix.session import cut_lineage

WINDOW = 8
BROADCAST_HOSTS = 100_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOLS = np.zeros(256, dtype=np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(sums[bounds])


def _again(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measure(words: Words) -> dict[str, np.ndarray]:
    rows = len(words.bounds) - 1
    solid = np.zeros(len(words.data) + 1, dtype=np.int64)
    np.add.at(solid, words.starts, 1)
    np.add.at(solid, words.ends, -1)
    inside = np.cumsum(solid)[:-1] > 0
    points = inside & ((words.data & 0xC0) != 0x80)

    breaks = np.flatnonzero(words.data == 10)
    line_starts = np.concatenate([words.offsets[:-1], breaks + 1])
    line_rows = np.concatenate([np.arange(rows), np.searchsorted(words.offsets, breaks, side="right") - 1])
    order = np.lexsort((line_starts, line_rows))
    line_starts, line_rows = line_starts[order], line_rows[order]
    line_ends = np.empty_like(line_starts)
    line_ends[:-1] = line_starts[1:] - 1
    last_of_row = np.ones(len(line_rows), dtype=bool)
    last_of_row[:-1] = line_rows[1:] != line_rows[:-1]
    line_ends[last_of_row] = words.offsets[line_rows[last_of_row] + 1]
    filled = np.searchsorted(words.starts, line_ends) > np.searchsorted(words.starts, line_starts)
    line_rows = line_rows[filled]
    lines = Words(0, rows, words.data, words.offsets, line_starts[filled], line_ends[filled], words.bounds).hashes()
    lines = mix64(lines + mix64(line_rows.astype(np.uint64)))
    _, first = np.unique(lines, return_index=True)
    n_lines = np.bincount(line_rows, minlength=rows)

    starts, keys = windows(words.hashes(), words.bounds, WINDOW)
    keys = mix64(keys + mix64(words.row.astype(np.uint64)[starts]))
    twice = starts[_again(keys)]
    cover = np.zeros(len(words.starts) + WINDOW + 1, dtype=np.int64)
    cover[twice] += 1
    cover[twice + WINDOW] -= 1
    covered = np.cumsum(cover)[: len(words.starts)] > 0
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": _per_row(points, words.offsets),
        "n_symbols": _per_row(_SYMBOLS[words.data], words.offsets),
        "n_lines": n_lines.astype(np.int64),
        "n_dup_lines": (n_lines - np.bincount(line_rows[first], minlength=rows)).astype(np.int64),
        "n_repeat_words": _per_row(covered, words.bounds),
    }


def with_measures(df: DataFrame, text: str = "text", *, keep_text: bool = False) -> DataFrame:
    """The measures in place of ``text``, or beside it as ``__text``. Columns of the same names are replaced."""
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in MEASURES and c != text]
    rows = df.select(*kept, F.col(text).alias("__text"))
    schema = rows.select("*").schema if keep_text else rows.drop("__text").schema
    kept = [*kept, "__text"] if keep_text else kept
    for name in MEASURES:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_slices(batch.column("__text")):
                part = batch.slice(words.first, words.last - words.first)
                found = measure(words)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + [pa.array(found[m]) for m in MEASURES], names=[*kept, *MEASURES]
                )
        release()

    return rows.mapInArrow(run, schema)


RULES = {
    "few_words": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("few_words", "repeats")
# Repeated lines alone are never clear, as good documents have them too.
CLEAR = ("4 * n_symbols > n_words", "2 * word_chars < 3 * n_words OR word_chars > 20 * n_words")


def with_failures(measured: DataFrame) -> DataFrame:
    return measured.withColumn("failures", sum((F.expr(rule).cast("int") for rule in RULES.values()), F.lit(0)))


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """Rows (__host, host_rate, __bar), the last the mean and spread of the prior. What comes to the driver is four sums over all hosts."""
    hosts = with_failures(measured).groupBy(F.col(host).alias("__host")).agg(
        F.count(F.lit(1)).alias("__docs"), F.sum((F.col("failures") > 0).cast("long")).alias("__failed")
    )
    rate = F.col("__failed") / F.col("__docs")
    sums = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum("__docs").alias("docs"),
        F.sum("__failed").alias("failed"),
        F.sum(F.col("__docs") * rate * rate).alias("squares"),
    ).first()
    mean, weight = prior(sums["hosts"], sums["docs"] or 0, sums["failed"] or 0, sums["squares"] or 0.0)
    shrunk = (F.col("__failed") + F.lit(mean * weight)) / (F.col("__docs") + F.lit(weight))
    bar = mean + (mean * (1 - mean) / (weight + 1)) ** 0.5
    rates = hosts.select("__host", shrunk.alias("host_rate"), F.lit(bar).alias("__bar"))
    return F.broadcast(rates) if sums["hosts"] <= BROADCAST_HOSTS else rates


def host_verdicts(measured: DataFrame, rates: DataFrame, host: str) -> DataFrame:
    """Adds ``failures`` (rules failed), ``host_rate`` (shrunk), ``base_failed`` and ``kept``."""
    out = with_failures(measured).join(rates, F.col(host).eqNullSafe(rates["__host"])).drop("__host")
    any_of = lambda rules: F.expr(" OR ".join(f"({rule})" for rule in rules))
    borderline = (F.col("failures") == 1) & ~any_of(CLEAR)
    trusted = (F.col("failures") == 0) | (borderline & (F.col("host_rate") <= F.col("__bar")))
    base = any_of(RULES[name] for name in BASE)
    return out.withColumn("base_failed", base).withColumn("kept", ~base & trusted).drop("__bar")


def prior(hosts: int, docs: int, failed: int, squares: float) -> tuple[float, float]:
    """Mean and weight (a + b) of the beta prior; the weight of a prior without spread is that of a million documents."""
    if docs == 0:
        return 0.0, 1.0
    mean = failed / docs
    binomial = mean * (1 - mean)
    between = squares / docs - mean * mean - binomial * hosts / docs
    if between <= 0 or binomial == 0:
        return mean, 1e6
    return mean, min(1e6, max(1.0, binomial / between - 1))


def quality_rules(df: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """Measures and verdict of every document, in place of its text; columns of the same names are replaced."""
    measured = cut_lineage(with_measures(df, text))
    return host_verdicts(measured, host_rates(measured, host), host)


def kept_documents(df: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that the verdict keeps, with all their columns as they were.

    Two passes over the texts, so that no copy of them is checkpointed: rates first, then measures and verdict.
    """
    rates = host_rates(with_measures(df.select(host, text), text), host)
    others = F.struct(*[F.col(c) for c in df.columns if c != text])
    whole = df.select(others.alias("__row"), F.col(host).alias("__own"), F.col(text).alias("__body"))
    judged = host_verdicts(with_measures(whole, "__body", keep_text=True), rates, "__own")
    return judged.where("kept").select(*[(F.col("__text") if c == text else F.col("__row")[c]).alias(c) for c in df.columns])
