"""Numeric column expressions; all of them stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELLS_PER_OCTAVE = 4096


def missing_to_null(value: Column) -> Column:
    """NaN and NULL both mean missing; keep only NULL so that one test covers both."""
    return F.when(~F.isnan(value), value)


def signif(value: Column, digits: int = 3) -> Column:
    """Round to significant digits, half away from zero; 0 stays 0."""
    shift = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))) - F.lit(digits - 1))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value / shift) * shift)


def order_cell(value: Column, per_octave: int = CELLS_PER_OCTAVE) -> Column:
    """Whole number that never falls when ``value`` rises: a grid of equal relative width around zero.

    The grid depends on the value alone, so there is nothing to sample or collect, and every run and every
    recomputed task puts a row in the same cell. All doubles together have fewer than
    ``2 * 1100 * per_octave`` cells, which bounds any table of cell totals.
    """
    magnitude = F.least(F.log2(F.abs(value.cast("double")) * F.lit(2.0**40) + F.lit(1.0)), F.lit(1100.0))
    return (F.signum(value) * F.floor(magnitude * F.lit(float(per_octave)))).cast("long")
