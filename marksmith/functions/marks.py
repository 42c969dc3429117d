"""Marks on the half-mark grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP, TIE = 0.5, 1e-9


def _finite(value: Column) -> Column:
    """The value as a double; null when it is no number, NaN or infinite."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def quantize(value: Column, maximum: Column | None = None, default: float = 0.0) -> Column:
    """The nearest half mark, halves up, not below 0 nor above ``maximum``."""
    number = F.greatest(F.coalesce(_finite(value), F.lit(float(default))), F.lit(0.0))
    snapped = F.floor(number / F.lit(STEP) + F.lit(0.5 + TIE)) * F.lit(STEP)
    if maximum is None:
        return snapped
    return F.least(snapped, F.greatest(_finite(maximum), F.lit(0.0)))  # least() passes over a null maximum


def is_valid_mark(value: Column) -> Column:
    number = _finite(value)
    return F.coalesce((number >= 0) & (F.abs(number / F.lit(STEP) - F.rint(number / F.lit(STEP))) <= F.lit(TIE)), F.lit(False))
