"""Error measures of a prediction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def soft_error(pred: Column | str, low: Column | str, high: Column | str) -> Column:
    """Distance from an interval, zero within it."""
    p, lo, hi = _c(pred), _c(low), _c(high)
    return F.greatest(p - hi, F.lit(0.0)) + F.greatest(lo - p, F.lit(0.0))


def clip(value: Column | str, low: Column | str, high: Column | str) -> Column:
    return F.least(F.greatest(_c(value), _c(low)), _c(high))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison between engines; negative zero becomes zero."""
    return F.round(_c(c), digits) + F.lit(0.0)
