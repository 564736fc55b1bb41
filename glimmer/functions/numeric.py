"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scales a median absolute deviation to a normal standard deviation.
MAD_SCALE = 1.4826


def tidy(value: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zero."""
    return F.round(F.col(value) if isinstance(value, str) else value, digits) + F.lit(0.0)


def over(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def aspect(ys: Column, xs: Column, weight: Column) -> Column:
    """Aggregate: ratio of the longer to the shorter axis of a weighted cloud of pixels; null for a line."""
    total = F.sum(weight)
    my, mx = over(F.sum(weight * ys), total), over(F.sum(weight * xs), total)
    cyy = over(F.sum(weight * ys * ys), total) - my * my
    cxx = over(F.sum(weight * xs * xs), total) - mx * mx
    cxy = over(F.sum(weight * ys * xs), total) - my * mx
    half, spread = (cyy + cxx) / 2, F.sqrt(F.pow((cyy - cxx) / 2, 2) + cxy * cxy)
    low = half - spread
    return F.when(low > 1e-9, F.sqrt(over(half + spread, low)))
