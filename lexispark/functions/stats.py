"""Statistics with the guards that ANSI mode needs; each gives 0 where the value is undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_zero(value: Column) -> Column:
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def std_sample(x: Column) -> Column:
    return or_zero(F.stddev_samp(x))


def skew_unbiased(x: Column) -> Column:
    """Bias-corrected skewness of more than two values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, or_zero(F.skewness(x) * F.try_divide(F.sqrt(n * (n - 1)), n - 2))).otherwise(0.0)


def pearson(x: Column, y: Column) -> Column:
    """Correlation of more than two pairs; constant input gives 0."""
    return F.when(F.count(x) > 2, or_zero(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))).otherwise(0.0)


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope of y on x."""
    return or_zero(F.regr_slope(y, x))


def ratio(x: Column, y: Column) -> Column:
    return or_zero(F.try_divide(x.cast("double"), y.cast("double")))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))
