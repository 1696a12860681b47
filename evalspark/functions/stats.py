"""Numeric expressions over already aggregated counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the normal quantile of the 95% interval.
Z95 = 1.96


def wilson_interval(hits: Column, total: Column, inverted: Column | bool = False) -> Column:
    """Wilson 95% bounds in percent as ``struct(low, high)``, NULL when ``total`` is 0."""
    inverted = F.lit(inverted) if isinstance(inverted, bool) else inverted
    n = F.when(total > 0, total.cast("double"))
    p = hits / n
    denominator = 1 + Z95 * Z95 / n
    centre = (p + Z95 * Z95 / (2 * n)) / denominator
    margin = Z95 * F.sqrt((p * (1 - p) + Z95 * Z95 / (4 * n)) / n) / denominator
    low = F.when(n.isNotNull(), F.greatest(F.lit(0.0), centre - margin) * 100)
    high = F.when(n.isNotNull(), F.least(F.lit(1.0), centre + margin) * 100)
    return F.struct(
        F.when(inverted, 100 - high).otherwise(low).alias("low"),
        F.when(inverted, 100 - low).otherwise(high).alias("high"),
    )


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def rounded_mean(value: Column, digits: int = 3) -> Column:
    """Mean of the values as they are, rounded once, halves up; NULL without values.

    The sum of doubles depends on the order in its last bits, so the mean is read at six
    digits before the one rounding that is reported.
    """
    return F.round(F.avg(value).cast("decimal(38,6)"), digits).cast("double")
