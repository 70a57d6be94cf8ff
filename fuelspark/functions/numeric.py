"""Rounding and money helpers.

Prices carry two decimals, so sums are taken over whole cents: integer sums do not depend on the
order in which partitions are merged, doubles do.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(col: Column, digits: int = 0) -> Column:
    """Round half toward plus infinity, the rule the analytics use everywhere."""
    scale = 10.0**digits
    return F.floor(col * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def cents(col: Column) -> Column:
    return F.floor(col * F.lit(100.0) + F.lit(0.5))


def mean_price(sum_cents: Column, n: Column) -> Column:
    """Average price rounded to 2 decimals from a sum of cents."""
    return F.when(n > 0, F.floor(sum_cents / n + F.lit(0.5)) / F.lit(100.0))


def clamp01(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def round4(col: Column) -> Column:
    return js_round(col, 4)


def pop_std(sum_sq: Column, total: Column, n: Column) -> Column:
    """Population deviation from power sums; exactly 0 is left to a min = max test by the caller."""
    mean = total / n
    return F.sqrt(F.greatest(F.lit(0.0), sum_sq / n - mean * mean))
