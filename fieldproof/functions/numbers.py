"""Rounding that agrees with IEEE round-half-even on the exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**27 + 1 splits a double into two halves whose products are exact.
_SPLIT = 134217729.0


def exact_round(x: Column, digits: int) -> Column:
    """Round a double to ``digits`` decimals as if its exact value were known.

    ``round``/``bround`` decide ties on the printed decimal, so 2.675 becomes
    2.68 although the stored value lies below the tie. Here the product with
    the power of ten is carried as head plus exact remainder.
    """
    scale = float(10 ** digits)
    product = x * F.lit(scale)
    high = x * F.lit(_SPLIT) - (x * F.lit(_SPLIT) - x)
    low = x - high
    remainder = (high * F.lit(scale) - product) + low * F.lit(scale)
    whole = F.floor(product).cast("double")
    past_half = ((product - whole) - F.lit(0.5)) + remainder
    odd = F.abs(whole % 2) == 1
    up = (past_half > 0) | ((past_half == 0) & odd)
    rounded = (whole + F.when(up, 1.0).otherwise(0.0)) / F.lit(scale)
    # From 2**52 on a double has no decimals; NaN compares as larger than all.
    return F.when(F.abs(product) < F.lit(2.0 ** 52), rounded).otherwise(x)


def whole_text(x: Column) -> Column:
    """A double printed with no decimals, ties to even; ``nan``, ``inf`` and ``-inf`` by name."""
    named = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    # From 2**52 on a double is a whole number, whatever the rounding rule.
    return named.when(F.abs(x) >= F.lit(2.0 ** 52), F.format_string("%.0f", x)).otherwise(F.bround(x, 0).cast("bigint").cast("string"))
