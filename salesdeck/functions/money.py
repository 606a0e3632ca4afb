"""Money and rounding.

Money travels through every plan as exact integer cents (LongType): line
arithmetic and sums are primitive long operations inside generated code, with
ANSI overflow checks (headroom 9.2e16 dollars per sum).  It becomes a double
only in the final projection, ``cents / 100.0``, which is the correctly
rounded double of the exact decimal value -- the same double a DECIMAL(38,2)
sum cast to DOUBLE gives.

Rounding of non-money doubles (averages, ratios) is half-up on the decimal
expansion: the value is cast to DECIMAL(28,10) first, so a binary neighbour
of a tie (1.005 -> 1.00499999...) rounds the way the printed number suggests.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dollars(cents: Column | str) -> Column:
    """Exact cents -> double dollars."""
    return _c(cents) / F.lit(100.0)


def round_half_up(x: Column | str, digits: int = 2) -> Column:
    """Half-up rounding of a double to ``digits`` places, returned as double."""
    return F.round(_c(x).cast("decimal(28,10)"), digits).cast("double")


def round_whole(x: Column | str) -> Column:
    """Half-up rounding to a whole number, returned as bigint."""
    return F.round(_c(x).cast("decimal(28,10)"), 0).cast("long")


def div_half_up(num: Column | str, den: Column | str | int) -> Column:
    """Exact integer quotient ``num / den`` rounded half away from zero
    (``den`` > 0).  Computed in DECIMAL(38,0): ``m - m % d`` is an exact
    multiple of ``d``, so the division is exact at any magnitude -- no double
    rounding, unlike ``round(num / den)`` in floating point, which turns an
    exact tie such as 11,724,617.10 / 12 = 977,051.425 into ...424999."""
    n = _c(num).cast("decimal(38,0)")
    d = (F.lit(den) if isinstance(den, int) else _c(den)).cast("decimal(38,0)")
    m = F.abs(n) * 2 + d
    q = ((m - m % (d * 2)) / (d * 2)).cast("long")
    return F.when(n < 0, -q).otherwise(q)


def cents_ratio(cents: Column | str, count: Column | str | int, digits: int = 2) -> Column:
    """Money (integer cents) divided by a count, half-up to ``digits`` <= 2
    decimal places, exactly; returned as double dollars."""
    scale = 10 ** (2 - digits)
    den = F.lit(count * scale) if isinstance(count, int) else _c(count) * F.lit(scale)
    return div_half_up(cents, den) / F.lit(float(10 ** digits))


def avg_dollars(cents: Column | str, digits: int = 2) -> Column:
    """Exactly rounded average of a cents column, in dollars (an aggregate)."""
    return cents_ratio(F.sum(_c(cents)), F.count(_c(cents)), digits)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when den is zero (ANSI division would raise)."""
    return F.try_divide(num.cast("double"), den.cast("double"))
