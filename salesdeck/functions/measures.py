"""Derived measures of the retail model, defined once.

line revenue  quantityOrdered * priceEach           (cents, carried by orderdetails)
line profit   quantityOrdered * (priceEach - buyPrice) = revenue - quantity * buyPrice
days to ship  shippedDate - orderDate, in days
tier          Platinum / Gold / Silver / Bronze on the (exact, cent-rounded) profit
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tier names and their display order (fixed values of the reference).
TIERS = ("Platinum", "Gold", "Silver", "Bronze")


def line_profit_cents(revenue: str = "revenue_cents", qty: str = "quantityOrdered",
                      buy: str = "buy_price_cents") -> Column:
    return F.col(revenue) - F.col(qty).cast("long") * F.col(buy)


def tier(profit_cents: Column | str, thresholds: tuple[float, float, float]) -> Column:
    """Searched CASE, first match wins; NULL profit falls through to Bronze."""
    p = F.col(profit_cents) if isinstance(profit_cents, str) else profit_cents
    plat, gold, silver = (int(round(t * 100)) for t in thresholds)
    return (F.when(p >= plat, TIERS[0])
             .when(p >= gold, TIERS[1])
             .when(p >= silver, TIERS[2])
             .otherwise(TIERS[3]))


def days_between(end: Column | str, start: Column | str) -> Column:
    """Fractional day difference of two dates/timestamps (SQL julianday form)."""
    e = F.col(end) if isinstance(end, str) else end
    s = F.col(start) if isinstance(start, str) else start
    return F.timestamp_diff("SECOND", s.cast("timestamp_ntz"), e.cast("timestamp_ntz")) / F.lit(86400.0)


def whole_days_between(end: Column | str, start: Column | str) -> Column:
    """Calendar-day difference as bigint (pandas ``.dt.days`` on midnight values)."""
    e = F.col(end) if isinstance(end, str) else end
    s = F.col(start) if isinstance(start, str) else start
    return F.datediff(e.cast("date"), s.cast("date")).cast("long")


def not_cancelled(status: str, cancelled: str) -> Column:
    """SQL rule: ``status <> 'Cancelled'`` drops NULL status as well."""
    return F.col(status) != F.lit(cancelled)


def not_cancelled_pandas(status: str, cancelled: str) -> Column:
    """pandas-mask rule: a NULL status is kept."""
    return ~F.col(status).eqNullSafe(F.lit(cancelled))


def full_name(first: str, last: str) -> Column:
    """``first || ' ' || last``: NULL if either part is NULL (unlike concat_ws)."""
    return F.concat(F.col(first), F.lit(" "), F.col(last))
