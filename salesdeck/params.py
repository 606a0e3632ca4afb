"""Analysis parameters.

The reference hard-codes its literals in the SQL text; here they are one
frozen dataclass passed to every analysis, so nothing hides in a query body.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # status value that marks an order as cancelled
    cancelled: str = "P"
    # "status <> cancelled" drops a NULL status (SQL rule, default); True keeps
    # such orders, as the app's pandas mask does
    keep_null_status: bool = False
    # "end of dataset" date against which inactivity is measured
    as_of: dt.date = dt.date(2001, 9, 1)
    # a customer is dormant when the last order is strictly older than this
    dormant_days: int = 180
    # profit thresholds (dollars) for Platinum, Gold, Silver; below -> Bronze
    tiers: tuple[float, float, float] = (1_500_000.0, 1_000_000.0, 500_000.0)
    # years with a column of their own in the product-line pivot (all others
    # share one), and the sort column
    pivot_years: tuple[int, ...] = (1995, 1996, 1997, 1998, 1999, 2000, 2001)
    pivot_sort_year: int = 2000
    # last month of the partial year used by the year-to-date comparison
    ytd_through_month: int = 8
    # an order is a fulfilment outlier when days > factor * status average
    outlier_factor: float = 2.0
    # more distinct order statuses than this are an error, not a category
    most_statuses: int = 1000
    # list lengths of the top-k reports
    top_dormant: int = 15
    top_customers: int = 20
    top_vip: int = 10
    page_size: int = 20
    deep_page: int = 30          # the page that is read from the stored page index
    order_buckets: int = 16      # of the order-grain tables; see sources.bucketed.buckets_for
    document_page: int = 50      # reps in one page of the column document
    # priority restock: at least these multiples of the catalogue's pace of
    # stock and of an ordered product's mean revenue
    restock_ratio: float = 2.0
    restock_revenue: float = 1.0
    label_width: int = 22
    # first order date of the second of two refresh batches (late orders in a
    # month that the first batch has opened)
    second_batch: dt.date = dt.date(1998, 3, 17)
    # apply the final ORDER BY of each analysis (off in the mart refresh job)
    ordered: bool = True


# Values of the reference's own data set (SQLite "stores" database).
REFERENCE = Params(
    cancelled="Cancelled",
    as_of=dt.date(2005, 6, 1),
    tiers=(100_000.0, 50_000.0, 20_000.0),
    pivot_years=(2003, 2004, 2005),
    pivot_sort_year=2004,
    ytd_through_month=5,
)

DEFAULT = Params()
