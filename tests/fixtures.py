"""Hand-made micro fixture in the canonical retail schema (FIXTURES.md §4).

Profits are built from one product (buy price 10.00) and one line per order
with quantity 1, so each order's profit is ``priceEach - 10.00``.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from salesdeck.params import Params
from salesdeck.sources.schema import CANONICAL
from salesdeck.sources.star import star_from_canonical

PARAMS = Params(cancelled="Cancelled", as_of=dt.date(2005, 6, 1), dormant_days=180,
                tiers=(100_000.0, 50_000.0, 20_000.0), pivot_years=(2003, 2004, 2005),
                pivot_sort_year=2004, ytd_through_month=5)

OFFICES = [("1", "San Francisco", "USA", "NA"),
           ("2", "Paris", "France", "EMEA"),
           ("3", "Auckland  ", "New Zealand", "APAC"),
           ("4", "Auckland", "New Zealand", "APAC")]

# invented staff: a root, a head without "Manager" in the title, a manager,
# reps below both, one rep without customers, offices that differ by blanks
EMPLOYEES = [(10, "Noor", "Castellan", "President", None, "1"),
             (20, "Ilse", "Vandorn", "Head of Accounts", 10, "1"),
             (30, "Teo", "Marchetti", "Area Manager North", 10, "2"),
             (31, "Ines", "Okafor", "Account Rep", 30, "2"),
             (32, "Bram", "Marchetti", "Account Rep", 30, "2"),
             (21, "Yuki", "Solberg", "Account Rep", 20, "1"),
             (22, "Pavel", "Quist", "Account Rep", 20, "3"),       # rep without customers
             (23, "Dara", "Whitlock", "Account Rep", 20, "4")]

CUSTOMERS = [(101, "Alpha Corp", "Paris", "France", 31),
             (102, "Beta Ltd", "Lyon", "France", 31),
             (103, "Gamma SA", "Nantes", "France", 32),
             (104, "Delta Inc", "San Francisco", "USA", 21),
             (105, "Epsilon LLC", "San Francisco", "USA", 21),
             (106, "Zeta Co", "Boston", "USA", 21),
             (107, "Eta Very Long Customer Name Incorporated", "Auckland  ", "New Zealand", None),
             (108, "Theta GmbH", "Berlin", "Germany", 32),        # only cancelled orders
             (109, "Iota AB", "Oslo", "Norway", 31),              # no orders
             (110, "Kappa Ltd", "Auckland", "New Zealand", 23)]

# orderNumber, customerNumber, orderDate, shippedDate, status, priceEach (one line, qty 1)
ORDERS = [
    (1, 101, "2004-03-10", "2004-03-12", "Shipped", "100010.00"),   # profit 100,000.00 -> Platinum
    (2, 102, "2004-03-11", "2004-03-15", "Shipped", "100009.99"),   # 99,999.99 -> Gold
    (3, 103, "2004-04-01", "2004-04-02", "Shipped", "50010.00"),    # 50,000.00 -> Gold
    (4, 104, "2004-12-03", "2004-12-10", "Shipped", "50009.99"),    # 49,999.99; 180 days -> active
    (5, 105, "2004-12-02", "2004-12-04", "Resolved", "20010.00"),   # 20,000.00; 181 days -> dormant
    (6, 106, "2005-01-15", None, "On Hold", "20009.99"),            # 19,999.99 -> Bronze; not shipped
    (7, 107, "2003-01-20", "2003-01-25", "Shipped", "5.00"),        # negative profit -5.00
    (8, 108, "2003-02-01", "2003-02-03", "Cancelled", "1010.00"),   # cancelled but shipped
    (9, 104, "2003-05-05", "2003-05-06", None, "110.00"),           # NULL status, profit 100
    (10, 110, "2005-05-01", "2005-05-03", "Shipped", "50009.99"),   # ties rep 21? see tests
]

PRODUCTS = [("S10_1678", "1969 Harley Davidson", "Motorcycles", "10.00", 100),
            ("S12_1099", "1968 Ford Mustang", "Classic Cars", "10.00", 2)]


def canonical_frames(spark, orders=ORDERS, customers=CUSTOMERS):
    def df(name, rows):
        return spark.createDataFrame(rows, CANONICAL[name])

    order_rows = [(o, c, od, sd, st) for o, c, od, sd, st, _ in orders]
    # order 1 has a second line on the low-stock product (quantity 0 -> no money)
    detail_rows = [(o, "S10_1678", 1, Decimal(p)) for o, _, _, _, _, p in orders]
    detail_rows.append((1, "S12_1099", 3, Decimal("10.00")))
    return {
        "offices": df("offices", OFFICES),
        "employees": df("employees", EMPLOYEES),
        "customers": df("customers", customers),
        "orders": df("orders", order_rows),
        "orderdetails": df("orderdetails", detail_rows),
        "products": df("products", [(a, b, c, Decimal(d), e) for a, b, c, d, e in PRODUCTS]),
        "productlines": df("productlines", [("Motorcycles",), ("Classic Cars",)]),
        "payments": df("payments", [(customers[0][0], Decimal("12.50")), (customers[0][0], None)]),
    }


def micro_star(spark, **kw):
    return star_from_canonical(canonical_frames(spark, **kw))
