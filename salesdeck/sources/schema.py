"""Explicit schemas.  No reader in this package infers a schema.

Two families:
  RAW_*       the star schema supplied as test data (only the columns used,
              so the Parquet scan reads nothing else);
  CANONICAL_* the retail model the analyses are written against.  Money is
              DECIMAL(18,2) at rest and integer cents inside the plans.
"""

from pyspark.sql import types as T

L, I, S, D = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()
NTZ = T.TimestampNTZType()
MONEY = T.DecimalType(18, 2)


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


RAW = {
    "region": _st(("r_regionkey", I, True), ("r_name", S, True)),
    "nation": _st(("n_nationkey", I, True), ("n_name", S, True), ("n_regionkey", I, True)),
    "supplier": _st(("s_suppkey", L, True), ("s_name", S, True), ("s_nationkey", I, True)),
    "customer": _st(("c_custkey", L, True), ("c_name", S, True), ("c_nationkey", I, True)),
    "part": _st(("p_partkey", L, True), ("p_name", S, True), ("p_type", S, True),
                ("p_size", I, True), ("p_retailprice", D, True)),
    "orders": _st(("o_orderkey", L, True), ("o_custkey", L, True), ("o_orderstatus", S, True),
                  ("o_orderdate", NTZ, True), ("o_totalprice", D, True)),
    "lineitem": _st(("l_orderkey", L, True), ("l_partkey", L, True), ("l_quantity", D, True),
                    ("l_extendedprice", D, True), ("l_shipdate", NTZ, True)),
}

CANONICAL = {
    "offices": _st(("officeCode", S, False), ("city", S, True), ("country", S, True),
                   ("territory", S, True)),
    "employees": _st(("employeeNumber", L, False), ("firstName", S, True), ("lastName", S, True),
                     ("jobTitle", S, True), ("reportsTo", L, True), ("officeCode", S, True)),
    "customers": _st(("customerNumber", L, False), ("customerName", S, True), ("city", S, True),
                     ("country", S, True), ("salesRepEmployeeNumber", L, True)),
    "orders": _st(("orderNumber", L, False), ("customerNumber", L, True),
                  ("orderDate", S, True), ("shippedDate", S, True), ("status", S, True)),
    "orderdetails": _st(("orderNumber", L, False), ("productCode", S, False),
                        ("quantityOrdered", I, True), ("priceEach", MONEY, True)),
    "products": _st(("productCode", S, False), ("productName", S, True), ("productLine", S, True),
                    ("buyPrice", MONEY, True), ("quantityInStock", I, True)),
    "productlines": _st(("productLine", S, False)),
    "payments": _st(("customerNumber", L, False), ("amount", MONEY, True)),
}
