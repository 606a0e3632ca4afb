"""The retail star as eight lazy DataFrames.

``load_star`` reads the supplied test tables through the adapter views of
``adapters.py``; ``load_canonical`` reads tables already in the retail model.
Both return the same ``Star``: money as integer cents (LongType), dates as
DateType, so every analysis sees one set of column names and types.

Nothing is read until an analysis runs an action; each analysis prunes the
columns it needs, so e.g. the ship-date aggregate of ``orders`` is only
computed by analyses that reference ``shippedDate``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesdeck.sources import adapters
from salesdeck.sources.parse import date_column
from salesdeck.sources.schema import CANONICAL, RAW

SELF_DESCRIBING = ("parquet", "orc")
DATES = ("orderDate", "shippedDate")
TABLES = ("offices", "employees", "customers", "orders", "orderdetails", "products", "productlines", "payments")


@dataclass(frozen=True)
class Star:
    offices: DataFrame        # officeCode, city, country, territory
    employees: DataFrame      # employeeNumber, firstName, lastName, jobTitle, reportsTo, officeCode
    customers: DataFrame      # customerNumber, customerName, city, country, salesRepEmployeeNumber
    orders: DataFrame         # orderNumber, customerNumber, orderDate, status (+ shippedDate: see below)
    orderdetails: DataFrame   # orderNumber, productCode, quantityOrdered, revenue_cents
    products: DataFrame       # productCode, productName, productLine, buy_price_cents, quantityInStock
    # orderNumber, shippedDate (NULL or absent when not shipped); None if the
    # orders carry the ship date themselves, as ``dated_orders``
    shipments: DataFrame | None
    dated_orders: DataFrame | None = None
    # no analysis needs these two; a source may lack them
    productlines: DataFrame | None = None  # productLine
    payments: DataFrame | None = None      # customerNumber, amount_cents
    # shared facts already materialised by a refresh job (see salesdeck.jobs);
    # empty unless a job fills it, so a plain star always computes from source
    memo: dict = field(default_factory=dict, compare=False, hash=False, repr=False)

    @property
    def orders_shipped(self) -> DataFrame:
        """``orders`` with ``shippedDate``: the loader's own columns if it has
        them, else a left join (unshipped orders keep NULL)."""
        if self.dated_orders is not None:
            return self.dated_orders
        return self.orders.join(self.shipments, "orderNumber", "left")

    def table(self, name: str) -> DataFrame:
        return self.orders_shipped if name == "orders" else getattr(self, name)

    def tables(self) -> dict[str, DataFrame]:
        """The tables that the source has, by name."""
        return {name: self.table(name) for name in TABLES if name == "orders" or getattr(self, name) is not None}


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(RAW[name]).parquet(f"{sf_dir}/{name}.parquet")


def _rtrim_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.rtrim(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType)
                       else F.col(f.name) for f in df.schema.fields])


def cleaned(star: Star) -> Star:
    """The same star with trailing blanks removed from every text column of
    the dimensions (``"Auckland  "`` -> ``"Auckland"``).  Off by default: the
    reference keeps such values distinct."""
    return Star(offices=_rtrim_text(star.offices), employees=_rtrim_text(star.employees),
                customers=_rtrim_text(star.customers), orders=star.orders,
                orderdetails=star.orderdetails, products=_rtrim_text(star.products),
                shipments=star.shipments, dated_orders=star.dated_orders,
                productlines=None if star.productlines is None else _rtrim_text(star.productlines),
                payments=star.payments, memo=star.memo)


def load_star(spark: SparkSession, sf_dir: str, clean: bool = False) -> Star:
    """Star over the supplied test tables (TPC-H-like names) via the adapter views."""
    raw = {n: read_raw(spark, sf_dir, n) for n in RAW}
    star = Star(
        offices=adapters.offices(raw["nation"], raw["region"]),
        employees=adapters.employees(raw["supplier"]),
        customers=adapters.customers(raw["customer"], raw["nation"], raw["region"], raw["supplier"]),
        orders=adapters.orders(raw["orders"]),
        orderdetails=adapters.orderdetails(raw["lineitem"]),
        products=adapters.products(raw["part"]),
        shipments=adapters.shipments(raw["lineitem"]),
        productlines=adapters.productlines(raw["part"]),
        payments=adapters.payments(raw["orders"]),
    )
    return cleaned(star) if clean else star


def _cents(col: str):
    # DECIMAL(18,2) -> exact integer cents, once, at the scan
    return (F.col(col) * F.lit(100)).cast("long")


def load_canonical(spark: SparkSession, root: str, fmt: str = "parquet", clean: bool = False,
                   tables: Sequence[str] = TABLES) -> Star:
    """Star over tables already in the retail model (one folder per table;
    ``tables`` names those there are: the last two may be missing).

    Dates may be stored as DATE, as a timestamp or as ISO text with or without
    a time: of text, order dates parse strictly (bad value = error), ship dates
    leniently (bad value = NULL).  Text columns are read as-is: no reader
    option that turns the text ``NA`` into NULL is set.
    """
    star = star_from_canonical({name: _read_canonical(spark, f"{root}/{name}", name, fmt) for name in tables})
    return cleaned(star) if clean else star


def _read_canonical(spark: SparkSession, path: str, name: str, fmt: str) -> DataFrame:
    schema = CANONICAL[name]
    if fmt in SELF_DESCRIBING and any(f.name in DATES for f in schema.fields):
        stored = spark.read.format(fmt).load(path).schema  # from the files' footers
        schema = T.StructType([stored[f.name] if f.name in DATES else f for f in schema.fields])
    return spark.read.schema(schema).format(fmt).load(path)


def star_from_canonical(frames: dict[str, DataFrame]) -> Star:
    """Star from DataFrames in the canonical schema (``schema.CANONICAL``)."""
    def read(name):
        return frames[name]

    kind = dict(read("orders").dtypes)
    dated = read("orders").select(
        "orderNumber", "customerNumber", date_column("orderDate", kind["orderDate"], strict=True),
        date_column("shippedDate", kind["shippedDate"], strict=False), "status")
    return Star(
        offices=read("offices"),
        employees=read("employees"),
        customers=read("customers"),
        orders=dated.drop("shippedDate"),
        orderdetails=read("orderdetails").select(
            "orderNumber", "productCode", "quantityOrdered",
            (F.col("quantityOrdered").cast("long") * _cents("priceEach")).alias("revenue_cents")),
        products=read("products").select(
            "productCode", "productName", "productLine",
            _cents("buyPrice").alias("buy_price_cents"), "quantityInStock"),
        shipments=None,
        dated_orders=dated,
        productlines=frames.get("productlines"),
        payments=frames["payments"].select("customerNumber", _cents("amount").alias("amount_cents")) if "payments" in frames else None,
    )
