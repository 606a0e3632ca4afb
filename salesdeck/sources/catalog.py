"""Catalogue overview and plain scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesdeck.params import DEFAULT, Params
from salesdeck.sources.parse import parse_date_lenient as _lenient
from salesdeck.sources.parse import parse_date_strict as _strict
from salesdeck.sources.repair import repair_orders
from salesdeck.sources.star import Star
from salesdeck.sources.stored import scratch, shipped, store_orders


def table_overview(star: Star, params: Params = DEFAULT) -> DataFrame:
    """One row per table: name, number of attributes, number of rows
    (``PRAGMA table_info`` + ``COUNT(*)`` glued with UNION ALL).  Counts are
    distributed aggregates; only the one-row results are unioned."""
    parts = []
    for name, df in star.tables().items():
        counted = star.orders if name == "orders" else df
        parts.append(counted.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"),
            F.lit(len(df.columns)).cast("long").alias("attribute_count"),
            "row_count"))
    return reduce(DataFrame.unionByName, parts)


def store_tables(star: Star, root: str) -> dict[str, T.StructType]:
    """Every table of the star as Parquet under ``root``; their schemas."""
    for name, df in star.tables().items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    return {name: df.schema for name, df in star.tables().items()}


def _footer_session(spark: SparkSession) -> SparkSession:
    """A session that answers counts and bounds of Parquet files from their
    footers: the newer reader, with aggregates pushed down."""
    mine = spark.newSession()
    v1 = [x for x in mine.conf.get("spark.sql.sources.useV1SourceList").split(",") if x.strip() != "parquet"]
    mine.conf.set("spark.sql.sources.useV1SourceList", ",".join(v1))
    mine.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return mine


def stored_statistics(spark: SparkSession, root: str, schemas: dict[str, T.StructType]) -> DataFrame:
    """One row per stored table: attributes, rows, and the bounds of its first
    column where that is a number.  No data page is read: every figure is in
    the footers, whatever the size of the tables."""
    mine = _footer_session(spark)
    parts = []
    for name, schema in schemas.items():
        key = schema.fields[0]
        df = mine.read.schema(schema).parquet(f"{root}/{name}")
        bounds = [F.min(key.name).alias("low"), F.max(key.name).alias("high")] if isinstance(key.dataType, T.IntegralType) else []
        counted = df.agg(F.count(F.lit(1)).alias("row_count"), *bounds)
        low, high = (F.col(c).cast("long") if bounds else F.lit(None).cast("long") for c in ("low", "high"))
        parts.append(counted.select(F.lit(name).alias("table_name"), F.lit(len(schema.fields)).cast("long").alias("attribute_count"),
                                    "row_count", F.lit(key.name).alias("key_column"), low.alias("least_key"), high.alias("greatest_key")))
    return reduce(DataFrame.unionByName, parts)


def table_statistics(star: Star, params: Params = DEFAULT) -> DataFrame:
    """``stored_statistics`` of the star's tables, stored in the shared folder."""
    spark = star.orders.sparkSession
    root = scratch(spark, "tables")
    return stored_statistics(spark, root, store_tables(star, root))


def scan_table(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Full scan of a named table (the order lines, every column)."""
    return star.orderdetails.select("orderNumber", "productCode", "quantityOrdered",
                                    (F.col("revenue_cents") / F.lit(100.0)).alias("line_revenue"))


def scan_projected(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Scan with a column list: only these columns are read from Parquet."""
    return star.products.select("productCode", "productLine")


def scan_filtered(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Column list + pushed ``WHERE shippedDate IS NOT NULL``, over the orders
    stored by ship year (``sources.stored``; a star that was loaded from such
    a layout names it, else it is written to the shared folder first)."""
    orders = star.memo.get("stored_orders")
    if orders is None:
        orders = store_orders(star, scratch(star.orders.sparkSession, "orders"))
    return shipped(orders).select("status", "orderDate", "shippedDate")


def table_columns(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Column metadata as rows (``PRAGMA table_info``): table, position from 1,
    column and SQL type, taken from the tables' schemas; each row also carries
    the table's number of non-null values in the column."""
    parts = []
    for name, df in star.tables().items():
        counts = df.agg(*[F.count(f"`{f.name}`").alias(f.name) for f in df.schema.fields])
        parts.append(counts.select(F.explode(F.array(*[F.struct(
            F.lit(name).alias("table_name"), F.lit(i).cast("long").alias("position"), F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("column_type"), F.col(f.name).alias("n_values"))
            for i, f in enumerate(df.schema.fields, 1)])).alias("c")).select("c.*"))
    return reduce(DataFrame.unionByName, parts)


def parse_date_lenient(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Dates rendered as ISO text and parsed back: order dates strictly, ship
    dates leniently (an order without a ship date gives NULL, not an error)."""
    o = star.orders_shipped.select(
        "orderNumber",
        F.date_format("orderDate", "yyyy-MM-dd").alias("order_text"),
        F.coalesce(F.date_format("shippedDate", "yyyy-MM-dd"), F.lit("n/a")).alias("ship_text"))
    return o.select("orderNumber", "order_text", "ship_text",
                    _strict("order_text").alias("orderDate"),
                    _lenient("ship_text").alias("shippedDate"))


def _damaged_orders(star: Star) -> DataFrame:
    """The orders with their dates as text, some as broken as text dates get."""
    key = F.col("orderNumber")
    ordered, ship = F.date_format("orderDate", "yyyy-MM-dd"), F.date_format("shippedDate", "yyyy-MM-dd")
    return star.orders_shipped.select(
        "orderNumber", "status",
        F.when(key % 97 == 0, "unknown").when(key % 89 == 0, "2001-13-45").when(key % 83 == 0, "  ").otherwise(ordered).alias("orderDate"),
        F.when(key % 79 == 0, "n/a").when(key % 73 == 0, "1901-01-01").otherwise(ship).alias("shippedDate"))


def repaired_orders(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Orders with damaged text dates, repaired on load: the good rows."""
    return repair_orders(_damaged_orders(star), scratch(star.orders.sparkSession, "repaired")).good


def rejected_orders(star: Star, params: Params = DEFAULT) -> DataFrame:
    """What the same load rejects, as it came, with the reason."""
    return repair_orders(_damaged_orders(star), scratch(star.orders.sparkSession, "repaired")).rejects
