"""SQL over the registered views equals the DataFrame analyses: the nine
statements of the reference, in Spark's dialect (see ``views.py``)."""

from collections import Counter

import pytest

from salesdeck.params import DEFAULT
from salesdeck.registry import ANALYSES
from salesdeck.sources.star import load_star
from salesdeck.sources.views import register_views
from tests.conftest import SF_SMALL

PROFIT = "SUM(d.line_revenue - d.quantityOrdered * p.buyPrice)"
LINES = """t_orderdetails d JOIN t_products p ON p.productCode = d.productCode
           JOIN t_orders o ON o.orderNumber = d.orderNumber"""
PEOPLE = f"""{LINES} JOIN t_customers c ON c.customerNumber = o.customerNumber
           JOIN t_employees e ON e.employeeNumber = c.salesRepEmployeeNumber
           JOIN t_offices f ON f.officeCode = e.officeCode"""
TIERS = f"""SELECT c.customerNumber, c.customerName, c.city, c.country, {PROFIT} AS profit,
                   COUNT(DISTINCT o.orderNumber) AS total_orders
              FROM {LINES} JOIN t_customers c ON c.customerNumber = o.customerNumber
             GROUP BY c.customerNumber, c.customerName, c.city, c.country"""
SEGMENTS = f"""SELECT *, CASE WHEN profit >= 1500000 THEN 'Platinum' WHEN profit >= 1000000 THEN 'Gold'
                             WHEN profit >= 500000 THEN 'Silver' ELSE 'Bronze' END AS segment FROM ({TIERS})"""

STATEMENTS = {
    "rep_performance": f"""
        SELECT e.employeeNumber, e.firstName || ' ' || e.lastName AS sales_rep, e.jobTitle, f.city AS office,
               COUNT(DISTINCT c.customerNumber), COUNT(DISTINCT o.orderNumber), CAST({PROFIT} AS DOUBLE) AS total_profit
          FROM {PEOPLE} GROUP BY e.employeeNumber, e.firstName, e.lastName, e.jobTitle, f.city""",
    "org_hierarchy": """
        SELECT e.firstName || ' ' || e.lastName, e.jobTitle, m.firstName || ' ' || m.lastName, m.jobTitle, f.city
          FROM t_employees e LEFT JOIN t_employees m ON e.reportsTo = m.employeeNumber
          JOIN t_offices f ON f.officeCode = e.officeCode""",
    "office_performance": f"""
        SELECT f.city, f.country, f.territory, COUNT(DISTINCT e.employeeNumber), COUNT(DISTINCT c.customerNumber),
               CAST({PROFIT} AS DOUBLE) FROM {PEOPLE} GROUP BY f.officeCode, f.city, f.country, f.territory""",
    "monthly_revenue": f"""
        SELECT date_format(o.orderDate, 'yyyy') AS year, date_format(o.orderDate, 'MM') AS month,
               COUNT(DISTINCT o.orderNumber), CAST(SUM(d.line_revenue) AS DOUBLE), CAST({PROFIT} AS DOUBLE)
          FROM {LINES} WHERE o.status <> 'P' GROUP BY year, month""",
    "product_line_by_year": f"""
        SELECT date_format(o.orderDate, 'yyyy') AS year, p.productLine, CAST(SUM(d.line_revenue) AS DOUBLE),
               CAST({PROFIT} AS DOUBLE) FROM {LINES} WHERE o.status <> 'P' GROUP BY year, p.productLine""",
    "fulfilment_time": """
        SELECT *, CAST(avg_days AS STRING) || ' days' FROM (
        SELECT status, COUNT(*), CAST(round(CAST(AVG(days) AS DECIMAL(28,10)), 1) AS DOUBLE) AS avg_days, MIN(days), MAX(days)
          FROM (SELECT status, CAST(datediff(shippedDate, orderDate) AS DOUBLE) AS days FROM t_orders
                 WHERE shippedDate IS NOT NULL) GROUP BY status)""",
    "customer_segments_all": f"""
        SELECT customerNumber, customerName, city, country, CAST(profit AS DOUBLE), total_orders, segment FROM ({SEGMENTS})""",
    "segment_summary_all": f"""
        SELECT segment, COUNT(*), CAST(round(SUM(profit) / COUNT(*), 2) AS DOUBLE), CAST(SUM(profit) AS DOUBLE),
               CAST(round(CAST(AVG(total_orders) AS DECIMAL(28,10)), 1) AS DOUBLE) FROM ({SEGMENTS}) GROUP BY segment""",
    "dormant_customers": """
        SELECT c.customerNumber, c.customerName, c.city, c.country,
               MAX(o.orderDate) AS last_order_date,
               CAST(datediff(DATE'2001-09-01', MAX(o.orderDate)) AS BIGINT) AS days_since_order
          FROM t_customers c JOIN t_orders o ON o.customerNumber = c.customerNumber
         GROUP BY c.customerNumber, c.customerName, c.city, c.country
        HAVING days_since_order > 180""",
}


@pytest.mark.parametrize("name", STATEMENTS)
def test_sql_over_views(spark, name):
    star = load_star(spark, SF_SMALL)
    register_views(star, prefix="t_")
    want = ANALYSES[name](star, DEFAULT)
    assert Counter(map(tuple, spark.sql(STATEMENTS[name]).collect())) == Counter(map(tuple, want.collect()))
