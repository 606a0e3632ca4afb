"""Independent DuckDB formulations of every analysis (the correctness oracle).

Written in plain SQL over the raw test tables, with the adapter views
(FIXTURES.md §3) repeated as CTEs and money as DECIMAL(18,2) -- not the
integer-cents arithmetic of the Spark side -- so the two agree only if the
Spark plans are right.  Rounding of doubles goes through DECIMAL(28,10) on
both sides (half-up on the printed value).
"""

from __future__ import annotations

CANCELLED = "'P'"
AS_OF = "DATE '2001-09-01'"
DORMANT = 180
T1, T2, T3 = 1500000, 1000000, 500000

VIEWS = f"""
offices AS (
  SELECT CAST(n.n_nationkey AS VARCHAR) AS officeCode, n.n_name AS city, n.n_name AS country,
         r.r_name AS territory
    FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
employees AS (
  SELECT s_suppkey AS employeeNumber,
         split_part(s_name, '#', 1) AS firstName, split_part(s_name, '#', 2) AS lastName,
         CASE WHEN s_suppkey = 0 THEN 'President' WHEN s_suppkey <= 4 THEN 'Sales Manager'
              ELSE 'Sales Rep' END AS jobTitle,
         CASE WHEN s_suppkey = 0 THEN NULL ELSE (s_suppkey - 1) // 4 END AS reportsTo,
         CAST(s_nationkey AS VARCHAR) AS officeCode
    FROM supplier),
customers AS (
  SELECT c.c_custkey AS customerNumber, c.c_name AS customerName, n.n_name AS city,
         r.r_name AS country,
         CASE WHEN c.c_custkey % 5 = 0 THEN NULL
              ELSE c.c_custkey % ((SELECT count(*) FROM supplier) - 2) END AS salesRepEmployeeNumber
    FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                    JOIN region r ON n.n_regionkey = r.r_regionkey),
ords AS (
  SELECT o.o_orderkey AS orderNumber, o.o_custkey AS customerNumber,
         CAST(o.o_orderdate AS DATE) AS orderDate, o.o_orderstatus AS status, s.shippedDate
    FROM orders o
    LEFT JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS shippedDate
                 FROM lineitem GROUP BY l_orderkey) s ON s.l_orderkey = o.o_orderkey),
orderdetails AS (
  SELECT l_orderkey AS orderNumber, l_partkey AS productCode,
         CAST(l_quantity AS INTEGER) AS quantityOrdered,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS line_revenue
    FROM lineitem),
products AS (
  SELECT p_partkey AS productCode, p_name AS productName, p_type AS productLine,
         CAST(p_retailprice AS DECIMAL(18,2)) AS buyPrice, p_size * 10 AS quantityInStock
    FROM part),
productlines AS (SELECT DISTINCT p_type AS productLine FROM part WHERE p_type IS NOT NULL),
payments AS (
  SELECT o_custkey AS customerNumber, CAST(o_totalprice AS DECIMAL(18,2)) AS amount
    FROM orders WHERE o_orderstatus <> 'P')"""

# the priced line fact: every order line with its product; "sold" adds the order
SOLD = """priced AS (
  SELECT li.orderNumber, pr.productCode, pr.productLine, li.quantityOrdered AS qty,
         li.line_revenue AS rev, li.line_revenue - li.quantityOrdered * pr.buyPrice AS prof
    FROM orderdetails li JOIN products pr USING (productCode)),
sold AS (
  SELECT pc.*, od.customerNumber, od.orderDate, od.status
    FROM priced pc JOIN ords od USING (orderNumber))"""


def r(x: str, d: int) -> str:
    """Half-up rounding of a double through DECIMAL(28,10), as double."""
    return f"CAST(round(CAST({x} AS DECIMAL(28,10)), {d}) AS DOUBLE)"


def rw(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,10)), 0) AS BIGINT)"


def hu(c: str, n: str) -> str:
    """Integer c / n, half away from zero, n > 0 (exact, HUGEINT)."""
    return f"((CASE WHEN ({c}) < 0 THEN -1 ELSE 1 END) * ((2 * abs({c}) + ({n})) // (2 * ({n}))))"


def cents(x: str) -> str:
    return f"CAST(({x}) * 100 AS HUGEINT)"


def q(*ctes_and_body: str) -> str:
    *ctes, body = ctes_and_body
    return "WITH " + ",\n".join([VIEWS, SOLD, *ctes]) + "\n" + body


# fact first: sold lines -> their customer -> the customer's rep -> the rep's office
REPS = """reps AS (
  SELECT emp.employeeNumber, emp.firstName || ' ' || emp.lastName AS sales_rep, emp.jobTitle,
         ofc.city AS office, COUNT(DISTINCT cu.customerNumber) AS total_customers,
         COUNT(DISTINCT s.orderNumber) AS total_orders,
         CAST(SUM(s.prof) AS DOUBLE) AS total_profit, SUM(s.prof) AS tp_dec
    FROM sold s
    JOIN customers cu  ON cu.customerNumber = s.customerNumber
    JOIN employees emp ON emp.employeeNumber = cu.salesRepEmployeeNumber
    JOIN offices ofc   ON ofc.officeCode = emp.officeCode
   GROUP BY emp.employeeNumber, emp.firstName, emp.lastName, emp.jobTitle, ofc.city)"""

OFFICES = """offs AS (
  SELECT ofc.officeCode, ofc.city, ofc.country, ofc.territory,
         COUNT(DISTINCT emp.employeeNumber) AS num_reps,
         COUNT(DISTINCT cu.customerNumber) AS num_customers,
         CAST(SUM(s.prof) AS DOUBLE) AS total_profit
    FROM sold s
    JOIN customers cu  ON cu.customerNumber = s.customerNumber
    JOIN employees emp ON emp.employeeNumber = cu.salesRepEmployeeNumber
    JOIN offices ofc   ON ofc.officeCode = emp.officeCode
   GROUP BY ofc.officeCode, ofc.city, ofc.country, ofc.territory)"""

HIER = """h AS (
  SELECT w.*, b.employeeNumber AS m_num, b.firstName AS m_first, b.lastName AS m_last,
         b.jobTitle AS m_title, ofc.city AS o_city
    FROM employees w
    JOIN offices ofc ON ofc.officeCode = w.officeCode
    LEFT JOIN employees b ON w.reportsTo = b.employeeNumber)"""

# non-cancelled sold lines (NULL status fails "<>" and is dropped, SQL rule)
LINES_NC = f"""lnc AS (
  SELECT orderNumber, orderDate, productLine, rev AS line_revenue, prof AS profit
    FROM sold WHERE status <> {CANCELLED})"""

DAMAGED = """damaged AS (
  SELECT orderNumber, status,
         CASE WHEN orderNumber % 97 = 0 THEN 'unknown' WHEN orderNumber % 89 = 0 THEN '2001-13-45'
              WHEN orderNumber % 83 = 0 THEN '  ' ELSE strftime(orderDate, '%Y-%m-%d') END AS od,
         CASE WHEN orderNumber % 79 = 0 THEN 'n/a' WHEN orderNumber % 73 = 0 THEN '1901-01-01'
              ELSE strftime(shippedDate, '%Y-%m-%d') END AS sd
    FROM ords),
reasoned AS (
  SELECT *, CASE WHEN orderNumber IS NULL THEN 'no order number'
                 WHEN od IS NULL OR trim(od) = '' THEN 'no order date'
                 WHEN TRY_CAST(od AS DATE) IS NULL THEN 'order date is no date'
                 WHEN TRY_CAST(sd AS DATE) < TRY_CAST(od AS DATE) THEN 'shipped before ordered' END AS reason
    FROM damaged)"""

MONTHLY = """mon AS (
  SELECT CAST(year(orderDate) AS VARCHAR) AS year, CAST(month(orderDate) AS BIGINT) AS month,
         CAST(date_trunc('month', orderDate) AS DATE) AS period,
         COUNT(DISTINCT orderNumber) AS num_orders,
         CAST(SUM(line_revenue) AS DOUBLE) AS revenue, CAST(SUM(profit) AS DOUBLE) AS profit,
         SUM(line_revenue) AS rev_dec
    FROM lnc GROUP BY 1, 2, 3)"""

LINE_YEAR = """ly AS (
  SELECT strftime(orderDate, '%Y') AS year, productLine,
         SUM(line_revenue) AS rev, SUM(profit) AS prof
    FROM lnc GROUP BY 1, 2)"""


def segments_cte(name: str, cancelled_in: bool) -> str:
    keep = "TRUE" if cancelled_in else f"s.status <> {CANCELLED}"
    return f"""{name}_base AS (
  SELECT cu.customerNumber, cu.customerName, cu.city, cu.country,
         SUM(s.prof) AS tp, COUNT(DISTINCT s.orderNumber) AS total_orders
    FROM sold s JOIN customers cu ON cu.customerNumber = s.customerNumber
   WHERE {keep}
   GROUP BY cu.customerNumber, cu.customerName, cu.city, cu.country),
{name} AS (
  SELECT *, CASE WHEN tp >= {T1} THEN 'Platinum' WHEN tp >= {T2} THEN 'Gold'
                 WHEN tp >= {T3} THEN 'Silver' ELSE 'Bronze' END AS segment
    FROM {name}_base)"""


def summary_body(src: str) -> str:
    return f"""SELECT segment, COUNT(*) AS num_customers,
       {hu(cents("SUM(tp)"), "COUNT(*)")} / 100.0 AS avg_profit,
       CAST(SUM(tp) AS DOUBLE) AS total_profit,
       {r("AVG(total_orders)", 1)} AS avg_orders
  FROM {src} GROUP BY segment"""


SEG_OUT = """SELECT customerNumber, customerName, city, country, CAST(tp AS DOUBLE) AS total_profit,
       total_orders, segment FROM {src}"""

DORMANT_CTE = f"""dl AS (
  SELECT customerNumber, last_order_date, days_since
    FROM (SELECT customerNumber, MAX(orderDate) AS last_order_date,
                 CAST({AS_OF} - MAX(orderDate) AS BIGINT) AS days_since
            FROM ords GROUP BY customerNumber) t
   WHERE days_since > {DORMANT})"""

DWS = """dws AS (
  SELECT d.customerNumber, cu.customerName, cu.city, cu.country, d.last_order_date, d.days_since,
         g.segment, CAST(g.tp AS DOUBLE) AS total_profit
    FROM dl d JOIN customers cu ON cu.customerNumber = d.customerNumber
    LEFT JOIN seg g ON g.customerNumber = d.customerNumber)"""

SHIPPED = """sh AS (
  SELECT orderNumber, status, orderDate, shippedDate,
         CAST(shippedDate - orderDate AS DOUBLE) AS days_to_ship
    FROM ords WHERE shippedDate IS NOT NULL)"""

STOCK = """st AS (
  SELECT productCode, productName, productLine, units_ordered, quantityInStock
    FROM (SELECT productCode, CAST(SUM(qty) AS BIGINT) AS units_ordered
            FROM priced GROUP BY productCode) u
    JOIN products USING (productCode)),
st2 AS (
  SELECT *, """ + r("CAST(units_ordered AS DOUBLE) / NULLIF(CAST(quantityInStock AS DOUBLE), 0)", 2) + """ AS low_stock_ratio
    FROM st)"""

PERF = """perf AS (
  SELECT pr.productCode, pr.productName, pr.productLine,
         CAST(agg.rev AS DOUBLE) AS revenue, CAST(agg.prof AS DOUBLE) AS profit
    FROM products pr
    LEFT JOIN (SELECT productCode, SUM(rev) AS rev, SUM(prof) AS prof
                 FROM priced GROUP BY productCode) agg USING (productCode))"""

PLAT = """plat AS (
  SELECT SUM(CASE WHEN segment = 'Platinum' THEN tp END) AS plat, SUM(tp) AS alltp FROM seg)"""
PLAT_SHARE = r("CAST(plat * 100 * 100 AS DOUBLE) / NULLIF(CAST(alltp * 100 AS DOUBLE), 0)", 2)

ORACLE_SQL: dict[str, str] = {
    # ------------------------------------------------------------ people
    "rep_performance": q(REPS, """SELECT employeeNumber, sales_rep, jobTitle, office,
        total_customers, total_orders, total_profit FROM reps"""),
    "rep_performance_bucketed": q(REPS, """SELECT employeeNumber, sales_rep, jobTitle, office,
        total_customers, total_orders, total_profit FROM reps"""),
    "org_hierarchy": q(HIER, """SELECT firstName || ' ' || lastName AS employee, jobTitle,
        m_first || ' ' || m_last AS reports_to, m_title AS manager_title, o_city AS office FROM h"""),
    "org_hierarchy_filled": q(HIER, """SELECT firstName || ' ' || lastName AS employee,
        jobTitle AS job_title,
        CASE WHEN m_num IS NOT NULL THEN m_first || ' ' || m_last ELSE '—' END AS reports_to,
        COALESCE(m_title, '—') AS manager_title, o_city AS city FROM h"""),
    "office_performance": q(OFFICES, """SELECT city, country, territory, num_reps, num_customers,
        total_profit FROM offs"""),
    "hierarchy_role_class": q("""SELECT employeeNumber, firstName || ' ' || lastName AS employee, jobTitle,
        CASE WHEN jobTitle = 'President' THEN 'president'
             WHEN contains(jobTitle, 'Manager') THEN 'manager' ELSE 'staff' END AS role_class
        FROM employees"""),
    "rep_profit_flagged": q(REPS, f"""SELECT employeeNumber, sales_rep, total_profit,
        total_profit = (SELECT max(total_profit) FROM reps) AS is_top,
        '$' || CAST({rw("total_profit / 1000")} AS VARCHAR) || 'k' AS profit_label FROM reps"""),
    "rep_rank": q(REPS, """SELECT employeeNumber, sales_rep, total_profit,
        CAST(ROW_NUMBER() OVER (ORDER BY total_profit DESC, employeeNumber) AS BIGINT) AS rank
        FROM reps"""),
    "rep_profit_per_customer": q(REPS, f"""SELECT employeeNumber, sales_rep, total_customers,
        total_profit, {hu(cents("tp_dec"), "total_customers")} / 100.0 AS profit_per_customer
        FROM reps"""),
    "office_lead_ratio": q(OFFICES, f"""SELECT city, total_profit,
        LEAD(total_profit) OVER w AS next_profit,
        {r("total_profit / NULLIF(LEAD(total_profit) OVER w, 0)", 2)} AS ratio_to_next,
        CAST(ROW_NUMBER() OVER w AS BIGINT) AS position
        FROM offs WINDOW w AS (ORDER BY total_profit DESC, officeCode)"""),
    # ------------------------------------------------------------ trends
    "monthly_revenue": q(LINES_NC, """SELECT strftime(orderDate, '%Y') AS year,
        strftime(orderDate, '%m') AS month, COUNT(DISTINCT orderNumber) AS num_orders,
        CAST(SUM(line_revenue) AS DOUBLE) AS revenue, CAST(SUM(profit) AS DOUBLE) AS profit
        FROM lnc GROUP BY 1, 2"""),
    "monthly_refreshed": q(f"""SELECT CAST(year(orderDate) AS VARCHAR) AS year, CAST(month(orderDate) AS BIGINT) AS month,
        COUNT(DISTINCT orderNumber) AS num_orders, CAST(SUM(rev) AS DOUBLE) AS revenue,
        CAST(SUM(prof) AS DOUBLE) AS profit, COUNT(DISTINCT customerNumber) AS num_customers
        FROM sold WHERE status <> {CANCELLED} GROUP BY 1, 2"""),
    "monthly_revenue_period": q(LINES_NC, MONTHLY, """SELECT year, month, period, num_orders,
        revenue, profit FROM mon"""),
    "product_line_by_year": q(LINES_NC, LINE_YEAR, """SELECT year, productLine,
        CAST(rev AS DOUBLE) AS revenue, CAST(prof AS DOUBLE) AS profit FROM ly"""),
    "product_line_pivot": q(LINES_NC, LINE_YEAR, "SELECT productLine, " + ", ".join(
        f"MAX(CASE WHEN year = '{y}' THEN CAST(prof AS DOUBLE) / 1000.0 END) AS profit_{y}"
        for y in range(1995, 2002)) + """,
        CAST(SUM(CASE WHEN year NOT BETWEEN '1995' AND '2001' THEN prof END) AS DOUBLE) / 1000.0 AS profit_other_years
        FROM ly GROUP BY productLine"""),
    "monthly_by_year_series": q(LINES_NC, MONTHLY, """SELECT year,
        list(month ORDER BY month) AS months, list(revenue ORDER BY month) AS revenues,
        COUNT(*) AS n_points FROM mon GROUP BY year"""),
    "monthly_margin_proxy": q(LINES_NC, MONTHLY, f"""SELECT year,
        strftime(period, '%Y-%m') AS period_label, revenue,
        CAST({hu(cents("rev_dec") + " * 4", "1000")} AS BIGINT) AS approx_profit FROM mon"""),
    "seasonal_peak": q(LINES_NC, MONTHLY, f"""pk AS (
        SELECT year, month, revenue,
               ROW_NUMBER() OVER (PARTITION BY year ORDER BY revenue DESC, month) AS rn FROM mon),
        agg AS (SELECT year, MAX(CASE WHEN rn = 1 THEN month END) AS peak_month,
                MAX(revenue) AS peak_revenue,
                MAX(CASE WHEN month = 1 THEN revenue END) AS january_revenue
           FROM pk GROUP BY year)""", f"""SELECT year, peak_month, peak_revenue, january_revenue,
        {r("peak_revenue / NULLIF(january_revenue, 0)", 2)} AS peak_to_january FROM agg"""),
    "product_line_share": q(LINES_NC, """pl AS (
        SELECT productLine, SUM(profit) AS prof FROM lnc GROUP BY productLine)""",
        f"""SELECT productLine, CAST(prof AS DOUBLE) AS profit,
        {r("CAST(prof * 100 * 100 AS DOUBLE) / NULLIF(CAST((SELECT SUM(prof) FROM pl) * 100 AS DOUBLE), 0)", 2)}
        AS share_pct FROM pl"""),
    "product_line_rank": q(LINES_NC, LINE_YEAR, """SELECT year, productLine,
        CAST(prof AS DOUBLE) AS profit,
        CAST(RANK() OVER (PARTITION BY year ORDER BY prof DESC) AS BIGINT) AS rank_desc,
        RANK() OVER (PARTITION BY year ORDER BY prof ASC) = 1 AS is_weakest FROM ly"""),
    "year_to_date": q(LINES_NC, """y AS (
        SELECT CAST(year(orderDate) AS VARCHAR) AS year,
               CAST(SUM(line_revenue) AS DOUBLE) AS revenue_ytd,
               CAST(SUM(profit) AS DOUBLE) AS profit_ytd,
               COUNT(DISTINCT orderNumber) AS orders_ytd
          FROM lnc WHERE month(orderDate) <= 8 GROUP BY 1)""", f"""SELECT year, revenue_ytd,
        profit_ytd, orders_ytd, LAG(revenue_ytd) OVER (ORDER BY year) AS prev_revenue_ytd,
        {r("(revenue_ytd - LAG(revenue_ytd) OVER (ORDER BY year)) / NULLIF(LAG(revenue_ytd) OVER (ORDER BY year), 0) * 100", 1)}
        AS growth_pct FROM y"""),
    "distinct_years": q("SELECT DISTINCT strftime(orderDate, '%Y') AS year FROM ords"),
    # -------------------------------------------------------- fulfilment
    "fulfilment_time": q(SHIPPED, f"""SELECT status, COUNT(*) AS num_orders,
        {r("AVG(days_to_ship)", 1)} AS avg_days_to_ship, MIN(days_to_ship) AS min_days,
        MAX(days_to_ship) AS max_days,
        CAST({r("AVG(days_to_ship)", 1)} AS VARCHAR) || ' days' AS avg_label
        FROM sh GROUP BY status"""),
    "fulfilment_outliers": q(SHIPPED, """a AS (
        SELECT status, AVG(days_to_ship) AS status_avg FROM sh GROUP BY status)""",
        f"""SELECT sh.orderNumber, sh.status, sh.days_to_ship,
        {r("a.status_avg", 2)} AS status_avg_days,
        {r("sh.days_to_ship / NULLIF(a.status_avg, 0)", 2)} AS ratio_to_avg
        FROM sh JOIN a ON sh.status IS NOT DISTINCT FROM a.status
        WHERE sh.days_to_ship > 2.0 * a.status_avg"""),
    # --------------------------------------------------------- customers
    "customer_segments_all": q(segments_cte("seg", True), SEG_OUT.format(src="seg")),
    "customer_segments": q(segments_cte("seg", False), SEG_OUT.format(src="seg")),
    "segment_summary_all": q(segments_cte("seg", True), summary_body("seg")),
    "segment_summary": q(segments_cte("seg", False), summary_body("seg")),
    "segment_summary_ordered": q(segments_cte("seg", False), f"sm AS ({summary_body('seg')})",
        """tiers(segment, tier_order) AS (
            VALUES ('Platinum', 1), ('Gold', 2), ('Silver', 3), ('Bronze', 4))""",
        """SELECT t.segment, CAST(t.tier_order AS BIGINT) AS tier_order,
        COALESCE(sm.num_customers, 0) AS num_customers,
        COALESCE(sm.total_profit, 0.0) AS total_profit, sm.avg_profit, sm.avg_orders
        FROM tiers t LEFT JOIN sm ON sm.segment = t.segment"""),
    "segment_share": q(segments_cte("seg", False), """tiers(segment, tier_order) AS (
            VALUES ('Platinum', 1), ('Gold', 2), ('Silver', 3), ('Bronze', 4)),
        n AS (SELECT t.segment, CAST(t.tier_order AS BIGINT) AS tier_order,
                     (SELECT COUNT(*) FROM seg s WHERE s.segment = t.segment) AS num_customers
                FROM tiers t)""", f"""pc AS (SELECT segment, tier_order, num_customers,
        {r("CAST(num_customers * 100 AS DOUBLE) / NULLIF(CAST(SUM(num_customers) OVER () AS DOUBLE), 0)", 1)}
        AS share_pct FROM n)""", """SELECT *, CAST(share_pct AS VARCHAR) || '%' AS share_label FROM pc"""),
    "segment_concentration": q(segments_cte("seg", False), f"sm AS ({summary_body('seg')})",
        f"""SELECT SUM(CASE WHEN segment = 'Platinum' THEN total_profit END) AS top_total,
        SUM(CASE WHEN segment = 'Bronze' THEN total_profit END) AS bottom_total,
        CAST(SUM(CASE WHEN segment = 'Platinum' THEN num_customers END) AS BIGINT) AS top_customers,
        CAST(SUM(CASE WHEN segment = 'Bronze' THEN num_customers END) AS BIGINT) AS bottom_customers,
        {r("SUM(CASE WHEN segment = 'Platinum' THEN total_profit END) / NULLIF(SUM(CASE WHEN segment = 'Bronze' THEN total_profit END), 0)", 2)}
        AS top_to_bottom_ratio FROM sm"""),
    "segment_filter_gold": q(segments_cte("seg", False), """SELECT customerName AS customer, city,
        country, CAST(tp AS DOUBLE) AS profit, total_orders AS orders, segment
        FROM seg WHERE segment = 'Gold'"""),
    "segment_filter_all": q(segments_cte("seg", False), """SELECT customerName AS customer, city,
        country, CAST(tp AS DOUBLE) AS profit, total_orders AS orders, segment FROM seg"""),
    "segment_code_lookup": q(segments_cte("seg", False), DORMANT_CTE, DWS, """SELECT customerNumber,
        segment, COALESCE(CASE segment WHEN 'Platinum' THEN '#ffd700' WHEN 'Gold' THEN '#50c8a0'
                                       WHEN 'Silver' THEN '#4a90e2' WHEN 'Bronze' THEN '#ff7c7c' END,
                          '#9aa0cc') AS colour FROM dws"""),
    "case_segment": q(f"""cs AS (
        SELECT customerNumber, SUM(prof) AS tp FROM sold
         WHERE status <> {CANCELLED} GROUP BY customerNumber)""",
        f"""SELECT customerNumber, CAST(tp AS DOUBLE) AS total_profit,
        CASE WHEN tp >= {T1} THEN 'Platinum' WHEN tp >= {T2} THEN 'Gold'
             WHEN tp >= {T3} THEN 'Silver' ELSE 'Bronze' END AS segment FROM cs"""),
    "table_page": q(segments_cte("seg", False), SEG_OUT.format(src="seg")
                    + " ORDER BY total_profit DESC, customerNumber LIMIT 20 OFFSET 20"),
    "table_page_stored": q(segments_cte("seg", False), SEG_OUT.format(src="seg")
                           + " ORDER BY total_profit DESC, customerNumber LIMIT 20 OFFSET 580"),
    "top_k": q(segments_cte("seg", True), SEG_OUT.format(src="seg")
               + " ORDER BY total_profit DESC, customerNumber LIMIT 20"),
    "dormant_customers": q(DORMANT_CTE, """SELECT d.customerNumber, c.customerName, c.city,
        c.country, d.last_order_date, d.days_since AS days_since_order
        FROM dl d JOIN customers c ON c.customerNumber = d.customerNumber"""),
    "dormant_with_segment": q(segments_cte("seg", False), DORMANT_CTE, DWS, "SELECT * FROM dws"),
    "dormant_top15": q(segments_cte("seg", False), DORMANT_CTE, DWS, """SELECT customerName,
        substr(customerName, 1, 22) AS label, country, segment, days_since, total_profit
        FROM dws ORDER BY days_since DESC, customerNumber LIMIT 15"""),
    "reengagement_target": q(segments_cte("seg", False), DORMANT_CTE, DWS, """SELECT customerNumber,
        customerName, country, segment, days_since, total_profit
        FROM dws ORDER BY total_profit DESC NULLS LAST, customerNumber LIMIT 1"""),
    "fn_truncate_label": q(segments_cte("seg", False), DORMANT_CTE, DWS, """lab AS (
        SELECT customerNumber, customerName || ' (' || country || ')' AS label_full FROM dws)""",
        """SELECT customerNumber, label_full, substr(label_full, 1, 22) AS label_app,
        CASE WHEN length(label_full) > 22 THEN substr(label_full, 1, 22) || '…'
             ELSE label_full END AS label_web FROM lab"""),
    # --------------------------------------------------------- inventory
    "low_stock": q(STOCK, "SELECT * FROM st2"),
    "product_performance": q(PERF, "SELECT * FROM perf"),
    "priority_restock": q(STOCK, PERF, """pace AS (
        SELECT CAST(SUM(units_ordered) AS DOUBLE) / CAST(SUM(quantityInStock) AS DOUBLE) AS pace FROM st),
        mean AS (SELECT CAST(SUM(rev_cents) AS DOUBLE) / COUNT(rev_cents) AS mean FROM (
                   SELECT CAST(SUM(rev) * 100 AS BIGINT) AS rev_cents FROM priced GROUP BY productCode))""",
        """SELECT * FROM st2
        WHERE CAST(units_ordered AS DOUBLE) / NULLIF(CAST(quantityInStock AS DOUBLE), 0) >= 2.0 * (SELECT pace FROM pace)
          AND productCode IN (SELECT productCode FROM priced GROUP BY productCode
               HAVING CAST(CAST(SUM(rev) * 100 AS BIGINT) AS DOUBLE) >= 1.0 * (SELECT mean FROM mean))"""),
    "vip_customers": q("""ct AS (
        SELECT customerNumber, CAST(SUM(prof) AS DOUBLE) AS total_profit
          FROM sold GROUP BY customerNumber),
        top AS (SELECT * FROM ct ORDER BY total_profit DESC, customerNumber LIMIT 10)""",
        """SELECT t.customerNumber, c.customerName, c.city, c.country, t.total_profit
        FROM top t JOIN customers c ON c.customerNumber = t.customerNumber"""),
    # ------------------------------------------------------- key figures
    "kpi_strip": q(REPS, OFFICES, segments_cte("seg", False), DORMANT_CTE, DWS, PLAT,
        f"""SELECT {hu(cents("SUM(tp_dec)"), "1000000")} / 100.0 AS total_profit_m,
        (SELECT sales_rep FROM reps ORDER BY total_profit DESC, employeeNumber LIMIT 1) AS top_rep,
        (SELECT city FROM offs ORDER BY total_profit DESC, officeCode LIMIT 1) AS top_office,
        (SELECT COUNT(*) FROM dws) AS num_dormant,
        (SELECT {PLAT_SHARE} FROM plat) AS platinum_share_pct
        FROM reps"""),
    "platinum_share": q(segments_cte("seg", False), PLAT, f"""SELECT CAST(plat AS DOUBLE) AS platinum_profit,
        CAST(alltp AS DOUBLE) AS total_profit, {PLAT_SHARE} AS platinum_share_pct FROM plat"""),
    # ------------------------------------------------ catalogue and scans
    "table_overview": q("""SELECT 'offices' AS table_name, CAST(4 AS BIGINT) AS attribute_count, COUNT(*) AS row_count FROM offices
        UNION ALL SELECT 'employees', 6, COUNT(*) FROM employees
        UNION ALL SELECT 'customers', 5, COUNT(*) FROM customers
        UNION ALL SELECT 'orders', 5, COUNT(*) FROM ords
        UNION ALL SELECT 'orderdetails', 4, COUNT(*) FROM orderdetails
        UNION ALL SELECT 'products', 5, COUNT(*) FROM products
        UNION ALL SELECT 'productlines', 1, COUNT(*) FROM productlines
        UNION ALL SELECT 'payments', 2, COUNT(*) FROM payments"""),
    "table_statistics": q(" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST({n} AS BIGINT) AS attribute_count, COUNT(*) AS row_count, '{key}' AS key_column, "
        + (f"MIN({key}) AS least_key, MAX({key}) AS greatest_key" if number else "CAST(NULL AS BIGINT) AS least_key, CAST(NULL AS BIGINT) AS greatest_key")
        + f" FROM {rel}"
        for t, rel, n, key, number in (
            ("offices", "offices", 4, "officeCode", False), ("employees", "employees", 6, "employeeNumber", True),
            ("customers", "customers", 5, "customerNumber", True), ("orders", "ords", 5, "orderNumber", True),
            ("orderdetails", "orderdetails", 4, "orderNumber", True), ("products", "products", 5, "productCode", True),
            ("productlines", "productlines", 1, "productLine", False), ("payments", "payments", 2, "customerNumber", True)))),
    "table_columns": q(" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST({i} AS BIGINT) AS position, '{c}' AS column_name, "
        f"'{kind}' AS column_type, COUNT({expr or c}) AS n_values FROM {rel or t}"
        for t, rel, cols in (
            ("offices", None, (("officeCode", "string"), ("city", "string"), ("country", "string"), ("territory", "string"))),
            ("employees", None, (("employeeNumber", "bigint"), ("firstName", "string"), ("lastName", "string"),
                                 ("jobTitle", "string"), ("reportsTo", "bigint"), ("officeCode", "string"))),
            ("customers", None, (("customerNumber", "bigint"), ("customerName", "string"), ("city", "string"),
                                 ("country", "string"), ("salesRepEmployeeNumber", "bigint"))),
            ("orders", "ords", (("orderNumber", "bigint"), ("customerNumber", "bigint"), ("orderDate", "date"),
                                ("status", "string"), ("shippedDate", "date"))),
            ("orderdetails", None, (("orderNumber", "bigint"), ("productCode", "bigint"), ("quantityOrdered", "int"),
                                    ("revenue_cents", "bigint", "line_revenue"))),
            ("products", None, (("productCode", "bigint"), ("productName", "string"), ("productLine", "string"),
                                ("buy_price_cents", "bigint", "buyPrice"), ("quantityInStock", "int"))),
            ("productlines", None, (("productLine", "string"),)),
            ("payments", None, (("customerNumber", "bigint"), ("amount_cents", "bigint", "amount"))))
        for i, (c, kind, *more) in enumerate(cols, 1) for expr in [more[0] if more else None])),
    "rep_json_document": q(REPS, """ranked AS (
        SELECT *, ROW_NUMBER() OVER (ORDER BY total_profit DESC, employeeNumber) AS pos FROM reps)""",
        """SELECT CAST((pos - 1) // 50 AS BIGINT) AS page, list(total_profit ORDER BY pos) AS x,
        list(sales_rep ORDER BY pos) AS y, list(office ORDER BY pos) AS office,
        list(total_customers ORDER BY pos) AS customers, list(total_orders ORDER BY pos) AS orders
        FROM ranked GROUP BY 1"""),
    "scan_table": q("""SELECT orderNumber, productCode, quantityOrdered,
        CAST(line_revenue AS DOUBLE) AS line_revenue FROM orderdetails"""),
    "scan_projected": q("SELECT productCode, productLine FROM products"),
    "scan_filtered": q("SELECT status, orderDate, shippedDate FROM ords WHERE shippedDate IS NOT NULL"),
    "parse_date_lenient": q("""SELECT orderNumber, strftime(orderDate, '%Y-%m-%d') AS order_text,
        COALESCE(strftime(shippedDate, '%Y-%m-%d'), 'n/a') AS ship_text,
        orderDate, shippedDate FROM ords"""),
    "repaired_orders": q(DAMAGED, """SELECT orderNumber, status, TRY_CAST(od AS DATE) AS orderDate,
        TRY_CAST(sd AS DATE) AS shippedDate FROM reasoned WHERE reason IS NULL"""),
    "rejected_orders": q(DAMAGED, """SELECT orderNumber, status, od AS orderDate, sd AS shippedDate, reason
        FROM reasoned WHERE reason IS NOT NULL"""),
    "country_profit": q(f"""cp AS (
        SELECT customerNumber, COUNT(DISTINCT orderNumber) AS orders, SUM(rev) AS revenue, SUM(prof) AS profit
        FROM sold WHERE status <> {CANCELLED} GROUP BY customerNumber)""",
        """SELECT c.country, COUNT(*) AS customers, CAST(SUM(orders) AS BIGINT) AS orders,
        CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(profit) AS DOUBLE) AS profit,
        COUNT(*) FILTER (profit > (SELECT SUM(profit) / COUNT(*) FROM cp)) AS above_average
        FROM cp JOIN customers c USING (customerNumber) GROUP BY c.country"""),
    # -------------------------------------------------- single operators
    "filter_not_cancelled": q(f"""SELECT orderNumber, customerNumber, orderDate, status
        FROM ords WHERE status <> {CANCELLED}"""),
    "filter_shipped": q("""SELECT orderNumber, orderDate, shippedDate, status
        FROM ords WHERE shippedDate IS NOT NULL"""),
    "join_inner": q("""SELECT c.customerNumber, c.customerName, e.employeeNumber,
        e.firstName || ' ' || e.lastName AS sales_rep
        FROM customers c JOIN employees e ON c.salesRepEmployeeNumber = e.employeeNumber"""),
    "join_left": q("""SELECT c.customerNumber, c.customerName, n.num_orders
        FROM customers c LEFT JOIN (SELECT customerNumber, COUNT(*) AS num_orders
                                      FROM ords GROUP BY customerNumber) n
          ON n.customerNumber = c.customerNumber"""),
    "agg_sum": q("""SELECT status, CAST(SUM(rev) AS DOUBLE) AS revenue,
        CAST(SUM(prof) AS DOUBLE) AS profit FROM sold GROUP BY status"""),
    "agg_count": q("SELECT status, COUNT(*) AS num_orders FROM ords GROUP BY status"),
    "agg_count_distinct": q("""SELECT productLine, COUNT(DISTINCT orderNumber) AS num_orders,
        COUNT(DISTINCT customerNumber) AS num_customers FROM sold GROUP BY productLine"""),
    "customers_by_line": q(f"""SELECT productLine, COUNT(DISTINCT customerNumber) AS num_customers
        FROM sold WHERE status <> {CANCELLED} GROUP BY productLine"""),
    "customers_by_year": q(f"""cy AS (
        SELECT DISTINCT year(orderDate) AS y, customerNumber FROM sold WHERE status <> {CANCELLED})""",
        """SELECT CAST(a.y AS VARCHAR) AS year, COUNT(*) AS num_customers, COUNT(b.customerNumber) AS num_returning
        FROM cy a LEFT JOIN cy b ON b.y = a.y - 1 AND b.customerNumber = a.customerNumber GROUP BY a.y"""),
    "agg_avg": q(f"""SELECT productLine,
        {hu(cents("SUM(rev)"), "COUNT(rev)")} / 100.0 AS avg_line_revenue,
        {r("AVG(qty)", 1)} AS avg_quantity FROM priced GROUP BY productLine"""),
    "agg_min_max": q("""SELECT productLine, CAST(MIN(buyPrice) AS DOUBLE) AS min_buy_price,
        CAST(MAX(buyPrice) AS DOUBLE) AS max_buy_price,
        CAST(MIN(quantityInStock) AS BIGINT) AS min_stock,
        CAST(MAX(quantityInStock) AS BIGINT) AS max_stock FROM products GROUP BY productLine"""),
    "fn_concat": q("""SELECT e.employeeNumber, e.firstName || ' ' || e.lastName AS employee,
        o.city || ' / ' || o.territory AS office_label
        FROM employees e JOIN offices o ON o.officeCode = e.officeCode"""),
    "fn_year_month": q("""SELECT orderNumber, strftime(orderDate, '%Y') AS year,
        strftime(orderDate, '%m') AS month, CAST(year(orderDate) AS BIGINT) AS year_num,
        CAST(month(orderDate) AS BIGINT) AS month_num FROM ords"""),
    "fn_month_start": q("""SELECT orderNumber, orderDate,
        CAST(date_trunc('month', orderDate) AS DATE) AS period FROM ords"""),
    "fn_days_between": q(f"""SELECT orderNumber,
        CAST(shippedDate - orderDate AS DOUBLE) AS days_fractional,
        CAST(shippedDate - orderDate AS BIGINT) AS days_whole,
        CAST({AS_OF} - orderDate AS BIGINT) AS days_to_as_of
        FROM ords WHERE shippedDate IS NOT NULL"""),
    "fn_round": q(f"""cs AS (
        SELECT customerNumber, SUM(prof) AS tp, COUNT(DISTINCT orderNumber) AS total_orders
          FROM sold WHERE status <> {CANCELLED} GROUP BY customerNumber)""", f"""SELECT customerNumber,
        {hu(cents("tp"), "total_orders")} / 100.0 AS avg_order_profit_2,
        {hu(cents("tp"), "10 * total_orders")} / 10.0 AS avg_order_profit_1,
        CAST({hu(cents("tp"), "100 * total_orders")} AS BIGINT) AS avg_order_profit_0 FROM cs"""),
    "fn_labels": q(REPS, f"""SELECT employeeNumber,
        '$' || CAST({rw("total_profit / 1000")} AS VARCHAR) || 'k' AS profit_k_label,
        '$' || format('{{:,}}', {rw("total_profit")}) AS profit_label FROM reps"""),
}
