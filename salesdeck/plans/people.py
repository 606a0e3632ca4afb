"""Sales reps, offices and the management hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesdeck.functions.labels import DASH, thousands_label
from salesdeck.functions.measures import full_name
from salesdeck.functions.money import cents_ratio, dollars, round_half_up, safe_ratio
from salesdeck.operators.ranking import global_row_number, present
from salesdeck.params import DEFAULT, Params
from salesdeck.plans.facts import rep_totals
from salesdeck.sources.bucketed import bucketed
from salesdeck.sources.star import Star
from salesdeck.sources.stored import scratch


def _reps(star: Star) -> DataFrame:
    """Employees with their office city (inner: an employee without office drops)."""
    off = star.offices.select("officeCode", F.col("city").alias("office"), "country", "territory")
    return star.employees.join(off, "officeCode")


def rep_rows(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Per rep: distinct customers, distinct orders, profit; every status counts.
    (Unordered: for reuse inside other plans.)"""
    r = rep_totals(star, params).join(_reps(star), "employeeNumber")
    return r.select(
        "employeeNumber",
        full_name("firstName", "lastName").alias("sales_rep"),
        "jobTitle", "office", "total_customers", "total_orders",
        dollars("profit_cents").alias("total_profit"),
    )


def rep_performance(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Rep rows, most profitable first (employee number breaks ties)."""
    return rep_rows(star, params).transform(present, params, F.desc("total_profit"), "employeeNumber")


def rep_performance_bucketed(star: Star, params: Params = DEFAULT) -> DataFrame:
    """The same rows from tables bucketed by order (``sources.bucketed``),
    written to the shared folder: no line or order is shuffled by order."""
    spark = star.orders.sparkSession
    path = scratch(spark, "bucketed")
    return rep_performance(bucketed(star, path.rsplit("/", 1)[1].replace("-", "_"), path, params.order_buckets), params)


def _hierarchy(star: Star) -> DataFrame:
    e = star.employees
    boss = e.select(F.struct(F.col("employeeNumber").alias("number"), "firstName", "lastName", "jobTitle").alias("boss"))
    off = star.offices.select("officeCode", "city")
    # self join on the adjacency list, one level; left keeps the root, whose boss is NULL
    return e.join(boss, e.reportsTo == F.col("boss.number"), "left").join(off, "officeCode")


def org_hierarchy(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Employee, manager and office; the root has NULL manager and sorts first."""
    h = _hierarchy(star)
    return h.select(
        full_name("firstName", "lastName").alias("employee"),
        "jobTitle",
        full_name("boss.firstName", "boss.lastName").alias("reports_to"),
        F.col("boss.jobTitle").alias("manager_title"),
        F.col("city").alias("office"),
        F.col("boss.lastName").alias("boss_last"), "lastName", "employeeNumber",
    ).transform(present, params, F.asc_nulls_first("boss_last"), F.asc_nulls_first("lastName"), "employeeNumber") \
     .drop("boss_last", "lastName", "employeeNumber")


def org_hierarchy_filled(star: Star, params: Params = DEFAULT) -> DataFrame:
    """App form: a missing manager name/title reads as a dash; sorted by the filled text."""
    h = _hierarchy(star)
    return h.select(
        full_name("firstName", "lastName").alias("employee"),
        F.col("jobTitle").alias("job_title"),
        F.when(F.col("boss").isNotNull(), full_name("boss.firstName", "boss.lastName"))
         .otherwise(F.lit(DASH)).alias("reports_to"),
        F.coalesce("boss.jobTitle", F.lit(DASH)).alias("manager_title"),
        "city", "employeeNumber",
    ).transform(present, params, "reports_to", "employee", "employeeNumber").drop("employeeNumber")


def hierarchy_role_class(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Role class from the job title: exact match, then substring test, then default."""
    jt = F.coalesce(F.col("jobTitle"), F.lit(""))
    return star.employees.select(
        "employeeNumber",
        full_name("firstName", "lastName").alias("employee"),
        "jobTitle",
        F.when(jt == "President", "president").when(jt.contains("Manager"), "manager")
         .otherwise("staff").alias("role_class"),
    )


def _office_totals(star: Star, params: Params) -> DataFrame:
    # rep-level totals roll up to offices: each rep has one office, each
    # customer one rep, so distinct counts are sums of the rep-level counts
    r = rep_totals(star, params).join(star.employees.select("employeeNumber", "officeCode"),
                                      "employeeNumber")
    agg = r.groupBy("officeCode").agg(
        F.count(F.lit(1)).alias("num_reps"),
        F.sum("total_customers").alias("num_customers"),
        F.sum("profit_cents").alias("profit_cents"))
    return agg.join(star.offices, "officeCode")


def office_rows(star: Star, params: Params = DEFAULT) -> DataFrame:
    o = _office_totals(star, params)
    return o.select("city", "country", "territory", "num_reps", "num_customers",
                    dollars("profit_cents").alias("total_profit"), "officeCode")


def office_performance(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Per office: reps, customers, profit; most profitable first."""
    return office_rows(star, params).transform(present, params, F.desc("total_profit"), "officeCode").drop("officeCode")



def rep_profit_flagged(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Rep bars: profit, a flag on the maximum, and the ``$505k`` label.

    The maximum is a one-row aggregate evaluated as a scalar subquery, not a
    window over all reps (which would run in one task)."""
    reps = rep_rows(star, params)
    top = reps.agg(F.max("total_profit")).scalar()
    return reps.select("employeeNumber", "sales_rep", "total_profit",
                       (F.col("total_profit") == top).alias("is_top"),
                       thousands_label(F.col("total_profit")).alias("profit_label"))


def rep_rank(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Position of each rep by profit (desc, employee number breaks ties)."""
    reps = rep_rows(star, params).select("employeeNumber", "sales_rep", "total_profit")
    return global_row_number(reps, [F.desc("total_profit"), F.asc("employeeNumber")], "rank")


def rep_profit_per_customer(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Profit per customer for each rep, best first (exact cents division)."""
    r = rep_totals(star, params).join(_reps(star), "employeeNumber")
    return r.select("employeeNumber", full_name("firstName", "lastName").alias("sales_rep"),
                    "total_customers", dollars("profit_cents").alias("total_profit"),
                    cents_ratio("profit_cents", "total_customers", 2).alias("profit_per_customer")) \
            .transform(present, params, F.desc("profit_per_customer"), "employeeNumber")


def office_lead_ratio(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Each office's profit over the next office's (by profit, descending).

    The window spans the office mart, one row per office (a fixed-size code
    table: 25 nations in the test data, 7 offices in the reference)."""
    o = _office_totals(star, params).select(
        "officeCode", "city", dollars("profit_cents").alias("total_profit"))
    w = Window.orderBy(F.desc("total_profit"), "officeCode")
    nxt = F.lead("total_profit").over(w)
    return o.select("city", "total_profit", nxt.alias("next_profit"),
                    round_half_up(safe_ratio(F.col("total_profit"), nxt), 2).alias("ratio_to_next"),
                    F.row_number().over(w).alias("position"))
