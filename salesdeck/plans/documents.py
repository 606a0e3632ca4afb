"""Result documents for the web page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesdeck.operators.ranking import global_row_number
from salesdeck.params import DEFAULT, Params
from salesdeck.plans.people import rep_rows
from salesdeck.sinks import column_pages
from salesdeck.sources.star import Star

# field of the document -> column
FIELDS = {"x": "total_profit", "y": "sales_rep", "office": "office",
          "customers": "total_customers", "orders": "total_orders"}


def rep_json_document(star: Star, params: Params = DEFAULT) -> DataFrame:
    """Column document of all reps, best first, in pages of ``document_page``:
    one row per page with a list per field.  The position comes from a
    distributed ranking, so no task holds more than a page; the lists become
    JSON when ``sinks.write_document`` writes them."""
    ranked = global_row_number(rep_rows(star, params), [F.desc("total_profit"), F.asc("employeeNumber")], "position")
    return column_pages(ranked, "position", FIELDS, params.document_page)
