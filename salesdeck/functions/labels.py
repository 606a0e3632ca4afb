"""Display labels computed as columns (no per-row Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesdeck.functions.money import round_whole

# Fixed values of the reference: the ellipsis appended to cut labels and the
# dash shown for a missing manager.
ELLIPSIS = "…"
DASH = "—"


def thousands_label(dollars: Column) -> Column:
    """``$505k``: dollars / 1000, half-up to a whole number."""
    return F.concat(F.lit("$"), round_whole(dollars / F.lit(1000.0)).cast("string"), F.lit("k"))


def grouped_label(dollars: Column) -> Column:
    """``$1,234``: half-up to whole dollars with thousands separators."""
    return F.concat(F.lit("$"), F.format_number(round_whole(dollars), 0))


def days_label(days: Column) -> Column:
    """``3.8 days``."""
    return F.concat(days.cast("string"), F.lit(" days"))


def percent_label(pct: Column) -> Column:
    """``14.6%`` (pct already rounded)."""
    return F.concat(pct.cast("string"), F.lit("%"))


def truncate(text: Column, width: int) -> Column:
    """First ``width`` characters (the app's ``str[:22]``)."""
    return F.substring(text, 1, width)


def truncate_ellipsis(text: Column, width: int) -> Column:
    """First ``width`` characters plus an ellipsis when longer (the web page's rule)."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit(ELLIPSIS))) \
            .otherwise(text)
