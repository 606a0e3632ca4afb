"""Dates on load, whatever they are stored as.

DATE columns pass through, timestamps lose their time, and text is read as an
ISO date with or without a time.  The reference parses order dates strictly (a
bad value is an error) and ship dates leniently (a bad value becomes NULL):
with ANSI mode on a cast raises on junk and ``try_cast`` yields NULL.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date_strict(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(c.cast("string")).cast("timestamp_ntz").cast("date")


def parse_date_lenient(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(c.cast("string")).try_cast("timestamp_ntz").cast("date")


def date_column(name: str, dtype: str, strict: bool) -> Column:
    """Column ``name`` of Spark type ``dtype`` as a DATE.  A stored date or
    timestamp is only cast, so filters on it still reach the scan."""
    if dtype == "string":
        return (parse_date_strict if strict else parse_date_lenient)(name).alias(name)
    return F.col(name).cast("date").alias(name)
