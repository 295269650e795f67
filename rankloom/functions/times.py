"""Dates as the numbers the operators order by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(c: Column) -> Column:
    """Whole seconds since 1970 in UTC, null for text that is no time."""
    return F.unix_seconds(c.try_cast("timestamp"))


def academic_year(c: Column) -> Column:
    """Start year of a label such as ``19-20``; null for any other form."""
    digits = F.regexp_extract(c.cast("string"), r"^(\d{2})-", 1)
    return F.concat(F.lit("20"), F.nullif(digits, F.lit(""))).try_cast("bigint")
