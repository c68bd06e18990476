"""Time expressions on ``TIMESTAMP_NTZ`` columns, independent of the session zone.

``timestampdiff`` and ``date_trunc`` first cast a zone-less timestamp to the session
zone, which moves times that fall in a daylight-saving gap. Subtraction and a cast to
DATE do not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400


def days_between(end: Column, start: Column) -> Column:
    """Days from ``start`` to ``end`` to two places; NULL if either is NULL."""
    seconds = (end - start).cast("interval second").cast("decimal(18,6)")
    return F.round(seconds / SECONDS_PER_DAY, 2).cast("decimal(12,2)")


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month")


def calendar_year(ts: Column) -> Column:
    return F.year(ts.cast("date"))
