"""Column expressions. Everything here stays inside Spark's generated code."""

from parcelwise.functions.banding import Bands, band, position
from parcelwise.functions.labels import (
    category_name,
    delivery_status,
    satisfaction_bucket,
)
from parcelwise.functions.numeric import (
    average,
    average_where,
    cents,
    from_cents,
    pct,
    round_ratio,
    sum_cents,
    sum_where,
)
from parcelwise.functions.temporal import calendar_year, days_between, month_start

__all__ = [
    "Bands",
    "average",
    "average_where",
    "band",
    "calendar_year",
    "category_name",
    "cents",
    "days_between",
    "delivery_status",
    "from_cents",
    "month_start",
    "pct",
    "position",
    "round_ratio",
    "satisfaction_bucket",
    "sum_cents",
    "sum_where",
]
