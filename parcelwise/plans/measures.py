"""Aggregates that the rollups and findings share; all run over the order-level fact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelwise.functions import average, pct
from parcelwise.functions.labels import LATE, NEGATIVE_SCORE, ON_TIME, POSITIVE_SCORE


def score() -> Column:
    return F.col("review_score")


def value() -> Column:
    return F.col("order_value")


def is_late() -> Column:
    return F.col("delivery_status") == LATE


def is_on_time() -> Column:
    return F.col("delivery_status") == ON_TIME


def rows() -> Column:
    return F.count(F.lit(1))


def order_count() -> Column:
    return rows().alias("order_count")


def mean(column: str, alias: str) -> Column:
    return average(F.col(column)).alias(alias)


def share_where(condition: Column, whole: Column) -> Column:
    return pct(F.count_if(condition), whole)


def pct_late() -> Column:
    return share_where(is_late(), rows()).alias("pct_late")


def pct_on_time() -> Column:
    return share_where(is_on_time(), rows()).alias("pct_on_time")


def pct_negative_reviews(whole: Column) -> Column:
    return share_where(score() <= NEGATIVE_SCORE, whole).alias("pct_negative_reviews")


def pct_positive_reviews(whole: Column) -> Column:
    return share_where(score() >= POSITIVE_SCORE, whole).alias("pct_positive_reviews")


def avg_review_score() -> Column:
    return mean("review_score", "avg_review_score")


def avg_order_value() -> Column:
    return mean("order_value", "avg_order_value")


def total_order_value() -> Column:
    return F.sum(value()).alias("total_order_value")


def avg_delivery_days() -> Column:
    return mean("actual_delivery_days", "avg_delivery_days")


def avg_delivery_delay_days() -> Column:
    return mean("delivery_delay_days", "avg_delivery_delay_days")
