"""Eighteen business findings on delivery reliability, each a function of the views."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import Bands, average_where, band, pct, position, sum_where
from parcelwise.functions.labels import STATUS_ORDER
from parcelwise.operators import SortKey, distributed_ntile, share_of_total
from parcelwise.plans import measures as m
from parcelwise.plans.views import Views

# Smallest group ranked, days that count as severe, quantile groups and bands.
MIN_ORDERS = 100
SEVERE_DAYS = 7
VALUE_GROUPS = 4
HANDLING_BANDS = Bands((2, 4, 7), ("Under 2 days", "2-3 days", "4-6 days", "7+ days"))
SHIPPING_BANDS = Bands((2, 5, 8), ("Under 2 days", "2-4 days", "5-7 days", "8+ days"))
DELAY_BANDS = Bands(
    (0, 2, 7, 14),
    ("On Time", "1-2 days late", "3-7 days late", "8-14 days late", "15+ days late"),
    inclusive=True,
)


def _late_first() -> Column:
    return position(F.col("delivery_status"), STATUS_ORDER)


def _highest(column: str, then: str) -> list[Column]:
    """Descending with NULLs first, then a label so that the order is always the same."""
    return [F.col(column).desc_nulls_first(), F.col(then).asc_nulls_last()]


def overall_reliability(views: Views) -> DataFrame:
    return views.reliability_summary.select(
        "delivery_status",
        "order_count",
        "pct_of_orders",
        "avg_delivery_days",
        "avg_delivery_delay_days",
        "avg_review_score",
        "pct_negative_reviews",
        "pct_positive_reviews",
        "avg_order_value",
        "total_order_value",
    ).orderBy(_late_first())


def satisfaction_by_status(views: Views) -> DataFrame:
    """Reviewed orders only."""
    return (
        views.order_metrics.filter(m.score().isNotNull())
        .groupBy("delivery_status")
        .agg(
            m.rows().alias("reviewed_orders"),
            m.avg_review_score(),
            m.pct_negative_reviews(m.rows()),
            m.pct_positive_reviews(m.rows()),
        )
        .orderBy(_late_first())
    )


def score_distribution(views: Views) -> DataFrame:
    groups = (
        views.order_metrics.filter(m.score().isNotNull())
        .groupBy("delivery_status", "review_score")
        .agg(m.order_count())
    )
    return share_of_total(
        groups, "order_count", "pct_of_status_orders", within=("delivery_status",)
    ).orderBy(_late_first(), m.score().asc_nulls_last())


def value_by_status(views: Views) -> DataFrame:
    groups = views.order_metrics.groupBy("delivery_status").agg(
        m.order_count(), m.total_order_value(), m.avg_order_value()
    )
    return share_of_total(groups, "total_order_value", "pct_of_total_order_value").orderBy(
        *_highest("total_order_value", then="delivery_status")
    )


def estimated_vs_actual(views: Views) -> DataFrame:
    return (
        views.order_metrics.groupBy("delivery_status")
        .agg(
            m.order_count(),
            m.mean("estimated_delivery_days", "avg_estimated_delivery_days"),
            m.mean("actual_delivery_days", "avg_actual_delivery_days"),
            m.avg_delivery_delay_days(),
            F.max("delivery_delay_days").alias("max_delivery_delay_days"),
        )
        .orderBy(_late_first())
    )


def _ranked(view: DataFrame, min_orders: int) -> DataFrame:
    return view.filter(F.col("order_count") >= min_orders)


def worst_states(views: Views, min_orders: int = MIN_ORDERS) -> DataFrame:
    return (
        _ranked(views.state_performance, min_orders)
        .select(
            "customer_state",
            "order_count",
            "pct_late",
            "pct_on_time",
            "avg_delivery_days",
            "avg_delivery_delay_days",
            "avg_review_score",
            "total_order_value",
        )
        .orderBy(*_highest("pct_late", then="customer_state"))
    )


def best_states(views: Views, min_orders: int = MIN_ORDERS) -> DataFrame:
    return (
        _ranked(views.state_performance, min_orders)
        .select(
            "customer_state",
            "order_count",
            "pct_on_time",
            "pct_late",
            "avg_delivery_days",
            "avg_review_score",
        )
        .orderBy(*_highest("pct_on_time", then="customer_state"))
    )


def worst_categories(views: Views, min_orders: int = MIN_ORDERS) -> DataFrame:
    return (
        _ranked(views.category_performance, min_orders)
        .select(
            "product_category",
            "order_count",
            "pct_late",
            "pct_on_time",
            "avg_delivery_days",
            "avg_review_score",
            "total_order_value",
        )
        .orderBy(*_highest("pct_late", then="product_category"))
    )


def value_at_risk(views: Views, min_orders: int = MIN_ORDERS) -> DataFrame:
    """Late value estimated from the published, already rounded, late percentage."""
    at_risk = F.round(
        F.col("total_order_value").cast("decimal(24,2)") * F.col("pct_late").cast("decimal(5,2)") / 100, 2
    )
    return (
        _ranked(views.category_performance, min_orders)
        .select(
            "product_category",
            "order_count",
            "total_order_value",
            at_risk.alias("estimated_late_order_value"),
            "pct_late",
            "avg_review_score",
        )
        .orderBy(*_highest("estimated_late_order_value", then="product_category"))
    )


def _stage_bands(views: Views, days: str, bands: Bands, label: str) -> DataFrame:
    return (
        views.order_metrics.withColumn(label, band(F.col(days), bands))
        .groupBy(label)
        .agg(
            m.order_count(),
            m.mean(days, f"avg_{days}"),
            m.pct_late(),
            m.avg_review_score(),
            F.min(days).alias("_shortest"),
        )
        .orderBy(F.col("_shortest").asc_nulls_last())
        .drop("_shortest")
    )


def handling_bands(views: Views, bands: Bands = HANDLING_BANDS) -> DataFrame:
    return _stage_bands(views, "seller_handling_days", bands, "seller_handling_band")


def shipping_bands(views: Views, bands: Bands = SHIPPING_BANDS) -> DataFrame:
    return _stage_bands(views, "carrier_shipping_days", bands, "carrier_shipping_band")


def stage_contribution(views: Views) -> DataFrame:
    return (
        views.order_metrics.groupBy("delivery_status")
        .agg(
            m.order_count(),
            m.mean("seller_handling_days", "avg_seller_handling_days"),
            m.mean("carrier_shipping_days", "avg_carrier_shipping_days"),
            m.avg_delivery_delay_days(),
        )
        .orderBy(_late_first())
    )


def monthly_reliability(views: Views) -> DataFrame:
    return views.monthly_performance.orderBy(F.col("order_month").asc_nulls_last())


def yearly_reliability(views: Views) -> DataFrame:
    return (
        views.order_metrics.groupBy("order_year")
        .agg(
            m.order_count(),
            m.total_order_value(),
            m.avg_order_value(),
            m.avg_review_score(),
            m.pct_on_time(),
            m.pct_late(),
            m.avg_delivery_delay_days(),
        )
        .orderBy(F.col("order_year").asc_nulls_last())
    )


def delay_bands(views: Views, bands: Bands = DELAY_BANDS) -> DataFrame:
    groups = (
        views.order_metrics.withColumn("delay_band", band(F.col("delivery_delay_days"), bands))
        .groupBy("delay_band")
        .agg(m.order_count(), m.avg_review_score(), m.avg_order_value(), m.total_order_value())
    )
    return (
        share_of_total(groups, "order_count", "pct_of_orders")
        .select(
            "delay_band",
            "order_count",
            "pct_of_orders",
            "avg_review_score",
            "avg_order_value",
            "total_order_value",
        )
        .orderBy(position(F.col("delay_band"), bands.labels))
    )


def severe_delays(views: Views, severe_days: int = SEVERE_DAYS) -> DataFrame:
    """One row, also for no orders at all."""
    severe = F.col("delivery_delay_days") > severe_days
    return views.order_metrics.agg(
        F.count_if(severe).alias("severely_delayed_orders"),
        m.rows().alias("total_orders"),
        m.share_where(severe, m.rows()).alias("pct_severely_delayed_orders"),
        sum_where(m.value(), severe).alias("severely_delayed_order_value"),
        m.total_order_value(),
        pct(sum_where(m.value(), severe), F.sum(m.value())).alias("pct_order_value_severely_delayed"),
    )


def _value_groups(views: Views, groups: int, keep: Sequence[str]) -> DataFrame:
    return distributed_ntile(
        views.order_metrics.select(*dict.fromkeys(("order_id", "order_value", *keep))),
        groups,
        [SortKey("order_value"), SortKey("order_id")],
        alias="value_quartile",
        keep=keep,
    )


def order_value_groups(views: Views, groups: int = VALUE_GROUPS) -> DataFrame:
    """Each order's value group, 1 the lowest; orders without items have no value and come last."""
    return _value_groups(views, groups, keep=("order_id", "order_value"))


def value_quartiles(views: Views, groups: int = VALUE_GROUPS) -> DataFrame:
    return (
        _value_groups(views, groups, keep=("order_value", "delivery_status", "review_score"))
        .groupBy("value_quartile")
        .agg(m.order_count(), m.avg_order_value(), m.pct_late(), m.avg_review_score())
        .orderBy("value_quartile")
    )


def executive_summary(views: Views) -> DataFrame:
    """One row, also for no orders at all."""
    late_value = sum_where(m.value(), m.is_late())
    return views.order_metrics.agg(
        m.rows().alias("total_delivered_orders"),
        m.pct_late(),
        m.pct_on_time(),
        m.mean("review_score", "overall_avg_review_score"),
        average_where(F.col("delivery_delay_days"), m.is_late()).alias("avg_delay_among_late_orders"),
        m.total_order_value(),
        late_value.alias("late_order_value"),
        pct(late_value, F.sum(m.value())).alias("pct_order_value_late"),
    )


FINDINGS: dict[str, Callable[[Views], DataFrame]] = {
    "01_overall": overall_reliability,
    "02_satisfaction": satisfaction_by_status,
    "03_score_distribution": score_distribution,
    "04_late_value_share": value_by_status,
    "05_estimated_vs_actual": estimated_vs_actual,
    "06_worst_states": worst_states,
    "07_best_states": best_states,
    "08_categories": worst_categories,
    "09_value_at_risk": value_at_risk,
    "10_handling_bands": handling_bands,
    "11_shipping_bands": shipping_bands,
    "12_contribution": stage_contribution,
    "13_monthly": monthly_reliability,
    "14_yearly": yearly_reliability,
    "15_delay_bands": delay_bands,
    "16_severe": severe_delays,
    "17_value_quartiles": value_quartiles,
    "18_executive": executive_summary,
}
