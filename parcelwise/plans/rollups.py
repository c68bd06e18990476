"""Rollups of the order-level fact by status, month, state and product category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import category_name, cents, from_cents, sum_cents
from parcelwise.operators import share_of_total
from parcelwise.plans import measures as m
from parcelwise.sources.tables import Tables


def reliability_summary(fact: DataFrame) -> DataFrame:
    """One row per delivery status; review percentages are of reviewed orders."""
    reviewed = F.count("review_score")
    groups = fact.groupBy("delivery_status").agg(
        m.order_count(),
        m.avg_review_score(),
        m.pct_negative_reviews(reviewed),
        m.pct_positive_reviews(reviewed),
        m.avg_order_value(),
        m.total_order_value(),
        m.avg_delivery_delay_days(),
        m.avg_delivery_days(),
    )
    return share_of_total(groups, "order_count", "pct_of_orders").select(
        "delivery_status",
        "order_count",
        "pct_of_orders",
        "avg_review_score",
        "pct_negative_reviews",
        "pct_positive_reviews",
        "avg_order_value",
        "total_order_value",
        "avg_delivery_delay_days",
        "avg_delivery_days",
    )


def _by(fact: DataFrame, key: str) -> DataFrame:
    return fact.groupBy(key).agg(
        m.order_count(),
        m.total_order_value(),
        m.avg_order_value(),
        m.avg_review_score(),
        m.pct_on_time(),
        m.pct_late(),
        m.avg_delivery_days(),
        m.avg_delivery_delay_days(),
    )


def monthly_performance(fact: DataFrame) -> DataFrame:
    return _by(fact, "order_month")


def state_performance(fact: DataFrame) -> DataFrame:
    return _by(fact, "customer_state")


def item_categories(order_items: DataFrame, products: DataFrame, translation: DataFrame) -> DataFrame:
    """Order items with the name of their product's category.

    Neither join is hinted: both dimensions grow with the catalogue, so Spark broadcasts
    them only when their measured size allows, and otherwise splits hot products itself.
    """
    return (
        order_items.join(
            products.join(translation, "product_category_name", "left").select(
                "product_id",
                category_name(
                    F.col("product_category_name_english"), F.col("product_category_name")
                ).alias("known_category"),
            ),
            "product_id",
            "left",
        )
        .withColumn("product_category", category_name(F.lit(None), F.col("known_category")))
        .drop("known_category")
    )


def category_orders(tables: Tables, fact: DataFrame) -> DataFrame:
    """One row per order and category, so an order's review counts once per category.

    Item values are summed before the fact is joined, which keeps a hot product or a huge
    order from meeting the join row by row.
    """
    items = item_categories(
        tables.order_items.select("order_id", "product_id", "price", "freight_value"),
        tables.products,
        tables.product_category_translation,
    )
    values = items.groupBy("order_id", "product_category").agg(
        from_cents(sum_cents(cents(F.col("price")) + cents(F.col("freight_value")))).alias("order_value")
    )
    return values.join(
        fact.select("order_id", "review_score", "actual_delivery_days", "delivery_status"),
        "order_id",
        "inner",
    )


def category_performance(tables: Tables, fact: DataFrame) -> DataFrame:
    return (
        category_orders(tables, fact)
        .groupBy("product_category")
        .agg(
            m.order_count(),
            m.total_order_value(),
            m.mean("order_value", "avg_category_order_value"),
            m.avg_review_score(),
            m.avg_delivery_days(),
            m.pct_on_time(),
            m.pct_late(),
        )
    )
