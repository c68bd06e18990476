"""The order-level fact: one row per delivered order with a delivery time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import (
    calendar_year,
    cents,
    days_between,
    delivery_status,
    from_cents,
    month_start,
    satisfaction_bucket,
    sum_cents,
)
from parcelwise.functions.labels import DELIVERED
from parcelwise.operators import latest_per_key
from parcelwise.sources.tables import Tables


def order_value(order_items: DataFrame) -> DataFrame:
    """Item count and value per order, summed before any join so that joins cannot fan out."""
    price, freight = cents(F.col("price")), cents(F.col("freight_value"))
    bound = F.abs(F.coalesce(price, F.lit(0))) + F.abs(F.coalesce(freight, F.lit(0)))
    return order_items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        from_cents(sum_cents(price, bound)).alias("item_value"),
        from_cents(sum_cents(freight, bound)).alias("freight_value"),
        from_cents(sum_cents(price + freight, bound)).alias("order_value"),
    )


def latest_review(order_reviews: DataFrame) -> DataFrame:
    """Score of each order's most recently answered review, which may be NULL."""
    return latest_per_key(
        order_reviews,
        key="order_id",
        ts="review_answer_timestamp",
        values=("review_score",),
        tie_breakers=("review_id",),
    )


def delivered_orders(orders: DataFrame) -> DataFrame:
    """Orders whose actual delivery can be measured; both tests reach the Parquet scan."""
    return orders.filter(
        (F.col("order_status") == DELIVERED) & F.col("order_delivered_customer_date").isNotNull()
    )


def orders_with_customers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with their customer's state and city; orders without a customer drop out."""
    return orders.join(
        customers.select("customer_id", "customer_state", "customer_city"), "customer_id", "inner"
    )


def order_metrics(tables: Tables) -> DataFrame:
    """Delivery times, delay, value and satisfaction per delivered order.

    The customer join comes first: both of its inputs are plain shuffles, which adaptive
    execution splits when one customer holds many orders. What follows is keyed by order
    and shares one partitioning, which the result keeps for later joins on the order.
    """
    purchased = F.col("order_purchase_timestamp")
    approved = F.col("order_approved_at")
    shipped = F.col("order_delivered_carrier_date")
    delivered = F.col("order_delivered_customer_date")
    estimated = F.col("order_estimated_delivery_date")
    return (
        orders_with_customers(delivered_orders(tables.orders), tables.customers)
        .join(order_value(tables.order_items), "order_id", "left")
        .join(latest_review(tables.order_reviews), "order_id", "left")
        .select(
            "order_id",
            "customer_id",
            "customer_state",
            "customer_city",
            "order_status",
            purchased,
            approved,
            shipped,
            delivered,
            estimated,
            days_between(delivered, purchased).alias("actual_delivery_days"),
            days_between(estimated, purchased).alias("estimated_delivery_days"),
            days_between(delivered, estimated).alias("delivery_delay_days"),
            delivery_status(delivered, estimated).alias("delivery_status"),
            days_between(shipped, approved).alias("seller_handling_days"),
            days_between(delivered, shipped).alias("carrier_shipping_days"),
            "item_count",
            "item_value",
            "freight_value",
            "order_value",
            "review_score",
            satisfaction_bucket(F.col("review_score")).alias("satisfaction_bucket"),
            month_start(purchased).alias("order_month"),
            calendar_year(purchased).alias("order_year"),
        )
    )
