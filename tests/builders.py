"""Small literal tables: rows are dicts, columns left out are NULL."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame

from parcelwise.sources import TABLE_SPECS, Tables, struct_type

PURCHASE = datetime(2018, 3, 1, 12, 0)


def day(n: float) -> datetime:
    return PURCHASE + timedelta(days=n)


def frame(spark, name: str, rows: list[dict]) -> DataFrame:
    schema = struct_type(name)
    unknown = {key for row in rows for key in row} - set(schema.names)
    assert not unknown, unknown
    return spark.createDataFrame([tuple(row.get(c) for c in schema.names) for row in rows], schema)


def tables(spark, **rows: list[dict]) -> Tables:
    return Tables(**{name: frame(spark, name, rows.get(name, [])) for name in TABLE_SPECS})


def customer(customer_id: str, state: str = "SP") -> dict:
    return {
        "customer_id": customer_id,
        "customer_unique_id": f"person-{customer_id}",
        "customer_state": state,
        "customer_city": "city",
    }


def order(order_id: str, delivered: float | None = 5, due: float | None = 10, **more) -> dict:
    """A delivered order of customer c1, with times in days after its purchase."""
    return {
        "order_id": order_id,
        "customer_id": "c1",
        "order_status": "delivered",
        "order_purchase_timestamp": PURCHASE,
        "order_approved_at": PURCHASE,
        "order_delivered_carrier_date": day(1),
        "order_delivered_customer_date": None if delivered is None else day(delivered),
        "order_estimated_delivery_date": None if due is None else day(due),
        **more,
    }


def item(order_id: str, price: str | None = "10.00", freight: str | None = "1.00", n: int = 1, **more) -> dict:
    return {
        "order_id": order_id,
        "order_item_id": n,
        "product_id": "p1",
        "seller_id": "s1",
        "price": price and Decimal(price),
        "freight_value": freight and Decimal(freight),
        **more,
    }


def review(order_id: str, score: int | None, answered: float | None = 20, review_id: str = "r1") -> dict:
    return {
        "review_id": review_id,
        "order_id": order_id,
        "review_score": score,
        "review_answer_timestamp": None if answered is None else day(answered),
    }


def product(product_id: str, category: str | None = None) -> dict:
    return {"product_id": product_id, "product_category_name": category}


def translation(name: str, english: str | None) -> dict:
    return {"product_category_name": name, "product_category_name_english": english}


def by(df: DataFrame, key: str) -> dict:
    rows = df.collect()
    found = {row[key]: row for row in rows}
    assert len(found) == len(rows), f"{key} is not unique"
    return found
