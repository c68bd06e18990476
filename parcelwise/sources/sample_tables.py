"""The nine raw tables derived from a folder of order, line item, part, … Parquet files.

The sample files know no delivery times or reviews, so those are computed from the keys by
integer arithmetic. Every row of every file is used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.sources.schema import struct_type
from parcelwise.sources.tables import Tables


# Columns used, per file: declaring them spares a footer read per file and query.
_FILES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int",
    "events": "event_id bigint, ts timestamp_ntz, event_type string, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_extendedprice double, l_tax double, l_shipdate timestamp_ntz",
    "nation": "n_nationkey int, n_name string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_brand string, p_size int",
    "supplier": "s_suppkey bigint, s_nationkey int",
}


def _shift(unit: str, amount: str) -> str:
    return f"INTERVAL 1 {unit} * cast({amount} as int)"


def _on(left: str, right: str) -> Column:
    return F.col(left) == F.col(right)


def _conform(name: str, df: DataFrame) -> DataFrame:
    """Declared columns in declared order and type; columns the sample lacks are NULL."""
    present = set(df.columns)
    return df.selectExpr(
        *(
            f"cast({f.name if f.name in present else 'NULL'} as {f.dataType.simpleString()}) as {f.name}"
            for f in struct_type(name)
        )
    )


Read = Callable[[str], DataFrame]


def _customers(read: Read) -> DataFrame:
    return read("customer").join(read("nation"), _on("c_nationkey", "n_nationkey")).selectExpr(
        "c_custkey as customer_id",
        "c_name as customer_unique_id",
        "lpad(cast(c_nationkey as string), 5, '0') as customer_zip_code_prefix",
        "n_name as customer_city",
        "lpad(cast(c_nationkey as string), 2, '0') as customer_state",
    )


def _sellers(read: Read) -> DataFrame:
    return read("supplier").join(read("nation"), _on("s_nationkey", "n_nationkey")).selectExpr(
        "s_suppkey as seller_id",
        "lpad(cast(s_nationkey as string), 5, '0') as seller_zip_code_prefix",
        "n_name as seller_city",
        "lpad(cast(s_nationkey as string), 2, '0') as seller_state",
    )


def _orders(read: Read) -> DataFrame:
    return (
        read("orders")
        .selectExpr(
            "o_orderkey as k",
            "o_orderkey as order_id",
            "o_custkey as customer_id",
            "if(o_orderstatus = 'O', 'shipped', 'delivered') as order_status",
            f"o_orderdate + {_shift('SECOND', '(o_orderkey * 7919) % 86400')} as order_purchase_timestamp",
            "if(o_orderkey % 499 = 0, NULL, o_orderdate + "
            + _shift("DAY", "4 + 4 * cast(substr(o_orderpriority, 1, 1) as int)")
            + ") as order_estimated_delivery_date",
        )
        .selectExpr(
            "*",
            f"if(k % 97 = 0, NULL, order_purchase_timestamp + {_shift('HOUR', 'k % 48')}) as order_approved_at",
        )
        .selectExpr(
            "*",
            "if(k % 89 = 0, NULL, coalesce(order_approved_at, order_purchase_timestamp) + "
            + _shift("HOUR", "(k * 31) % 220 - 3")
            + ") as order_delivered_carrier_date",
        )
        .selectExpr(
            "*",
            "case when order_status = 'shipped' or k % 101 = 0 then NULL "
            "when k % 313 = 0 then order_purchase_timestamp - INTERVAL 1 DAY "
            "else coalesce(order_delivered_carrier_date, order_purchase_timestamp) + "
            + _shift("HOUR", "(k * 37) % 290")
            + " end as order_delivered_customer_date",
        )
    )


def _order_items(read: Read) -> DataFrame:
    return (
        read("lineitem")
        .selectExpr("*", "cast(l_extendedprice as decimal(12,2)) as price")
        .selectExpr(
            "l_orderkey as order_id",
            "l_linenumber as order_item_id",
            "l_partkey as product_id",
            "l_suppkey as seller_id",
            "l_shipdate as shipping_limit_date",
            "price",
            "price * cast(l_tax as decimal(4,2)) as freight_value",
        )
    )


def _order_payments(read: Read) -> DataFrame:
    return read("orders").selectExpr(
        "if(o_orderkey % 401 = 0, -1, o_orderkey) as order_id",
        "1 as payment_sequential",
        "lower(substr(o_orderpriority, 3)) as payment_type",
        "o_orderkey % 10 + 1 as payment_installments",
        "o_totalprice as payment_value",
    )


def _order_reviews(read: Read) -> DataFrame:
    return read("events").selectExpr(
        "event_id as review_id",
        "case when event_id % 211 = 0 then -1 when event_id % 5 = 0 then event_id + 1 else event_id end as order_id",
        "case when event_id % 17 = 0 then NULL else case event_type when 'purchase' then 5 when 'signup' then 4 "
        "when 'click' then 3 when 'view' then 2 when 'error' then 1 end end as review_score",
        "props as review_comment_message",
        "ts as review_creation_date",
        "if(event_id % 7 = 0, NULL, ts) as review_answer_timestamp",
    )


def _products(read: Read) -> DataFrame:
    return read("part").selectExpr(
        "p_partkey as product_id",
        "if(p_partkey % 53 = 0, NULL, p_brand) as product_category_name",
        "p_size as product_weight_g",
    )


def _translation(read: Read) -> DataFrame:
    return (
        read("part")
        .filter("p_brand <> 'Brand#25'")
        .selectExpr(
            "p_brand as product_category_name",
            "replace(p_brand, 'Brand#', 'brand_') as product_category_name_english",
        )
        .distinct()
    )


def _geolocation(read: Read) -> DataFrame:
    return read("customer").selectExpr(
        "lpad(cast(c_nationkey as string), 5, '0') as geolocation_zip_code_prefix",
        "c_nationkey * 1.5 - 20 as geolocation_lat",
    )


_BUILDERS = {
    "customers": _customers,
    "geolocation": _geolocation,
    "order_items": _order_items,
    "order_payments": _order_payments,
    "order_reviews": _order_reviews,
    "orders": _orders,
    "product_category_translation": _translation,
    "products": _products,
    "sellers": _sellers,
}


def sample_tables(spark: SparkSession, folder: str) -> Tables:
    def read(name: str) -> DataFrame:
        return spark.read.schema(_FILES[name]).parquet(f"{folder}/{name}.parquet")

    return Tables(
        **{name: lambda name=name, build=build: _conform(name, build(read)) for name, build in _BUILDERS.items()}
    )
