"""Declared schemas of the nine raw tables, with the constraints a load must measure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    name: str
    type: T.DataType
    required: bool = False
    max_length: int | None = None


@dataclass(frozen=True)
class TableSpec:
    """``key`` is the declared primary key, empty where repeats are legitimate."""

    name: str
    csv_suffix: str
    key: tuple[str, ...]
    fields: tuple[Field, ...]

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields if f.required or f.name in self.key)

    @property
    def bounded(self) -> tuple[Field, ...]:
        return tuple(f for f in self.fields if f.max_length is not None)


def _text(name: str, max_length: int | None = None, required: bool = False) -> Field:
    return Field(name, T.StringType(), required, max_length)


def _integer(name: str, required: bool = False) -> Field:
    return Field(name, T.IntegerType(), required)


def _amount(name: str, required: bool = False) -> Field:
    return Field(name, T.DecimalType(12, 2), required)


def _timestamp(name: str) -> Field:
    return Field(name, T.TimestampNTZType())


# Table and column names, lengths, keys and file names of the raw data.
# ("lenght" is how the data spells it.)
CUSTOMERS = TableSpec(
    "customers",
    "customers_dataset.csv",
    ("customer_id",),
    (
        _text("customer_id", 50),
        _text("customer_unique_id", 50, required=True),
        _text("customer_zip_code_prefix", 5),
        _text("customer_city", 100),
        _text("customer_state", 2),
    ),
)
ORDERS = TableSpec(
    "orders",
    "orders_dataset.csv",
    ("order_id",),
    (
        _text("order_id", 50),
        _text("customer_id", 50, required=True),
        _text("order_status", 30, required=True),
        _timestamp("order_purchase_timestamp"),
        _timestamp("order_approved_at"),
        _timestamp("order_delivered_carrier_date"),
        _timestamp("order_delivered_customer_date"),
        _timestamp("order_estimated_delivery_date"),
    ),
)
ORDER_ITEMS = TableSpec(
    "order_items",
    "order_items_dataset.csv",
    ("order_id", "order_item_id"),
    (
        _text("order_id", 50),
        _integer("order_item_id"),
        _text("product_id", 50, required=True),
        _text("seller_id", 50, required=True),
        _timestamp("shipping_limit_date"),
        _amount("price", required=True),
        _amount("freight_value", required=True),
    ),
)
ORDER_PAYMENTS = TableSpec(
    "order_payments",
    "order_payments_dataset.csv",
    ("order_id", "payment_sequential"),
    (
        _text("order_id", 50),
        _integer("payment_sequential"),
        _text("payment_type", 30),
        _integer("payment_installments"),
        _amount("payment_value"),
    ),
)
ORDER_REVIEWS = TableSpec(
    "order_reviews",
    "order_reviews_dataset.csv",
    (),
    (
        _text("review_id", 50),
        _text("order_id", 50, required=True),
        Field("review_score", T.ShortType()),
        _text("review_comment_title"),
        _text("review_comment_message"),
        _timestamp("review_creation_date"),
        _timestamp("review_answer_timestamp"),
    ),
)
PRODUCTS = TableSpec(
    "products",
    "products_dataset.csv",
    ("product_id",),
    (
        _text("product_id", 50),
        _text("product_category_name", 100),
        _integer("product_name_lenght"),
        _integer("product_description_lenght"),
        _integer("product_photos_qty"),
        _amount("product_weight_g"),
        _amount("product_length_cm"),
        _amount("product_height_cm"),
        _amount("product_width_cm"),
    ),
)
SELLERS = TableSpec(
    "sellers",
    "sellers_dataset.csv",
    ("seller_id",),
    (
        _text("seller_id", 50),
        _text("seller_zip_code_prefix", 5),
        _text("seller_city", 100),
        _text("seller_state", 2),
    ),
)
PRODUCT_CATEGORY_TRANSLATION = TableSpec(
    "product_category_translation",
    "product_category_name_translation.csv",
    ("product_category_name",),
    (
        _text("product_category_name", 100),
        _text("product_category_name_english", 100),
    ),
)
GEOLOCATION = TableSpec(
    "geolocation",
    "geolocation_dataset.csv",
    (),
    (
        _text("geolocation_zip_code_prefix", 5),
        Field("geolocation_lat", T.DoubleType()),
        Field("geolocation_lng", T.DoubleType()),
        _text("geolocation_city", 100),
        _text("geolocation_state", 2),
    ),
)
VALID_SCORES = (1, 5)

TABLE_SPECS: dict[str, TableSpec] = {
    spec.name: spec
    for spec in (
        CUSTOMERS,
        GEOLOCATION,
        ORDER_ITEMS,
        ORDER_PAYMENTS,
        ORDER_REVIEWS,
        ORDERS,
        PRODUCT_CATEGORY_TRANSLATION,
        PRODUCTS,
        SELLERS,
    )
}


def struct_type(name: str) -> T.StructType:
    """Spark schema of a raw table. All fields are nullable: NOT NULL is measured, not assumed."""
    return T.StructType([T.StructField(f.name, f.type, True) for f in TABLE_SPECS[name].fields])
