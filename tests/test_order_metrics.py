from datetime import date
from decimal import Decimal

import pytest
from builders import PURCHASE, by, customer, day, item, order, review, tables
from pyspark.sql import functions as F

from parcelwise.operators import latest_per_key
from parcelwise.plans.order_metrics import latest_review, order_metrics, order_value


def fact(spark, **rows):
    return by(order_metrics(tables(spark, customers=[customer("c1")], **rows)), "order_id")


def test_one_order_in_full(spark):
    row = fact(
        spark,
        orders=[order("o1", delivered=5.5, due=4, order_approved_at=day(0.25))],
        order_items=[item("o1", "10.00", "1.50"), item("o1", "20.00", "2.25", n=2)],
        order_reviews=[review("o1", 2)],
    )["o1"]
    assert row.asDict() == {
        "order_id": "o1",
        "customer_id": "c1",
        "customer_state": "SP",
        "customer_city": "city",
        "order_status": "delivered",
        "order_purchase_timestamp": PURCHASE,
        "order_approved_at": day(0.25),
        "order_delivered_carrier_date": day(1),
        "order_delivered_customer_date": day(5.5),
        "order_estimated_delivery_date": day(4),
        "actual_delivery_days": Decimal("5.50"),
        "estimated_delivery_days": Decimal("4.00"),
        "delivery_delay_days": Decimal("1.50"),
        "delivery_status": "Late",
        "seller_handling_days": Decimal("0.75"),
        "carrier_shipping_days": Decimal("4.50"),
        "item_count": 2,
        "item_value": Decimal("30.00"),
        "freight_value": Decimal("3.75"),
        "order_value": Decimal("33.75"),
        "review_score": 2,
        "satisfaction_bucket": "Dissatisfied",
        "order_month": date(2018, 3, 1),
        "order_year": 2018,
    }


def test_only_delivered_orders_with_a_date_and_a_customer(spark):
    rows = fact(
        spark,
        orders=[
            order("kept"),
            order("undated", delivered=None),
            order("shipped", order_status="shipped"),
            order("orphan", customer_id="nobody"),
        ],
    )
    assert set(rows) == {"kept"}


def test_delay_that_rounds_to_zero_is_still_late(spark):
    row = fact(spark, orders=[order("o1", delivered=10 + 5 / 1440, due=10)])["o1"]
    assert (row.delivery_status, row.delivery_delay_days) == ("Late", Decimal("0.00"))


def test_missing_times(spark):
    rows = fact(
        spark,
        orders=[
            order("no_due", due=None),
            order("no_approval", order_approved_at=None),
            order("no_carrier", order_delivered_carrier_date=None),
            order("early_carrier", order_approved_at=day(2)),
        ],
    )
    assert (rows["no_due"].delivery_status, rows["no_due"].delivery_delay_days) == ("Late", None)
    assert rows["no_due"].estimated_delivery_days is None
    assert rows["no_approval"].seller_handling_days is None
    assert rows["no_carrier"].seller_handling_days is None
    assert rows["no_carrier"].carrier_shipping_days is None
    assert rows["early_carrier"].seller_handling_days == Decimal("-1.00")


def test_order_without_items_or_review(spark):
    row = fact(spark, orders=[order("o1")])["o1"]
    assert (row.item_count, row.item_value, row.freight_value, row.order_value) == (None,) * 4
    assert (row.review_score, row.satisfaction_bucket) == (None, None)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_a_sum_beyond_bigint_is_refused(spark, conf, ansi):
    def items(n):
        return spark.range(n).selectExpr(
            "'o' AS order_id", "CAST(9999999999.99 AS decimal(12,2)) AS price", "CAST(0 AS decimal(12,2)) AS freight_value"
        )

    conf("spark.sql.ansi.enabled", ansi)
    assert order_value(items(9_000_000)).first().order_value == Decimal("89999999999910000.00")
    with pytest.raises(Exception, match="exceeds 92 quadrillion|(?i:overflow)"):
        order_value(items(10_000_000)).collect()


def test_order_value_skips_items_with_a_missing_part(spark):
    t = tables(spark, order_items=[item("o1"), item("o1", freight=None, n=2), item("o2", price=None)])
    rows = by(order_value(t.order_items), "order_id")
    assert rows["o1"].asDict() == {
        "order_id": "o1",
        "item_count": 2,
        "item_value": Decimal("20.00"),
        "freight_value": Decimal("1.00"),
        "order_value": Decimal("11.00"),
    }
    assert (rows["o2"].item_value, rows["o2"].freight_value, rows["o2"].order_value) == (None, Decimal("1.00"), None)


@pytest.mark.parametrize(
    ("reviews", "score"),
    [
        ([review("o", 5, 1), review("o", 1, 2)], 1),
        ([review("o", 5, None), review("o", 1, 2)], 1),
        ([review("o", 4, 1), review("o", None, 2)], None),
        ([review("o", 4, None, "b"), review("o", 2, None, "a")], 2),
        ([review("o", 4, 3, "b"), review("o", 2, 3, "a"), review("o", 1, 1, "0")], 2),
        ([review("o", 4, 3, "a"), review("o", 2, 3, "a")], 2),
        ([review("o", None, None)], None),
    ],
)
def test_latest_review(spark, reviews, score):
    for rows in (reviews, reviews[::-1]):
        got = latest_review(tables(spark, order_reviews=rows).order_reviews).collect()
        assert [(r.order_id, r.review_score) for r in got] == [("o", score)]


def test_latest_review_equals_row_number(spark, sample):
    reviews = sample.order_reviews
    ranked = reviews.selectExpr(
        "order_id",
        "review_score",
        "row_number() over (partition by order_id order by review_answer_timestamp desc nulls last, review_id) as n",
    )
    plain = ranked.filter("n = 1").drop("n")
    ours = latest_review(reviews)
    assert ours.exceptAll(plain).isEmpty() and plain.exceptAll(ours).isEmpty()


def test_latest_per_key_keeps_several_values_together(spark):
    df = spark.sql(
        "select * from values ('k', timestamp_ntz'2020-01-01', 'old', 1), ('k', timestamp_ntz'2020-01-02', null, 2) as t(k, ts, a, b)"
    )
    assert [tuple(r) for r in latest_per_key(df, "k", "ts", ("a", "b")).collect()] == [("k", None, 2)]


def test_fact_has_one_row_per_order(sample_fact):
    assert sample_fact.count() == 975
    assert sample_fact.select("order_id").distinct().count() == 975
    assert sample_fact.filter(F.col("order_value").isNull()).count() == 20
