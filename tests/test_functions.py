from datetime import date, datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelwise.functions import (
    Bands,
    average,
    band,
    calendar_year,
    category_name,
    cents,
    days_between,
    delivery_status,
    from_cents,
    month_start,
    pct,
    position,
    round_ratio,
    satisfaction_bucket,
    sum_where,
)
from parcelwise.plans.findings import DELAY_BANDS, HANDLING_BANDS, SHIPPING_BANDS


def one(df, column):
    return df.select(column.alias("x")).first().x


def exact(n: Decimal, d: Decimal) -> Decimal | None:
    if not d:
        return None
    hundredths = Decimal(int(n * 100)) * 100 / Decimal(int(d * 100))
    # Integers decide halves; the quotient above may be inexact.
    a, b = 200 * abs(int(n * 100)) + abs(int(d * 100)), 2 * abs(int(d * 100))
    sign = -1 if hundredths < 0 else 1
    return Decimal(sign * (a // b)) / 100


amounts = st.decimals(min_value=Decimal(-(10**14)), max_value=Decimal(10**14), places=2)
counts = st.integers(min_value=-(10**6), max_value=10**13)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(amounts, counts), min_size=20, max_size=60))
def test_round_ratio_is_exact(spark, pairs):
    df = spark.createDataFrame(pairs, "n decimal(20,2), d bigint")
    got = df.select("n", "d", round_ratio(F.col("n"), F.col("d")).alias("q")).collect()
    assert [row.q for row in got] == [exact(row.n, Decimal(row.d)) for row in got]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(amounts, amounts), min_size=20, max_size=60))
def test_share_of_sums_is_exact(spark, pairs):
    df = spark.createDataFrame([(a, b) for a, b in pairs if abs(b) > 1], "n decimal(20,2), d decimal(20,2)")
    got = df.select("n", "d", pct(F.col("n"), F.col("d")).alias("q")).collect()
    assert [row.q for row in got] == [exact(100 * row.n, row.d) for row in got]


@pytest.mark.parametrize(
    ("n", "d", "expected"),
    [("0.01", 2, "0.01"), ("-0.01", 2, "-0.01"), ("-2.675", 1, "-2.68"), ("1", 3, "0.33"), ("2", 3, "0.67"), ("0", 5, "0.00")],
)
def test_halves_round_away_from_zero(spark, n, d, expected):
    n = Decimal(n).quantize(Decimal("0.01"), ROUND_HALF_UP)
    assert one(spark.range(1), round_ratio(F.lit(n), F.lit(d))) == Decimal(expected)


def test_ratio_without_denominator_is_null(spark):
    df = spark.range(1)
    assert one(df, round_ratio(F.lit(1), F.lit(0))) is None
    assert one(df, round_ratio(F.lit(1), F.lit(None).cast("bigint"))) is None
    assert one(df, round_ratio(F.lit(None).cast("bigint"), F.lit(1))) is None


def test_average_near_half_a_cent_is_not_rounded_twice(spark):
    df = spark.range(20_001).select(F.when(F.col("id") == 0, 100).otherwise(0).cast("decimal(12,2)").alias("v"))
    assert df.agg(average(F.col("v")).alias("x")).first().x == Decimal("0.00")


def test_average_skips_nulls_and_sums_of_nothing_are_null(spark):
    df = spark.createDataFrame([(3, "a"), (None, "a"), (4, "b")], "v smallint, k string")
    row = df.agg(
        average(F.col("v")).alias("mean"),
        sum_where(F.col("v"), F.col("k") == "a").alias("a"),
        sum_where(F.col("v"), F.col("k") == "z").alias("z"),
    ).first()
    assert (row["mean"], row.a, row.z) == (Decimal("3.50"), 3, None)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.decimals(Decimal("-9999999999.99"), Decimal("9999999999.99"), places=2), min_size=50, max_size=200))
def test_cents_are_exact_over_the_whole_amount_range(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v decimal(12,2)")
    rows = df.select("v", cents(F.col("v")).alias("c"), from_cents(cents(F.col("v"))).alias("back")).collect()
    assert all(row.c == int(row.v * 100) and row.back == row.v for row in rows)


def ts(df, end, start):
    return days_between(F.lit(end).cast("timestamp_ntz"), F.lit(start).cast("timestamp_ntz"))


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "America/New_York", "Asia/Kathmandu"])
def test_time_expressions_ignore_the_session_zone(spark, conf, zone):
    conf("spark.sql.session.timeZone", zone)
    # 02:30 on 14 March 2021 does not exist in New York, nor 00:30 on 4 November 2018 in São Paulo.
    df = spark.createDataFrame(
        [
            (datetime(2021, 3, 14, 2, 30), datetime(2021, 3, 13, 2, 30)),
            (datetime(2018, 11, 4, 0, 30), datetime(2018, 11, 1, 0, 30)),
        ],
        "a timestamp_ntz, b timestamp_ntz",
    )
    rows = df.select(
        days_between(F.col("a"), F.col("b")).alias("d"),
        month_start(F.col("a")).alias("m"),
        calendar_year(F.col("a")).alias("y"),
    ).collect()
    assert [tuple(r) for r in rows] == [
        (Decimal("1.00"), date(2021, 3, 1), 2021),
        (Decimal("3.00"), date(2018, 11, 1), 2018),
    ]


@pytest.mark.parametrize(
    ("end", "expected"),
    [
        ("2020-01-01 00:07:12", "0.01"),  # 432 s is exactly half a hundredth of a day
        ("2020-01-01 00:07:11.999999", "0.00"),
        ("2019-12-31 23:52:48", "-0.01"),
        ("2020-01-03 12:00:00", "2.50"),
        ("9999-12-31 00:00:00", "2914634.00"),
    ],
)
def test_days_round_half_away(spark, end, expected):
    assert one(spark.range(1), ts(None, end, "2020-01-01 00:00:00")) == Decimal(expected)


def test_days_with_a_missing_end_are_null(spark):
    assert one(spark.range(1), ts(None, None, "2020-01-01 00:00:00")) is None


@pytest.mark.parametrize(
    ("bands", "value", "label"),
    [
        (HANDLING_BANDS, "-3", "Under 2 days"),
        (HANDLING_BANDS, "1.99", "Under 2 days"),
        (HANDLING_BANDS, "2", "2-3 days"),
        (HANDLING_BANDS, "4", "4-6 days"),
        (HANDLING_BANDS, "7", "7+ days"),
        (HANDLING_BANDS, None, "7+ days"),
        (SHIPPING_BANDS, "2", "2-4 days"),
        (SHIPPING_BANDS, "5", "5-7 days"),
        (SHIPPING_BANDS, "8", "8+ days"),
        (SHIPPING_BANDS, None, "8+ days"),
        (DELAY_BANDS, "0", "On Time"),
        (DELAY_BANDS, "0.01", "1-2 days late"),
        (DELAY_BANDS, "2", "1-2 days late"),
        (DELAY_BANDS, "7", "3-7 days late"),
        (DELAY_BANDS, "14", "8-14 days late"),
        (DELAY_BANDS, "14.01", "15+ days late"),
        (DELAY_BANDS, None, "15+ days late"),
    ],
)
def test_bands(spark, bands, value, label):
    assert one(spark.range(1), band(F.lit(value).cast("decimal(12,2)"), bands)) == label


def test_bands_must_be_consistent():
    with pytest.raises(ValueError, match="label"):
        Bands((1, 2), ("a", "b"))
    with pytest.raises(ValueError, match="increase"):
        Bands((2, 1), ("a", "b", "c"))


def test_position_puts_unlisted_last(spark):
    df = spark.createDataFrame([("Late",), ("On Time",), ("other",), (None,)], "s string")
    got = [r.p for r in df.select(position(F.col("s"), ("Late", "On Time")).alias("p")).collect()]
    assert got == [1, 2, 3, 3]


def test_labels(spark):
    df = spark.createDataFrame(
        [
            (datetime(2020, 1, 1), datetime(2020, 1, 1), 5),
            (datetime(2020, 1, 1, 0, 0, 1), datetime(2020, 1, 1), 3),
            (datetime(2020, 1, 1), None, 2),
            (datetime(2020, 1, 1), datetime(2020, 1, 2), None),
        ],
        "delivered timestamp_ntz, due timestamp_ntz, score smallint",
    )
    rows = df.select(
        delivery_status(F.col("delivered"), F.col("due")).alias("s"), satisfaction_bucket(F.col("score")).alias("b")
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("On Time", "Satisfied"),
        ("Late", "Neutral"),
        ("Late", "Dissatisfied"),
        ("On Time", None),
    ]
    names = spark.createDataFrame([("toys", "brinquedos"), (None, "pcs"), (None, None)], "t string, o string")
    got = [r.n for r in names.select(category_name(F.col("t"), F.col("o")).alias("n")).collect()]
    assert got == ["toys", "pcs", "unknown"]
