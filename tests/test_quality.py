from decimal import Decimal

import pytest
from builders import by, customer, day, frame, item, order, product, review, tables, translation
from pyspark.sql import functions as F

from parcelwise.operators import KeySide, duplicate_keys, key_profile, orphan_rows, unmatched_keys
from parcelwise.plans import quality as q
from parcelwise.sources import TABLE_SPECS


@pytest.fixture(scope="module")
def broken(spark):
    """Every check fails, each with a count of its own."""
    return tables(
        spark,
        customers=[customer("c1"), customer("c1"), customer("c1")],
        orders=[
            order("o1"),
            order("o2", customer_id="gone"),
            order("o3", customer_id=None, order_purchase_timestamp=None),
            order("o4", delivered=None),
            order("o5", delivered=-1),
            order("o6", delivered=0.5),
            order("o7"),
            order("o7"),
            order("o8", delivered=None, order_status="shipped"),
        ],
        order_items=[
            item("o1"),
            item("o1"),
            item("gone", seller_id="gone"),
            item(None, product_id="gone", seller_id="gone"),
            item("o1", price=None, n=2, seller_id=None),
            item("o1", freight=None, n=3),
            item("o1", price="-1.00", n=4, product_id="gone"),
            item("o1", freight="-1.00", n=5, product_id="gone"),
        ],
        order_payments=[
            {"order_id": "o1", "payment_sequential": 1},
            {"order_id": "gone", "payment_sequential": 1},
            {"order_id": "gone", "payment_sequential": 1},
        ],
        order_reviews=[
            review("o1", 0),
            review("o1", 6),
            review("o1", None),
            review("o2", 5),
            review("o2", 5),
            review("gone", 5),
        ],
        products=[
            product("p1", "x"),
            product("p2", "new"),
            product("p3", "new"),
            product("p3", "new"),
            product("p4", "newer"),
            product("p5"),
        ],
        sellers=[{"seller_id": "s1"}, {"seller_id": "s1"}, {"seller_id": "s2"}, {"seller_id": "s2"}],
        product_category_translation=[translation("x", "Ex"), translation("x", "Ex")],
    )


EXPECTED = {
    "Duplicate customer IDs": 1,
    "Duplicate order IDs": 1,
    "Duplicate product IDs": 1,
    "Duplicate seller IDs": 2,
    "Orders without matching customers": 2,
    "Order items without matching orders": 2,
    "Order items without matching products": 3,
    "Order items without matching sellers": 3,
    "Payments without matching orders": 2,
    "Reviews without matching orders": 1,
    "Products without category translation": 2,
    "Orders missing purchase timestamp": 1,
    "Delivered orders missing customer delivery date": 1,
    "Order items missing price or freight": 2,
    "Order items with negative price/freight": 2,
    "Invalid review scores": 2,
    "Orders delivered before purchase": 1,
    "Orders with carrier date after customer delivery": 2,
    "Orders with multiple review records": 2,
}


def test_every_check_counts_its_issues(broken):
    rows = by(q.run_checks(broken), "check_name")
    assert {name: row.issue_count for name, row in rows.items()} == EXPECTED
    assert {row.status for row in rows.values()} == {"FAIL"}


@pytest.mark.parametrize("name", [*q.CHECKS, *q.KEY_CONSTRAINTS])
def test_single_checks_equal_the_fused_run(broken, name):
    check = {**q.CHECKS, **q.KEY_CONSTRAINTS}[name]
    alone = q.run_checks(broken, (check,)).collect()
    fused = by(q.run_checks(broken, [*q.CHECKS.values(), *q.KEY_CONSTRAINTS.values()]), "check_name")
    assert alone == [fused[check.name]]


def test_composite_keys(broken):
    got = by(q.run_checks(broken, q.KEY_CONSTRAINTS.values()), "check_name")
    assert {n: r.issue_count for n, r in got.items()} == {
        "Duplicate order item keys": 1,
        "Duplicate payment keys": 1,
        "Duplicate translated categories": 1,
    }


def test_clean_and_empty_tables_pass(spark):
    clean = tables(
        spark,
        customers=[customer("c1")],
        orders=[order("o1")],
        order_items=[item("o1")],
        order_payments=[{"order_id": "o1", "payment_sequential": 1}],
        order_reviews=[review("o1", 5)],
        products=[product("p1", "x")],
        sellers=[{"seller_id": "s1"}],
        product_category_translation=[translation("x", "Ex")],
    )
    for t in (clean, tables(spark)):
        rows = q.run_checks(t).collect()
        assert len(rows) == 19 and all((r.issue_count, r.status) == (0, "PASS") for r in rows)


def test_failing_checks_come_first_then_names(sample):
    rows = [(r.status != "FAIL", r.check_name) for r in q.run_checks(sample).collect()]
    assert rows == sorted(rows) and {late for late, _ in rows} == {False, True}


def test_untranslated_names(broken):
    assert {r[0] for r in q.untranslated_categories(broken).collect()} == {"new", "newer"}


def test_key_profile_counts_null_keys_apart(spark):
    child = frame(spark, "order_items", [item(None), item(None), item("a"), item("b"), item("b")])
    parent = frame(spark, "orders", [order("a"), order(None)])
    profile = key_profile([KeySide("child", child, ("order_id",)), KeySide("parent", parent, ("order_id",))])
    row = profile.agg(
        orphan_rows("child", "parent").alias("orphans"),
        unmatched_keys("child", "parent").alias("unmatched"),
        duplicate_keys("child").alias("dup"),
    ).first()
    # A NULL key matches nothing, yet repeated NULLs form one repeated group.
    assert (row.orphans, row.unmatched, row.dup) == (4, 1, 2)


def test_key_profile_needs_equal_keys(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="equally many"):
        key_profile([KeySide("a", df, ("id",)), KeySide("b", df, ("id", "id"))])


def test_null_violations(broken):
    found = {
        (r.table_name, r.column_name): r.issue_count for r in q.null_violations(broken).collect() if r.issue_count
    }
    assert found == {
        ("orders", "customer_id"): 1,
        ("order_items", "order_id"): 1,
        ("order_items", "seller_id"): 1,
        ("order_items", "price"): 1,
        ("order_items", "freight_value"): 1,
    }


def test_length_violations_ignore_trailing_blanks(spark):
    t = tables(
        spark,
        customers=[
            {**customer("c1"), "customer_state": "SP "},
            {**customer("c2"), "customer_state": "SPX"},
            {**customer("c" * 51)},
        ],
    )
    found = {
        (r.column_name, r.max_length): r.issue_count for r in q.length_violations(t).collect() if r.issue_count
    }
    assert found == {("customer_state", 2): 1, ("customer_id", 50): 1, ("customer_unique_id", 50): 1}
    bounded = sum(len(spec.bounded) for spec in TABLE_SPECS.values())
    assert q.length_violations(t).count() == bounded


def test_require_constraints_names_what_is_broken(spark, broken):
    q.require_constraints(tables(spark, orders=[order("o1")]))
    with pytest.raises(ValueError, match=r"customers: duplicate key \(1\).*order_reviews: review_score is invalid \(2\)"):
        q.require_constraints(broken)


def test_row_counts_and_status_mix(broken):
    counts = q.row_counts(broken).collect()
    assert [r.table_name for r in counts] == sorted(TABLE_SPECS)
    assert {r.table_name: r.row_count for r in counts}["order_items"] == 8
    assert q.row_counts(broken, alias="loaded_rows").columns == ["table_name", "loaded_rows"]
    mix = q.status_breakdown(broken).collect()
    assert [tuple(r) for r in mix] == [("delivered", 8, Decimal("88.89")), ("shipped", 1, Decimal("11.11"))]


def test_equal_times_are_no_issue(spark):
    t = tables(spark, orders=[order("o1", delivered=0, order_delivered_carrier_date=day(0))])
    found = t.orders.agg(
        q.CHECKS["delivered_before_purchase"].measure().alias("a"), q.CHECKS["carrier_after_delivery"].measure().alias("b")
    ).first()
    assert tuple(found) == (0, 0)
    assert t.orders.filter(F.col("order_id") == "o1").count() == 1
