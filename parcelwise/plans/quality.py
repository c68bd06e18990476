"""Data-quality checks. All checks on one key, or on one table's rows, share one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.functions.labels import DELIVERED
from parcelwise.operators import KeySide, duplicate_keys, key_profile, orphan_rows, share_of_total, unmatched_keys
from parcelwise.sources.schema import TABLE_SPECS, VALID_SCORES
from parcelwise.sources.tables import Tables


@dataclass(frozen=True)
class KeyCheck:
    """Counts something about ``key`` in one or two tables: ``count(*tables)``."""

    name: str
    key: tuple[str, ...]
    tables: tuple[str, ...]
    count: Callable[..., Column]

    def measure(self) -> Column:
        return self.count(*self.tables)


@dataclass(frozen=True)
class RowCheck:
    """Counts the rows of one table that meet ``condition``."""

    name: str
    table: str
    condition: Callable[[], Column]

    def measure(self) -> Column:
        return F.count_if(self.condition())


Check = KeyCheck | RowCheck


def _duplicates(name: str, table: str, *key: str) -> KeyCheck:
    return KeyCheck(name, key, (table,), duplicate_keys)


def _orphans(name: str, child: str, parent: str, key: str) -> KeyCheck:
    return KeyCheck(name, (key,), (child, parent), orphan_rows)


def _purchased_later() -> Column:
    return F.col("order_delivered_customer_date") < F.col("order_purchase_timestamp")


def _shipped_later() -> Column:
    return F.col("order_delivered_carrier_date") > F.col("order_delivered_customer_date")


def _undated_delivery() -> Column:
    return (F.col("order_status") == DELIVERED) & F.col("order_delivered_customer_date").isNull()


def _unpriced() -> Column:
    return F.col("price").isNull() | F.col("freight_value").isNull()


def _negative() -> Column:
    return (F.col("price") < 0) | (F.col("freight_value") < 0)


def _invalid_score() -> Column:
    return ~F.col("review_score").between(*VALID_SCORES)


# Check names as reports show them.
CHECKS: dict[str, Check] = {
    "dup_customers": _duplicates("Duplicate customer IDs", "customers", "customer_id"),
    "dup_orders": _duplicates("Duplicate order IDs", "orders", "order_id"),
    "dup_products": _duplicates("Duplicate product IDs", "products", "product_id"),
    "dup_sellers": _duplicates("Duplicate seller IDs", "sellers", "seller_id"),
    "orphan_orders_customers": _orphans(
        "Orders without matching customers", "orders", "customers", "customer_id"
    ),
    "orphan_items_orders": _orphans(
        "Order items without matching orders", "order_items", "orders", "order_id"
    ),
    "orphan_items_products": _orphans(
        "Order items without matching products", "order_items", "products", "product_id"
    ),
    "orphan_items_sellers": _orphans(
        "Order items without matching sellers", "order_items", "sellers", "seller_id"
    ),
    "orphan_payments_orders": _orphans(
        "Payments without matching orders", "order_payments", "orders", "order_id"
    ),
    "orphan_reviews_orders": _orphans(
        "Reviews without matching orders", "order_reviews", "orders", "order_id"
    ),
    "untranslated_categories": KeyCheck(
        "Products without category translation",
        ("product_category_name",),
        ("products", "product_category_translation"),
        unmatched_keys,
    ),
    "orders_missing_purchase": RowCheck(
        "Orders missing purchase timestamp", "orders", lambda: F.col("order_purchase_timestamp").isNull()
    ),
    "delivered_missing_date": RowCheck(
        "Delivered orders missing customer delivery date", "orders", _undated_delivery
    ),
    "items_missing_price": RowCheck("Order items missing price or freight", "order_items", _unpriced),
    "items_negative": RowCheck("Order items with negative price/freight", "order_items", _negative),
    "invalid_scores": RowCheck("Invalid review scores", "order_reviews", _invalid_score),
    "delivered_before_purchase": RowCheck("Orders delivered before purchase", "orders", _purchased_later),
    "carrier_after_delivery": RowCheck(
        "Orders with carrier date after customer delivery", "orders", _shipped_later
    ),
    "multi_review_orders": _duplicates("Orders with multiple review records", "order_reviews", "order_id"),
}

# Declared keys that the checks above leave out; storage does not enforce them.
KEY_CONSTRAINTS: dict[str, Check] = {
    "dup_item_keys": _duplicates("Duplicate order item keys", "order_items", "order_id", "order_item_id"),
    "dup_payment_keys": _duplicates(
        "Duplicate payment keys", "order_payments", "order_id", "payment_sequential"
    ),
    "dup_categories": _duplicates(
        "Duplicate translated categories", "product_category_translation", "product_category_name"
    ),
}


def _long(counts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row of counts ``c0, c1, …`` to one (check_name, issue_count) row per label."""
    pairs = [F.struct(F.lit(label).alias("check_name"), F.col(f"c{i}").alias("issue_count"))
             for i, label in enumerate(labels)]
    return counts.select(F.inline(F.array(*pairs)))


def _counted(rows: DataFrame, checks: Sequence[Check]) -> DataFrame:
    counts = rows.agg(*(check.measure().alias(f"c{i}") for i, check in enumerate(checks)))
    return _long(counts, [check.name for check in checks])


def _key_pass(tables: Tables, key: tuple[str, ...], checks: Sequence[KeyCheck]) -> DataFrame:
    sides = sorted({table for check in checks for table in check.tables})
    return _counted(key_profile([KeySide(name, tables[name], key) for name in sides]), checks)


def _grouped(checks: Iterable[Check], by: Callable[[Check], object]) -> dict:
    groups: dict = {}
    for check in checks:
        groups.setdefault(by(check), []).append(check)
    return groups


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def count_issues(tables: Tables, checks: Iterable[Check]) -> DataFrame:
    """(check_name, issue_count) with one pass per key and one per table of row checks."""
    checks = list(checks)
    by_key = _grouped((c for c in checks if isinstance(c, KeyCheck)), lambda c: c.key)
    by_table = _grouped((c for c in checks if isinstance(c, RowCheck)), lambda c: c.table)
    return _union(
        [_key_pass(tables, key, group) for key, group in by_key.items()]
        + [_counted(tables[name], group) for name, group in by_table.items()]
    )


def run_checks(tables: Tables, checks: Iterable[Check] = tuple(CHECKS.values())) -> DataFrame:
    """(check_name, issue_count, status), failing checks first and then by name."""
    clean = F.col("issue_count") == 0
    return (
        count_issues(tables, checks)
        .withColumn("status", F.when(clean, "PASS").otherwise("FAIL"))
        .orderBy(clean, "check_name")
    )


def untranslated_categories(tables: Tables) -> DataFrame:
    """The category names behind the translation check."""
    return (
        tables.products.filter(F.col("product_category_name").isNotNull())
        .select("product_category_name")
        .distinct()
        .join(tables.product_category_translation, "product_category_name", "left_anti")
    )


@dataclass(frozen=True)
class ColumnRule:
    """A declared rule on one column; ``broken`` tells a row that violates it."""

    column: str
    problem: str
    broken: Callable[[], Column]
    max_length: int | None = None


def _null_rules(table: str) -> list[ColumnRule]:
    return [
        ColumnRule(name, "is NULL", lambda name=name: F.col(name).isNull()) for name in TABLE_SPECS[table].required
    ]


def _length_rules(table: str) -> list[ColumnRule]:
    return [
        ColumnRule(
            field.name,
            "is too long",
            lambda field=field: F.length(F.rtrim(field.name)) > field.max_length,
            field.max_length,
        )
        for field in TABLE_SPECS[table].bounded
    ]


def _broken_rules(tables: Tables, rules_of: Callable[[str], list[ColumnRule]]) -> DataFrame:
    """(table_name, column_name, problem, max_length, issue_count) from one pass per table."""
    frames = []
    for table in TABLE_SPECS:
        rules = rules_of(table)
        if not rules:
            continue
        counts = tables[table].agg(*(F.count_if(rule.broken()).alias(f"c{i}") for i, rule in enumerate(rules)))
        rows = [
            F.struct(
                F.lit(table).alias("table_name"),
                F.lit(rule.column).alias("column_name"),
                F.lit(rule.problem).alias("problem"),
                F.lit(rule.max_length).cast("int").alias("max_length"),
                F.col(f"c{i}").alias("issue_count"),
            )
            for i, rule in enumerate(rules)
        ]
        frames.append(counts.select(F.inline(F.array(*rows))))
    return _union(frames)


def null_violations(tables: Tables) -> DataFrame:
    """NULLs in columns declared NOT NULL or part of a key."""
    return _broken_rules(tables, _null_rules).drop("problem", "max_length")


def length_violations(tables: Tables) -> DataFrame:
    """Texts longer than declared; trailing blanks do not count."""
    return _broken_rules(tables, _length_rules).drop("problem")


def _rule_pass(tables: Tables, table: str, rules: Sequence[ColumnRule]) -> DataFrame:
    """(check_name, issue_count) of a table's key and column rules, from one scan and one grouping by the key.

    Each row is one entry with its key, and one more for each rule that it breaks; those have no key, so that
    a map task sends one row for a rule, however many rows break it. A table without a key sends such rows only.
    """
    key = TABLE_SPECS[table].key
    names = [f"{table}: duplicate key", *(f"{table}: {rule.column} {rule.problem}" for rule in rules)]
    own = [F.lit(0)] if key else []
    of_all = F.array(*own).cast("array<int>")
    broken = [F.coalesce(rule.broken(), F.lit(False)) for rule in rules]
    of_broken = F.array_compact(F.array(*own, *(F.when(b, F.lit(i)) for i, b in enumerate(broken, 1))))
    kinds = F.when(reduce(Column.__or__, broken), of_broken).otherwise(of_all) if rules else of_all
    values = [F.col(c).alias(f"value_{i}") for i, c in enumerate(key)]
    entries = tables[table].select(*values, F.explode(kinds).alias("kind"))
    keys = [F.when(F.col("kind") == 0, F.col(f"value_{i}")).alias(f"key_{i}") for i in range(len(key))]
    counted = entries.select("kind", *keys).groupBy("kind", *(f"key_{i}" for i in range(len(key)))).agg(F.count("*").alias("n"))
    issues = F.when(F.col("kind") > 0, F.col("n")).otherwise((F.col("n") > 1).cast("long"))
    return (
        counted.groupBy("kind")
        .agg(F.sum(issues).alias("issue_count"))
        .select(F.element_at(F.array(*map(F.lit, names)), F.col("kind") + 1).alias("check_name"), "issue_count")
    )


def constraint_violations(tables: Tables) -> DataFrame:
    """(check_name, issue_count) of every rule a load enforces, violated ones only, from one scan of each table."""

    def rules_of(table: str) -> list[ColumnRule]:
        scores = [ColumnRule("review_score", "is invalid", _invalid_score)] if table == "order_reviews" else []
        return _null_rules(table) + _length_rules(table) + scores

    return _union(_rule_pass(tables, table, rules_of(table)) for table in TABLE_SPECS).filter(F.col("issue_count") > 0)


def require_constraints(tables: Tables) -> None:
    """Raises when a declared rule is broken. Collects one short row per broken rule."""
    broken = [f"{row.check_name} ({row.issue_count})" for row in constraint_violations(tables).collect()]
    if broken:
        raise ValueError("loaded data breaks declared constraints: " + "; ".join(sorted(broken)))


def row_counts(tables: Tables, alias: str = "row_count") -> DataFrame:
    """(table_name, row count) of the nine raw tables."""
    return _union(
        df.agg(F.count(F.lit(1)).alias(alias)).select(F.lit(name).alias("table_name"), alias)
        for name, df in tables.items()
    ).orderBy("table_name")


def status_breakdown(tables: Tables) -> DataFrame:
    """Orders per status and their share of all orders."""
    groups = tables.orders.groupBy("order_status").agg(F.count(F.lit(1)).alias("order_count"))
    return share_of_total(groups, "order_count", "pct_of_orders").orderBy(
        F.col("order_count").desc_nulls_first(), F.col("order_status").asc_nulls_last()
    )
