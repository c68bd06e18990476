"""Plans and results under the skew and sizes a cluster would see."""

import random
import re
import tempfile
from collections import Counter
from datetime import timedelta
from decimal import Decimal
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from builders import PURCHASE, tables
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.operators import latest_per_key
from parcelwise.plans import quality as q
from parcelwise.plans.findings import FINDINGS
from parcelwise.plans.order_metrics import order_metrics
from parcelwise.plans.views import Views
from parcelwise.sources import TABLE_SPECS, Tables, load_tables, struct_type, write_tables


@pytest.fixture(scope="module")
def stored_sample(spark, sample, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    write_tables(sample, folder)
    return load_tables(spark, folder)


@pytest.fixture
def no_broadcast(conf):
    """Tables too large to broadcast, as at full size."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan(df)


def assert_only_groups_meet(text: str) -> None:
    """Below every single-partition exchange comes an aggregate, with nothing but row-wise steps between."""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = (x for x in lines[i + 1 :] if not re.search(r"\+- (\*\(\d+\) )?(Project|Sort|Filter) ", x))
            assert "HashAggregate" in next(below)


def scanned(df) -> list[str]:
    return sorted(re.findall(r"FileScan parquet \[([^\]]*)\]", re.sub(r"#\d+L?", "", plan(df))))


def test_fact_shuffles_each_input_once_and_joins_on_one_partitioning(stored_sample, no_broadcast):
    text = plan(order_metrics(stored_sample))
    # Orders and customers by customer; orders, items and reviews by order.
    assert text.count("Exchange hashpartitioning") == 5
    assert text.count("SortMergeJoin") == 3


def test_filters_and_columns_reach_the_scan(stored_sample, conf):
    conf("spark.sql.maxMetadataStringLength", "10000")
    text = plan(Views(stored_sample).reliability_summary)
    assert "EqualTo(order_status,delivered)" in text
    assert "IsNotNull(order_delivered_customer_date)" in text
    assert "ReadSchema: struct<order_id:string,price:decimal(12,2),freight_value:decimal(12,2)>" in text


@pytest.mark.parametrize(
    ("name", "tables"),
    [("05_estimated_vs_actual", 2), ("12_contribution", 2), ("02_satisfaction", 3), ("04_late_value_share", 3), ("08_categories", 6)],
)
def test_unused_inputs_are_not_read(stored_sample, name, tables):
    """The optimizer knows items and reviews are unique per order and drops unused joins."""
    assert len(scanned(FINDINGS[name](Views(stored_sample)))) == tables


@pytest.mark.parametrize("name", sorted(FINDINGS))
def test_no_python_no_cross_join_no_single_task_over_rows(stored_sample, name):
    text = plan(FINDINGS[name](Views(stored_sample)))
    for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text
    assert_only_groups_meet(text)


def test_a_plain_ntile_would_be_noticed(stored_sample):
    text = plan(order_metrics(stored_sample).withColumn("g", F.ntile(4).over(Window.orderBy("order_value"))))
    with pytest.raises(AssertionError):
        assert_only_groups_meet(text)


def test_fused_checks_scan_each_table_once_per_key(stored_sample):
    text = plan(q.run_checks(stored_sample))
    # order_id: 4 tables, customer_id, product_id, seller_id and category: 2 each; rows of 3 tables.
    assert text.count("FileScan parquet") == 4 + 4 * 2 + 3
    assert "Join" not in text


def hot(spark, rows: int) -> Tables:
    """A third of the orders are one customer's, a third of the items one product's, a third of
    the items and of the reviews one order's."""
    ids = spark.range(rows)
    third = F.col("id") % 3 == 0
    frames = {
        "customers": ids.select(
            F.concat(F.lit("c"), F.col("id")).alias("customer_id"), F.lit("SP").alias("customer_state")
        ),
        "orders": ids.select(
            F.concat(F.lit("o"), F.col("id")).alias("order_id"),
            F.when(third, "c0").otherwise(F.concat(F.lit("c"), F.col("id"))).alias("customer_id"),
            F.lit("delivered").alias("order_status"),
            F.lit(PURCHASE).cast("timestamp_ntz").alias("order_purchase_timestamp"),
            (F.lit(PURCHASE).cast("timestamp_ntz") + F.expr("make_dt_interval(cast(id % 9 as int))")).alias(
                "order_delivered_customer_date"
            ),
            (F.lit(PURCHASE).cast("timestamp_ntz") + F.expr("interval 4 days")).alias("order_estimated_delivery_date"),
        ),
        "order_items": ids.select(
            F.when(third, "o1").otherwise(F.concat(F.lit("o"), F.col("id"))).alias("order_id"),
            F.col("id").cast("int").alias("order_item_id"),
            F.when(F.col("id") % 3 == 1, "p1").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("product_id"),
            F.lit("s").alias("seller_id"),
            (F.col("id") % 100).cast("decimal(12,2)").alias("price"),
            F.lit(1).cast("decimal(12,2)").alias("freight_value"),
        ),
        "order_reviews": ids.select(
            F.col("id").cast("string").alias("review_id"),
            F.when(third, "o2").otherwise(F.concat(F.lit("o"), F.col("id"))).alias("order_id"),
            (F.col("id") % 5 + 1).cast("smallint").alias("review_score"),
            (F.lit(PURCHASE).cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, cast(id as int))")).alias(
                "review_answer_timestamp"
            ),
        ),
        "products": ids.select(
            F.concat(F.lit("p"), F.col("id")).alias("product_id"),
            F.concat(F.lit("g"), F.col("id") % 5).alias("product_category_name"),
        ),
    }

    def conform(name):
        schema = struct_type(name)
        df = frames.get(name, spark.createDataFrame([], schema))
        return df.select(
            *((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)
        )

    return Tables(
        **{
            name: conform(name)
            for name in (
                "customers",
                "geolocation",
                "order_items",
                "order_payments",
                "order_reviews",
                "orders",
                "product_category_translation",
                "products",
                "sellers",
            )
        }
    )


@pytest.fixture(scope="module")
def hot_tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hot"))
    write_tables(hot(spark, 30_000), folder)
    return load_tables(spark, folder)


@pytest.fixture
def small_skew_limits(conf, no_broadcast):
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "50k")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conf("spark.sql.files.maxPartitionBytes", "60k")
    conf("spark.sql.shuffle.partitions", "16")


def test_hot_customer_is_split(hot_tables, small_skew_limits):
    assert "SortMergeJoin(skew=true)" in final_plan(Views(hot_tables).reliability_summary)


def test_hot_product_is_split(hot_tables, small_skew_limits):
    text = final_plan(Views(hot_tables).category_performance)
    assert text.split("Initial Plan")[0].count("SortMergeJoin(skew=true)") >= 2


def test_results_under_skew(hot_tables, small_skew_limits):
    """Counted by hand from the rule that made the tables."""
    views = Views(hot_tables)
    rows = {r.delivery_status: r for r in views.reliability_summary.collect()}
    late = [i for i in range(30_000) if i % 9 > 4]
    assert rows["Late"].order_count == len(late)
    assert rows["On Time"].order_count == 30_000 - len(late)
    total = sum(i % 100 + 1 for i in range(30_000))
    assert sum(r.total_order_value for r in rows.values()) == total
    fact = views.order_metrics.filter("order_id in ('o1', 'o2', 'o4')").select("order_id", "item_count", "review_score")
    # o1 owns a third of the items and its own; the newest of o2's many reviews decides.
    assert {tuple(r) for r in fact.collect()} == {("o1", 10_001, 2), ("o2", 1, 29_997 % 5 + 1), ("o4", 1, 5)}
    categories = views.category_performance.agg(F.sum("total_order_value")).first()[0]
    assert categories == total
    checks = {r.check_name: r.issue_count for r in q.run_checks(hot_tables).collect()}
    assert checks["Orders with multiple review records"] == 1
    assert checks["Order items without matching sellers"] == 30_000
    assert checks["Order items without matching orders"] == 0


def test_latest_row_is_reduced_before_the_shuffle(stored_sample):
    text = plan(latest_per_key(stored_sample.order_reviews, "order_id", "review_answer_timestamp", ("review_score",)))
    assert "partial_min" in text and "Window" not in text
    assert text.index("partial_min") > text.index("Exchange hashpartitioning")


def test_quartiles_of_hot_values(hot_tables, small_skew_limits):
    rows = FINDINGS["17_value_quartiles"](Views(hot_tables)).collect()
    assert [r.order_count for r in rows] == [7500] * 4


def test_declared_rules_take_one_scan_of_each_table(stored_sample, no_broadcast):
    text = plan(q.constraint_violations(stored_sample))
    assert text.count("FileScan parquet") == 9
    # Each table is grouped by its key where it has one, and by rule.
    assert text.count("Exchange hashpartitioning") + text.count("Exchange SinglePartition") <= 18


def test_rules_equal_their_single_counts(spark):
    rng = random.Random(4)
    rows = {
        name: [
            {f.name: _value(rng, f.dataType) for f in struct_type(name).fields} for _ in range(rng.choice((0, 1, 40)))
        ]
        for name in TABLE_SPECS
    }
    rows["order_reviews"] += [{"review_id": "r", "order_id": "o", "review_score": s} for s in (0, 6, 5, None, 5)]
    loaded = tables(spark, **rows)
    found = {r.check_name: r.issue_count for r in q.constraint_violations(loaded).collect()}
    want = {}
    for name, spec in TABLE_SPECS.items():
        for field in spec.required:
            want[f"{name}: {field} is NULL"] = sum(r.get(field) is None for r in rows[name])
        for field in spec.bounded:
            want[f"{name}: {field.name} is too long"] = sum(
                len((r.get(field.name) or "").rstrip(" ")) > field.max_length for r in rows[name]
            )
        if spec.key:
            keys = Counter(tuple(r.get(c) for c in spec.key) for r in rows[name])
            want[f"{name}: duplicate key"] = sum(n > 1 for n in keys.values())
    scores = [r.get("review_score") for r in rows["order_reviews"]]
    want["order_reviews: review_score is invalid"] = sum(s is not None and not 1 <= s <= 5 for s in scores)
    assert found == {check: n for check, n in want.items() if n}


def _value(rng, kind):
    if rng.random() < 0.3:
        return None
    if isinstance(kind, T.StringType):
        return rng.choice(["a", "b ", "x" * rng.randint(1, 300)])
    if isinstance(kind, T.DecimalType):
        return Decimal(rng.randint(0, 9))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return PURCHASE
    return float(rng.randint(0, 9)) if isinstance(kind, (T.DoubleType, T.FloatType)) else rng.randint(1, 5)


def test_a_month_of_the_published_fact_reads_few_files(spark, stored_sample, tmp_path, conf):
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    fact = Views(stored_sample).order_metrics
    # A third of all orders at one moment.
    moment = F.when(F.abs(F.hash("order_id")) % 3 == 0, F.lit(PURCHASE).cast("timestamp_ntz")).otherwise(F.col("order_purchase_timestamp"))
    for given in (fact, fact.withColumn("order_purchase_timestamp", moment)):
        folder = tempfile.mkdtemp(dir=tmp_path)
        views = Views(stored_sample, {"order_metrics": given}).publish(folder)
        assert sorted(views.order_metrics.collect(), key=str) == sorted(given.collect(), key=str)
        groups = []
        for file in Path(folder, "vw_order_delivery_metrics").glob("*.parquet"):
            stored = pq.ParquetFile(file)
            at = stored.schema_arrow.get_field_index("order_purchase_timestamp")
            for i in range(stored.num_row_groups):
                group = stored.metadata.row_group(i)
                groups.append((group.column(at).statistics.min, group.column(at).statistics.max, group.num_rows))
        groups.sort()
        assert len(groups) >= 6 and all(a[1] <= b[0] for a, b in zip(groups, groups[1:]))
        assert max(n for *_, n in groups) <= 2 * sum(n for *_, n in groups) / len(groups)
        first = groups[0][0]
        assert sum(low < first + timedelta(days=31) for low, _, _ in groups) <= 2
