"""Queries against their SQL on random tables full of gaps, orphans, ties and extremes."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

TS = pa.timestamp("us")
SCHEMAS = {
    "nation": [("n_nationkey", pa.int32()), ("n_name", pa.string())],
    "customer": [("c_custkey", pa.int64()), ("c_name", pa.string()), ("c_nationkey", pa.int32())],
    "supplier": [("s_suppkey", pa.int64()), ("s_nationkey", pa.int32())],
    "part": [("p_partkey", pa.int64()), ("p_brand", pa.string()), ("p_size", pa.int32())],
    "orders": [
        ("o_orderkey", pa.int64()),
        ("o_custkey", pa.int64()),
        ("o_orderstatus", pa.string()),
        ("o_totalprice", pa.float64()),
        ("o_orderdate", TS),
        ("o_orderpriority", pa.string()),
    ],
    "lineitem": [
        ("l_orderkey", pa.int64()),
        ("l_partkey", pa.int64()),
        ("l_suppkey", pa.int64()),
        ("l_linenumber", pa.int32()),
        ("l_extendedprice", pa.float64()),
        ("l_tax", pa.float64()),
        ("l_shipdate", TS),
    ],
    "events": [("event_id", pa.int64()), ("ts", TS), ("event_type", pa.string()), ("props", pa.string())],
}


def random_rows(seed: int, repeats: bool) -> dict[str, list[tuple]]:
    r = random.Random(seed)
    orders = 700

    def maybe(value, chance=0.05):
        return None if r.random() < chance else value

    def key(limit):
        """A third of all references go to one key, some to none."""
        return 1 if r.random() < 0.33 else r.randrange(limit + 5)

    def amount():
        return r.choice([0.0, 0.01, -12.34, 9_999_999_999.99, *(r.randrange(100_000) / 100 for _ in range(9))])

    def moment():
        return datetime(2016, 1, 1) + timedelta(seconds=r.randrange(3 * 365 * 86400), microseconds=r.randrange(10**6))

    rows = {
        "nation": [(i, f"NATION_{i}") for i in range(25)],
        "customer": [(i, maybe(f"name {i}"), r.randrange(25)) for i in range(60)],
        "supplier": [(i, r.randrange(25)) for i in range(20)],
        "part": [(i, r.choice(["Brand#25", "Brand#1", "Brand#2", "x" * 120]), r.randrange(50)) for i in range(80)],
        "orders": [
            (
                i,
                maybe(key(60)),
                r.choice(["O", "F", "F", "P", None]),
                maybe(amount()),
                maybe(datetime(2016, 1, 1) + timedelta(days=r.randrange(1000))),
                maybe(r.choice(["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])),
            )
            for i in range(orders)
        ],
        "lineitem": [
            (
                maybe(key(orders)),
                maybe(key(80)),
                maybe(key(20)),
                r.randrange(1, 4),
                maybe(amount()),
                maybe(r.choice([0.0, 0.01, 0.07, -0.03])),
                maybe(moment()),
            )
            for _ in range(1500)
        ],
        "events": [
            (
                maybe(r.randrange(orders)),
                maybe(r.choice([datetime(2019, 1, 1), moment()])),
                maybe(r.choice(["purchase", "signup", "click", "view", "error", "other"])),
                maybe(r.choice(['{"k": 1}', 'line\nbreak, "quoted"', "", " ", "cr\r\nlf ", '"', "\\N"])),
            )
            for _ in range(1500)
        ],
    }
    if repeats:
        for name in ("customer", "supplier", "part", "orders"):
            rows[name] += r.choices(rows[name], k=20)
    return rows


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    made = {}
    for repeats in (False, True):
        folder = tmp_path_factory.mktemp("repeats" if repeats else "unique")
        for name, rows in random_rows(11 + repeats, repeats).items():
            columns = list(zip(*rows))
            schema = pa.schema(SCHEMAS[name])
            table = pa.table([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
            pq.write_table(table, folder / f"{name}.parquet")
        made[repeats] = (str(folder), connect(str(folder)))
    return made


ALL = sorted(entry.library_queries())
# Views need unique keys, which a strict load demands; checks must count what is repeated.
ON_REPEATS = [name for name in ALL if name.startswith(("dq_", "row_", "status_", "latest_", "order_value"))]


@pytest.mark.parametrize("name", ALL)
def test_unique_keys(spark, folders, name):
    folder, con = folders[False]
    assert compare(entry.library_queries()[name](spark, folder), con, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ON_REPEATS)
def test_repeated_keys(spark, folders, name):
    folder, con = folders[True]
    assert compare(entry.library_queries()[name](spark, folder), con, entry.oracle_sql()[name]) is None


def test_the_tables_exercise_the_checks(folders, spark):
    folder, _ = folders[True]
    counts = {r.check_name: r.issue_count for r in entry.library_queries()["dq_summary"](spark, folder).collect()}
    silent = {name for name, n in counts.items() if n == 0}
    assert silent == {"Invalid review scores"}
