import csv
import gzip
import random
import threading
import time
import zlib
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest
from builders import customer, item, order, review, tables
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from parcelwise.plans import quality as q
from parcelwise.plans.ingest import ingest
from parcelwise.plans.views import VIEW_NAMES, Views
from parcelwise.sources import (
    TABLE_SPECS,
    Tables,
    VersionedFolder,
    load_tables,
    open_tables,
    read_csv_table,
    read_csv_tables,
    scratch_folder,
    struct_type,
    write_tables,
)
from parcelwise.sources.csv_files import unclosed_quotes
from parcelwise.sources.tables import each_at_once, save_tables


def raw(folder, **lines):
    """A raw delivery: every table's file with a header, and the given lines."""
    for name, spec in TABLE_SPECS.items():
        header = ",".join(f'"{f.name}"' for f in spec.fields)
        text = "\n".join([header, *lines.get(name, [])]) + "\n"
        (folder / f"shop_{spec.csv_suffix}").write_text(text, encoding="utf-8")
    return str(folder)


def test_schemas_are_declared():
    assert len(TABLE_SPECS) == 9
    assert struct_type("order_reviews")["review_score"].dataType.simpleString() == "smallint"
    assert struct_type("products").names[2] == "product_name_lenght"
    assert TABLE_SPECS["order_items"].required == (
        "order_id",
        "order_item_id",
        "product_id",
        "seller_id",
        "price",
        "freight_value",
    )


def test_types_zeros_and_empties(spark, tmp_path):
    folder = raw(
        tmp_path,
        customers=['"c1","u1","01234","são paulo",SP', 'c2,u2,,"",""'],
        order_items=["o1,1,p1,s1,2018-03-01 10:00:00,1.239,-0.005", "o1,2,p1,s1,,58.90,"],
        geolocation=['"01037",-23.5,-46.6,sao paulo,SP'],
    )
    t = read_csv_tables(spark, folder)
    assert [tuple(r) for r in t.customers.orderBy("customer_id").collect()] == [
        ("c1", "u1", "01234", "são paulo", "SP"),
        ("c2", "u2", None, "", ""),
    ]
    assert [tuple(r) for r in t.order_items.orderBy("order_item_id").collect()] == [
        ("o1", 1, "p1", "s1", datetime(2018, 3, 1, 10), Decimal("1.24"), Decimal("-0.01")),
        ("o1", 2, "p1", "s1", None, Decimal("58.90"), None),
    ]
    assert t.geolocation.first().geolocation_lat == -23.5
    assert t.orders.schema == struct_type("orders")


def test_byte_order_mark_in_the_header(spark, tmp_path):
    path = tmp_path / "sellers.csv"
    path.write_bytes(b"\xef\xbb\xbf" + "seller_id,a,b,c\ns1,01,city,SP\n".encode())
    assert [tuple(r) for r in read_csv_table(spark, "sellers", str(path)).collect()] == [("s1", "01", "city", "SP")]


def test_text_with_line_breaks_is_read_from_all_files(spark, tmp_path):
    """Any text of any table may hold breaks, quotes and commas; several files are read by several tasks."""
    r = random.Random(7)
    pieces = ["a", "é", '"', '""', "\n", "\r\n", ",", " ", "long text " * 9]
    for name, spec in TABLE_SPECS.items():
        folder = tmp_path / f"all_{spec.csv_suffix}"
        folder.mkdir()
        expected = []
        for part in range(2):
            with open(folder / f"part-{part}.csv", "w", newline="", encoding="utf-8") as out:
                writer = csv.writer(out, lineterminator="\n" if part else "\r\n")
                writer.writerow(struct_type(name).names)
                for _ in range(40):
                    row = ["x" + "".join(r.choices(pieces, k=r.randint(1, 12))) if f.type.simpleString() == "string" else "" for f in spec.fields]
                    writer.writerow(row)
                    # In a file whose lines end in CRLF, Spark's reader takes a CRLF inside quotes as LF.
                    expected.append(tuple((v if part else v.replace("\r\n", "\n")) or None for v in row))
        df = read_csv_tables(spark, str(tmp_path))[name]
        assert sorted(map(tuple, df.collect()), key=str) == sorted(expected, key=str)


def test_unclosed_quote_stops_the_load(spark, tmp_path):
    """Also in the last field, where the rest of the file would be its text."""
    for k, bad in enumerate(['r7,o7,5,,"never closed,,', 'r7,o7,5,,,,"']):
        (tmp_path / str(k)).mkdir()
        lines = [f'r{i},o{i},5,,"text {i}",,' for i in range(20)]
        lines[7] = bad
        folder = raw(tmp_path / str(k), order_reviews=lines)
        with pytest.raises(ValueError, match="quoted field never closed in .*order_reviews"):
            ingest(spark, folder, str(tmp_path / f"out{k}"))


def test_bad_input_is_located(spark, tmp_path):
    lines = ["o1,c1,created,2018-01-01 00:00:00,,,,", 'o2,c1,"sent\nlate",2018-13-45,,,,', "o3,c1,created,,,,,", "o4,c1", "o5,c1,created,,x,,,"]
    folder = raw(tmp_path, orders=lines)
    with pytest.raises(ValueError) as error:
        ingest(spark, folder, str(tmp_path / "out"))
    text = str(error.value)
    assert text.startswith("malformed orders: file:") and text.count("orders_dataset.csv") == 3
    assert "record 2, field order_purchase_timestamp: 'o2,c1" in text
    assert "record 4, number of fields or quotes: 'o4,c1'" in text
    assert "record 5, field order_approved_at: 'o5" in text
    assert not list((tmp_path / "out").rglob("*.parquet"))


def test_several_files_of_one_ending_are_refused(spark, tmp_path):
    folder = raw(tmp_path)
    (tmp_path / "old_sellers_dataset.csv").write_text("seller_id,a,b,c\ns1,1,x,SP\n")
    with pytest.raises(ValueError, match="sellers: 2 files in .* end in sellers_dataset.csv"):
        read_csv_tables(spark, folder).sellers  # noqa: B018
    assert read_csv_tables(spark, folder).orders.count() == 0


@pytest.mark.parametrize("table", ["orders", "order_reviews"])
@pytest.mark.parametrize("fault", ["type", "short", "long"])
def test_bad_input_stops_the_load(spark, tmp_path, table, fault):
    names = struct_type(table).names
    fields = ["x"] * 2 + [""] * (len(names) - 2)
    if fault == "type":
        fields[-1] = "2018-13-45"
    line = ",".join(fields[:-1] if fault == "short" else [*fields, "extra"] if fault == "long" else fields)
    folder = raw(tmp_path, **{table: [line]})
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv_table(spark, table, f"{folder}/*{TABLE_SPECS[table].csv_suffix}").collect()


def test_reload_replaces(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    out = str(tmp_path / "out")
    first = raw(tmp_path / "raw", sellers=["s1,1,a,SP", "s2,1,a,SP"], orders=["o1,c1,created,,,,,"])
    ingest(spark, first, out)
    loaded = ingest(spark, first, out)
    assert loaded.sellers.count() == 2 and loaded.orders.count() == 1
    raw(tmp_path / "raw", sellers=["s3,1,a,SP"])
    loaded = ingest(spark, first, out)
    assert [r.seller_id for r in loaded.sellers.collect()] == ["s3"]
    assert {r.table_name: r.row_count for r in q.row_counts(loaded).collect()}["orders"] == 0


def test_strict_load_refuses_broken_rules(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    folder = raw(tmp_path / "raw", sellers=["s1,1,a,SPX", "s1,1,a,SP"], customers=["c1,,,,"])
    with pytest.raises(ValueError, match="customers: customer_unique_id is NULL.*seller_state is too long"):
        ingest(spark, folder, str(tmp_path / "out"))
    loaded = ingest(spark, folder, str(tmp_path / "out"), strict=False)
    assert loaded.sellers.count() == 2


def test_refused_loads_keep_the_old_tables(spark, tmp_path):
    for name in ("raw", "bad", "twice"):
        (tmp_path / name).mkdir()
    out = str(tmp_path / "out")
    ingest(spark, raw(tmp_path / "raw", sellers=["s1,1,a,SP"], orders=["o1,c1,created,,,,,"]), out)
    with pytest.raises(ValueError, match="sellers"):
        ingest(spark, raw(tmp_path / "twice", sellers=["s2,1,a,SP", "s2,1,a,SP"]), out)
    with pytest.raises(Exception, match="(?i)malformed"):
        ingest(spark, raw(tmp_path / "bad", sellers=["s3,1"], orders=["o2,c1,created,,,,,"]), out)
    loaded = load_tables(spark, out)
    assert [r.seller_id for r in loaded.sellers.collect()] == ["s1"]
    assert [r.order_id for r in loaded.orders.collect()] == ["o1"]
    assert [p.name for p in tmp_path.iterdir() if "staged" in p.name] == []


def sellers(n):
    return [f"s{n}-{i},1,a,SP" for i in range(n)]


def consistent(spark, folder):
    """The load that all nine tables of a reader come from, by its number of sellers and orders."""
    t = load_tables(spark, folder)
    counts = {df.count() for name, df in t.items() if name in ("sellers", "orders", "customers")}
    assert len(counts) == 1
    return counts.pop()


def load(spark, tmp_path, n, out):
    folder = tmp_path / f"raw{n}"
    folder.mkdir(exist_ok=True)
    lines = dict(sellers=sellers(n), orders=[f"o{i},c{i},created,,,,," for i in range(n)], customers=[f"c{i},u,,," for i in range(n)])
    return ingest(spark, raw(folder, **lines), out)


def test_a_load_that_dies_at_any_step_is_never_seen(spark, tmp_path, monkeypatch):
    """Killed before each write of a table, before the manifest, and in the midst of it: no clean-up runs."""
    out = str(tmp_path / "out")
    load(spark, tmp_path, 2, out)
    monkeypatch.setattr(VersionedFolder, "discard", lambda self, id_: None)
    write = DataFrameWriter.parquet
    for step in range(len(TABLE_SPECS)):
        left = [step]

        def dies(self, path, *args, left=left):
            if not left[0]:
                raise KeyboardInterrupt
            left[0] -= 1
            assert consistent(spark, out) == 2  # a reader in between
            write(self, path, *args)

        monkeypatch.setattr(DataFrameWriter, "parquet", dies)
        with pytest.raises(KeyboardInterrupt):
            load(spark, tmp_path, 3, out)
        assert consistent(spark, out) == 2
    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    monkeypatch.setattr(VersionedFolder, "accept", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        load(spark, tmp_path, 3, out)
    monkeypatch.undo()
    assert consistent(spark, out) == 2
    half = tmp_path / "out" / "manifests" / f"{2:012d}.json"
    half.write_text('{"format": 1, "id": "x", "na')
    assert consistent(spark, out) == 2
    load(spark, tmp_path, 4, out)
    assert consistent(spark, out) == 4 and VersionedFolder(spark, out).latest().number == 3


def test_readers_keep_the_version_they_opened(spark, tmp_path):
    out = str(tmp_path / "out")
    first = load(spark, tmp_path, 2, out)
    load(spark, tmp_path, 3, out)
    assert first.sellers.count() == 2 and load_tables(spark, out).sellers.count() == 3
    folder = VersionedFolder(spark, out)
    assert folder.vacuum() == []
    load(spark, tmp_path, 5, out)
    (tmp_path / "out" / "versions" / "left-by-a-dead-load").mkdir()
    assert len(folder.vacuum()) == 1 and len(folder.vacuum(older_than_hours=-1)) == 1
    assert consistent(spark, out) == 5 and len(list((tmp_path / "out" / "versions").iterdir())) == 2
    with pytest.raises(ValueError, match="newest"):
        folder.vacuum(keep=0)


def test_two_loads_that_end_together_are_two_versions(spark, tmp_path):
    folder = VersionedFolder(spark, str(tmp_path))
    ids = [folder.new_id() for _ in range(2)]
    numbers = folder.numbers
    folder.numbers = lambda: []  # both looked before either wrote
    assert [folder.accept(i, ["a"]).number for i in ids] == [1, 2]
    folder.numbers = numbers
    assert folder.latest().id == ids[1] and folder.version(1).id == ids[0]


def test_paths_can_be_named(spark, tmp_path):
    folder = raw(tmp_path)
    other = tmp_path / "elsewhere.csv"
    other.write_text("seller_id,a,b,c\ns9,1,x,SP\n")
    t = read_csv_tables(spark, folder, paths={"sellers": str(other)})
    assert t.sellers.first().seller_id == "s9"


def small(spark):
    return tables(
        spark,
        customers=[customer("c1")],
        orders=[order("a"), order("b", delivered=12), order("c", due=None)],
        order_items=[item("a"), item("b", "5.00", "0.50")],
        order_reviews=[review("a", 5), review("b", 1)],
    )


def test_tables_are_opened_on_first_use(spark):
    opened = []

    def source(name):
        def make():
            opened.append(name)
            return spark.createDataFrame([], struct_type(name))

        return make

    t = Tables(**{name: source(name) for name in TABLE_SPECS})
    assert opened == []
    assert t.orders is t["orders"] and t.sellers.count() == 0
    assert opened == ["orders", "sellers"]
    with pytest.raises(AttributeError):
        t.nothing  # noqa: B018
    with pytest.raises(ValueError, match="expected the tables"):
        Tables(orders=t.orders)


def test_parquet_round_trip(spark, tmp_path):
    t = small(spark)
    write_tables(t, str(tmp_path))
    back = load_tables(spark, str(tmp_path))
    for name, df in t.items():
        assert back[name].schema == df.schema and back[name].exceptAll(df).isEmpty()


def test_a_prefix_leaves_session_views_alone(spark, sample):
    spark.range(3).createOrReplaceTempView("orders")
    try:
        Views(sample).register("pw_")
        assert spark.table("orders").count() == 3
        assert spark.table("pw_orders").columns == sample.orders.columns
        assert "delivery_status" in spark.table("pw_vw_order_delivery_metrics").columns
    finally:
        for name in ("orders", *(t.name for t in spark.catalog.listTables() if t.name.startswith("pw_"))):
            spark.catalog.dropTempView(name)


def test_views_answer_sql(spark):
    """The raw tables and views under their names, and the SQL a report would send."""
    Views(small(spark)).register()
    rows = spark.sql("""
        SELECT delivery_status, COUNT(*) AS n, COUNT(*) FILTER (WHERE review_score <= 2) AS negative,
               ROUND(SUM(order_value), 2) AS total
        FROM vw_order_delivery_metrics GROUP BY delivery_status ORDER BY delivery_status
    """).collect()
    assert [tuple(r) for r in rows] == [("Late", 2, 1, Decimal("5.50")), ("On Time", 1, 0, Decimal("11.00"))]
    quartiles = spark.sql("""
        SELECT order_id, NTILE(4) OVER (ORDER BY order_value NULLS LAST, order_id) AS q FROM vw_order_delivery_metrics
    """).collect()
    assert {r.order_id: r.q for r in quartiles} == {"a": 2, "b": 1, "c": 3}
    months = spark.sql("SELECT DATE_TRUNC('month', order_purchase_timestamp)::DATE m, COUNT(*) n FROM orders GROUP BY m")
    assert months.first().n == 3
    for name in [*VIEW_NAMES.values(), *TABLE_SPECS]:
        assert spark.table(name).columns
    Views(tables(spark)).register()
    assert spark.table("vw_order_delivery_metrics").isEmpty()


def test_published_views_equal_the_lazy_ones(spark, sample, tmp_path):
    v = Views(sample)
    v.publish(str(tmp_path))
    v.publish(str(tmp_path))
    for name, df in v.frames().items():
        stored = spark.read.parquet(f"{tmp_path}/{name}")
        assert stored.dtypes == df.dtypes
        assert stored.exceptAll(df).isEmpty() and df.exceptAll(stored).isEmpty()


def test_given_views_are_published(spark, sample, tmp_path):
    late = Views(sample).order_metrics.where("delivery_status = 'Late'")
    folder = str(tmp_path / "views")
    published = Views(sample, {"order_metrics": late}).publish(folder)
    assert published.order_metrics.count() == late.count() == 286
    assert [r.delivery_status for r in published.reliability_summary.collect()] == ["Late"]
    again = published.publish(folder)
    assert again.order_metrics.count() == 286


def test_catalog_tables(spark):
    assert save_tables(small(spark), "shop").orders.count() == 3
    saved = save_tables(small(spark), "shop")
    assert spark.catalog.tableExists("shop.order_items")
    assert Views(saved).reliability_summary.agg(F.sum("order_count")).first()[0] == 3


def test_catalog_holds_tables_and_views_for_every_session(spark):
    views = Views(save_tables(small(spark), "market")).save("market")
    other = spark.newSession()
    for name, df in {**dict(views.tables.items()), **views.frames()}.items():
        assert other.table(f"market.{name}").schema.names == df.columns
    late = "SELECT count(*) FROM market.vw_order_delivery_metrics v JOIN market.orders o USING (order_id) WHERE delivery_status = 'Late'"
    assert other.sql(late).first()[0] == 2
    before = views.order_metrics
    again = Views(save_tables(tables(spark), "market")).save("market")
    assert other.sql(late).first()[0] == 0 and again.order_metrics.isEmpty() and other.table("market.orders").isEmpty()
    assert open_tables(spark, "market").orders.isEmpty()
    assert before.count() == 3  # a frame opened before keeps its version
    names = {t.name for t in spark.catalog.listTables("market")}
    assert {*VIEW_NAMES.values(), *TABLE_SPECS} < names and len(names) == 2 * 14


def test_a_failed_save_leaves_the_names(spark):
    save_tables(small(spark), "steady")
    broken = dict(small(spark).items()) | {"sellers": small(spark).sellers.withColumn("seller_city", F.raise_error(F.lit("no"))).limit(1)}
    broken["sellers"] = spark.range(1).select(F.raise_error(F.lit("no")).cast("string").alias("seller_id"))
    with pytest.raises(Exception, match="no"):
        save_tables(Tables(**broken), "steady")
    assert spark.table("steady.orders").count() == 3


def test_scratch_folder_is_the_one_the_session_names(spark):
    assert scratch_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_a_raw_delivery_is_written_compressed(spark, sample, tmp_path):
    """Plain CSV of the nine tables, several times the size of the Parquet it is loaded into, was most of what a reload wrote."""
    import __spark_entry__ as entry

    broken = entry._with_breaks(sample)
    raw = Path(entry._written_csv(broken).removeprefix("file:"))
    written = {name: list((raw / TABLE_SPECS[name].csv_suffix).glob("part-*")) for name in TABLE_SPECS}
    assert all(p.name.endswith(".csv.gz") for parts in written.values() for p in parts)
    plain = sum(len(gzip.decompress(p.read_bytes())) for parts in written.values() for p in parts)
    assert sum(p.stat().st_size for parts in written.values() for p in parts) * 2 < plain
    loaded = ingest(spark, str(raw), str(tmp_path / "loaded"), strict=False)
    for name in ("sellers", "order_reviews"):
        assert sorted(map(tuple, loaded[name].collect()), key=str) == sorted(map(tuple, broken[name].collect()), key=str)


def test_loaded_tables_are_written_with_zstd(spark, tmp_path):
    """Keys with too many values for a dictionary made loaded tables grow faster than the delivery."""
    r = random.Random(5)
    key = lambda n: f'"{(k := r.randrange(n))}, {k}"'
    lines = [f"{key(10**7)},1,{key(10**6)},{key(10**6)},2018-03-01 10:00:00,{r.randrange(10**6) / 100},1.00" for _ in range(60_000)]
    (tmp_path / "raw").mkdir()
    loaded = ingest(spark, raw(tmp_path / "raw", order_items=lines, sellers=["s1,1,a,SP"]), str(tmp_path / "loaded"), strict=False)
    size = lambda folder: sum(p.stat().st_size for p in folder.rglob("order_items/part-*.parquet"))
    for name in ("order_items", "sellers"):
        files = list((tmp_path / "loaded").rglob(f"{name}/part-*.parquet"))
        assert files and all(p.name.endswith(".zstd.parquet") for p in files)
    loaded.order_items.write.option("compression", "snappy").parquet(str(tmp_path / "usual" / "order_items"))
    assert size(tmp_path / "loaded") * 1.25 < size(tmp_path / "usual")
    assert loaded.order_items.count() == 60_000


def test_quotes_are_counted_as_bytes(spark, tmp_path):
    """Also where a file is not UTF-8, and where most lines hold none."""
    files = {
        "closed": 'a,"é ""x"" 漢",b\r\n"two\nlines",\n'.encode(),
        "latin_closed": 'a\n"caf\xe9",b\n'.encode("latin-1"),
        "open": 'a,"é ""x"",b\n"two\nlines",\n'.encode(),
        "latin_open": 'a\n"caf\xe9" "\n'.encode("latin-1"),
        "none": b"a,b\nc,d\n",
        "empty": b"",
    }
    for name, body in files.items():
        (tmp_path / f"{name}.csv").write_bytes(body)
    assert [Path(p).stem for p in unclosed_quotes(spark, str(tmp_path))] == ["latin_open", "open"]


def test_tables_are_loaded_side_by_side(spark, tmp_path, monkeypatch):
    """A table of few files left cores idle while the others waited for it."""
    both = threading.Barrier(2)
    write = DataFrameWriter.parquet

    def meets(self, path, *args):
        if path.endswith(("/customers", "/geolocation")):
            both.wait(60)
        write(self, path, *args)

    monkeypatch.setattr(DataFrameWriter, "parquet", meets)
    (tmp_path / "raw").mkdir()
    loaded = ingest(spark, raw(tmp_path / "raw", sellers=["s1,1,a,SP"], customers=["c1,u1,,,"]), str(tmp_path / "out"))
    assert loaded.sellers.count() == 1 and loaded.customers.count() == 1


def test_side_by_side_work_ends_with_the_first_tables_error(spark):
    done, names, group = [], list(TABLE_SPECS), "spark.jobGroup.id"
    before = spark.sparkContext.getLocalProperty(group)

    def work(name):
        assert spark.sparkContext.getLocalProperty(group) == "the caller's"
        if name == names[2]:
            raise ValueError(name)
        time.sleep(1)
        done.append(name)
        if name == names[1]:
            raise ValueError(name)

    spark.sparkContext.setLocalProperty(group, "the caller's")
    try:
        with pytest.raises(ValueError, match=f"^{names[1]}$"):
            each_at_once(spark, work, most=3)
    finally:
        spark.sparkContext.setLocalProperty(group, before)
    assert set(names[:2]) <= set(done) and len(done) < 6


def test_a_raw_delivery_takes_a_fast_level_of_gzip(spark, tmp_path):
    """Its usual level was most of the time of writing. Moments lose no digit."""
    import __spark_entry__ as entry

    r = random.Random(7)
    moments = [datetime(2018, 3, 1, 10), datetime(2018, 3, 1, 10, 0, 0, 120_000), datetime(1899, 12, 31, 23, 59, 59, 1), None]
    rows = [order(f"{r.randrange(10**12)}", order_purchase_timestamp=r.choice(moments)) for _ in range(5_000)]
    given = tables(spark, orders=rows)
    folder = entry._written_csv(given)
    packed = [p.read_bytes() for p in (Path(folder.removeprefix("file:")) / TABLE_SPECS["orders"].csv_suffix).glob("part-*.gz")]
    texts = [gzip.decompress(b) for b in packed]
    assert b"2018-03-01 10:00:00," in b"".join(texts) and b":59.000001," in b"".join(texts)
    assert sum(map(len, packed)) > 1.02 * sum(len(zlib.compress(t, 6)) for t in texts)
    loaded = ingest(spark, folder, str(tmp_path / "loaded"), strict=False)
    assert sorted(map(tuple, loaded.orders.collect()), key=str) == sorted(map(tuple, given.orders.collect()), key=str)
