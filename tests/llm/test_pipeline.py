import re

import pytest
from test_ngram_join import brute

import corpus_pipeline
from parcelwise.llm import decontaminate, mixing, pii

FOLDER = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    """All documents there have a known language; the rest is compared with plain Python."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    first = [d for d, _, label in brute([(d, r["text"]) for d, r in rows.items()], 5, 80) if d == label]
    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [words(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = {d for d in first if not any(i in words(rows[d]["text"]) for i in items)}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(got) == want
    for d, r in got.items():
        assert r["text"] == pii.redact(rows[d]["text"]) and r["source"] == rows[d]["source"]
        assert 0 <= r["taken"] <= mixing.MOST_COPIES * r["size"]


# Extra columns with names that the stages use themselves.
CLASHING = "text_key long, set_id long, group_id long, row_id long, held_id long, out_id long, copies long, language string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


@pytest.fixture(scope="module")
def texts(spark):
    """English texts that hold no benchmark item, and an item."""
    item = max((r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()), key=len)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang = 'en' AND n_chars > 800")
    keyed = docs.select("doc_id", "text").orderBy("doc_id")
    clean = decontaminate.without_benchmark(keyed, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    found = list(dict.fromkeys(r["text"] for r in clean.collect()))
    one = [d for d, _, label in brute(list(enumerate(found)), 5, 80) if d == label]
    return [found[d] for d in one], item


def odd_rows(texts):
    (a, b, c, *others), item = texts
    long = " ".join(others)
    long = " ".join([long] * (40_000 // len(long.split()) + 1))
    rows = [(1, a), (1, a), (2, a), (2, b), (3, None), (4, ""), (None, c), (5, long), (6, f"{c} {item}"), (None, None)]
    sources = ["x", "x", None, "y", "x", "y", None, "z", "x", "x"]
    return [
        (d, t, None if t is b else "en", source, None, *[d] * 7, t and t[:3])
        for (d, t), source in zip(rows, sources, strict=True)
    ]


def kept_by(stage, docs, folder):
    got = dict(corpus_pipeline.STAGES)[stage](docs.sparkSession, docs, folder)
    if stage != "mixing":
        assert got.columns == docs.columns
    return got.collect()


def test_stages_on_odd_rows(spark, texts):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing names, for each stage by itself."""
    rows = odd_rows(texts)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    key = lambda rows: sorted(((r[0], r[1]) for r in rows), key=str)
    assert key(kept_by("language_id", docs, FOLDER)) == key(r for r in rows if r[1])
    assert key(kept_by("near_duplicates", docs, FOLDER)) == key([rows[0], *rows[3:]])
    assert key(kept_by("decontamination", docs, FOLDER)) == key(r for r in rows if r[0] != 6)
    redacted = kept_by("pii", docs, FOLDER)
    assert key(redacted) == key((r[0], r[1] and pii.redact(r[1])) for r in rows)
    mixed = kept_by("mixing", docs, FOLDER)
    assert key(mixed) == key(rows)
    assert all(r["taken"] <= 2 * r["size"] and r["size"] == len((r["text"] or "").split()) for r in mixed)


def test_run_on_odd_rows_and_on_nothing(spark, texts, tmp_path):
    rows = odd_rows(texts)
    for name, given in (("odd", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(given, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder)
        assert set(SCHEMA.replace(",", "").split()[::2]) | {"size", "taken"} <= set(got.columns)
        left = {(r["doc_id"], r["text"]) for r in got.collect()}
        assert got.count() == len(left)
        assert left == {(given[i][0], pii.redact(given[i][1])) for i in (0, 3, 6, 7) if given}
