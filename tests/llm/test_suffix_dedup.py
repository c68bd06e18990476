import numpy as np
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F
from test_operators import brute_passages

from parcelwise.llm import ngram_join, suffix_dedup
from parcelwise.llm import queries as corpus

FOLDER = "/root/testdata/sf0.001"


def words(rng, n, of=10**6):
    return [f"w{i}" for i in rng.integers(0, of, n)]


def spans(docs):
    return {r["doc_id"]: r["spans"] for r in suffix_dedup.repeated_passages(docs).collect()}


def table(spark, texts):
    return spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")


def edited_copies(seed):
    """Copies of a few texts with words changed, left out or said twice, cut at both ends."""
    rng = np.random.default_rng(seed)
    bases = [words(rng, n, 300) for n in (60, 90, 150, 400)]
    texts = {}
    for d in range(90):
        copy = list(bases[0 if d % 3 == 0 else rng.integers(4)])
        for _ in range(rng.integers(0, 4)):
            at = int(rng.integers(len(copy)))
            copy[at : at + 1] = [words(rng, 1), [], [copy[at]] * 2][rng.integers(3)]
        a, b = rng.integers(0, 12, 2)
        texts[d] = words(rng, rng.integers(0, 9)) + copy[a : len(copy) - b] + words(rng, rng.integers(0, 9))
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_edited_copies_equal_brute_force(spark, conf, seed):
    conf("spark.sql.shuffle.partitions", "5")  # ranges end between neighbours too
    texts = edited_copies(seed)
    assert spans(table(spark, texts).repartition(4)) == brute_passages(texts)


def suffix(doc, lead, behind, code=1):
    return suffix_dedup._Suffix((code, doc, doc, doc, lead, behind))


def test_neighbours_extend_both_ways():
    a = suffix(1, list(range(40)) + [7], [100, 101, 102, 103, 104, 105, 106, 107, 108, 109, 110])
    b = suffix(2, list(range(40)) + [8, 9], [100, 101, 102, 103, 104, 105, 106, 107, 108, 109])
    a.extend(b)
    assert (a.start, a.end) == (1, 51) and (b.start, b.end) == (0, 50)
    c = suffix(3, list(range(39)), [100] + list(range(101, 110)))
    c.extend(a)
    assert c.end == 0 and (a.start, a.end) == (1, 51)  # 49 words are too few
    d = suffix(4, list(range(40)), list(range(100, 110)), code=2)
    d.extend(b)
    assert d.end == 0


def test_sorted_suffixes_find_what_neighbours_share(spark):
    """Of three texts with one passage, each with other words around it, neighbours alone give the whole of it."""
    rng = np.random.default_rng(3)
    shared = words(rng, 70)
    docs = table(spark, {d: words(rng, 30) + shared + words(rng, 30) for d in (5, 6, 7)})
    every = docs.mapInArrow(suffix_dedup._stretch_rows, suffix_dedup._STRETCH)
    classes = every.groupBy("code", "context").agg(
        *(F.expr(e) for e in (
            "min(words) AS words", "min(doc_id) AS low", "max(doc_id) AS high",
            "min(struct(doc_id, get(starts, 0) AS start)) AS first",
        ))
    )
    again = every.groupBy("code").agg(F.expr("min(doc_id) != max(doc_id) AS many")).where("many").select("code")
    rows = suffix_dedup._sorted_suffixes(docs, classes.join(again, "code")).where("to > 0").collect()
    assert rows and {r["low"] for r in rows} <= {5, 6, 7}
    for r in rows:
        assert r["to"] - r["from"] >= 50 and r["to"] <= len(r["lead"]) + len(r["behind"])
    assert spans(docs) == {d: [[30, 100]] for d in (5, 6, 7)}


def test_odd_rows(spark):
    """Nulls, a very long text, repeated rows and columns whose names the operator uses itself."""
    rng = np.random.default_rng(4)
    long, shared = words(rng, 60_000, 900), words(rng, 55)
    texts = {1: long[:40_000] + shared + long[40_000:], 2: words(rng, 3) + shared, 3: words(rng, 80), 4: words(rng, 49)}
    rows = [(d, " ".join(w), 0, "x", 9) for d, w in texts.items()]
    rows += [rows[1], (None, rows[1][1], 1, None, 2), (8, None, 0, None, None), (9, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, code int, spans string, words int")
    assert spans(docs) == brute_passages(texts) and set(spans(docs)) == {1, 2}


def test_queries_equal_their_sql(spark):
    con = connect(FOLDER)
    assert compare(corpus.op8_suffix_dedup(spark, FOLDER), con, suffix_dedup.ORACLE_SQL) is None
    assert compare(corpus.op4_ngram_jaccard_join(spark, FOLDER), con, ngram_join.ORACLE_SQL) is None


def test_sql_on_odd_rows(spark, tmp_path):
    texts = {d: " ".join(w).upper() if d % 2 else " ".join(w) for d, w in edited_copies(7).items()}
    rows = [*texts.items(), (4, texts[4]), (90, None), (91, ""), (92, "a b"), (93, "A  b\n"), (None, texts[3]), (94, " \t")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    folder = str(tmp_path)
    con = connect(FOLDER)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    assert compare(corpus.op8_suffix_dedup(spark, folder), con, suffix_dedup.ORACLE_SQL) is None
    assert compare(corpus.op4_ngram_jaccard_join(spark, folder), con, ngram_join.ORACLE_SQL) is None
