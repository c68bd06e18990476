import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.llm import graph, ngram_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width, percent):
    """Components by comparing every pair of sets."""
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[doc_id] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, len(sets[d]), find(d)) for d in sets)


def corpus(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    line = rng.choice(vocabulary, 12).tolist()
    bases = [rng.choice(vocabulary, rng.integers(1, 160)).tolist() for _ in range(40)]
    rows = []
    for i in range(260):
        words = list(bases[0] if i % 3 == 0 else bases[rng.integers(len(bases))])
        for _ in range(int(rng.integers(0, 5)) * (rng.random() < 0.7)):
            words[int(rng.integers(len(words)))] = str(rng.choice(vocabulary))
        if rng.random() < 0.3:
            words += line
        rows.append((i, " ".join(words).upper() if rng.random() < 0.1 else "\t".join(words)))
    return rows + [(900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "one two"), (905, "one")]


@pytest.mark.parametrize(("width", "percent", "seed"), [(4, 85, 1), (5, 80, 2)])
def test_equals_brute_force(spark, width, percent, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.near_duplicates(docs, width, percent).collect()
    assert sorted(map(tuple, got)) == brute(rows, width, percent)


def test_sample_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = ngram_join.near_duplicates(docs, 4, 85).collect()
    assert sorted(map(tuple, got)) == brute([tuple(r) for r in docs.collect()], 4, 85)


def test_odd_rows(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(None, text, 1), (5, text, 2), (5, text, 3), (3, text + " x", 4), (7, None, 5), (8, "é" * 50_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set_id long")
    got = sorted(map(tuple, ngram_join.near_duplicates(docs, 4, 85).collect()), key=str)
    assert got == sorted([(None, 27, None), (5, 27, 3), (5, 27, 3), (3, 28, 3), (7, 0, 7), (8, 1, 8)], key=str)
    assert ngram_join.near_duplicates(docs.limit(0), 4, 85).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 201), (201, 200), (5, 5)] + [(500, 500 + i) for i in range(1, 40)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {200: 200, 201: 200} | {500 + i: 500 for i in range(40)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_stop_at_stars(spark, monkeypatch):
    """No round is made that changes nothing, nor one for no more links."""
    written = []
    monkeypatch.setattr(graph, "kept", lambda df, label: written.append(label) or df.localCheckpoint())
    stars = graph.components(spark.createDataFrame([(5, 1), (1, 7), (9, 2), (5, 1), (None, 3), (4, 4)], "a long, b long"))
    assert sorted(map(tuple, stars.collect())) == [(1, 1), (2, 2), (5, 1), (7, 1), (9, 2)]
    assert len(written) == 1
    more = spark.createDataFrame([(7, 9), (11, 10)], "a long, b long")
    assert graph.extended(stars, more.limit(0)) is stars and len(written) == 1
    got = graph.extended(stars, more)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (5, 1), (7, 1), (9, 1), (10, 10), (11, 10)]


def test_rounds_send_nothing_through_the_driver(spark):
    edges = spark.createDataFrame([(3, 2), (2, 1), (5, 4)], "u long, v long")
    moved = graph._small_star(graph._large_star(edges))
    assert sorted(map(tuple, moved.collect())) == [(2, 1), (3, 1), (5, 4)]
    assert "Broadcast" not in moved._jdf.queryExecution().executedPlan().toString()


def near_threshold(seed):
    """One large group of copies with a few edits each, most pairs of which are close to the threshold."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(240):
        words = base[: int(rng.integers(70, 81))]
        for _ in range(int(rng.integers(1, 5))):
            words[int(rng.integers(len(words)))] = f"e{rng.integers(60)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_group_near_the_threshold_equals_brute_force(spark, seed):
    rows = near_threshold(seed)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    want = brute(rows, 4, 85)
    assert sorted(map(tuple, got)) == want
    assert 5 < len({c for _, _, c in want}) < 235


def test_sets_of_one_hash_are_told_apart(spark, monkeypatch):
    """With first hashes of one value in eight, so that most sets share theirs with others."""
    whole = ngram_join._set_id
    monkeypatch.setattr(ngram_join, "_set_id", lambda tokens: (whole(tokens)[0] % 8, whole(tokens)[1]))
    rows = corpus(3)[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members = docs.select("doc_id", "text").rdd.map(tuple).collect()
    classes = spark.createDataFrame(
        sorted({(*ngram_join._set_id(s), 0) for _, t in members if len(s := np.unique(ngram_join.W.shingle_windows(ngram_join.W.word_hashes(ngram_join.W.words(t, lower=True)), 4)))}),
        "set_id long, check long, first_id long",
    )
    names = ngram_join._renamed(classes)
    renamed = ngram_join._with_names(classes, names)
    assert len(names) > 20 and renamed.select("set_id").distinct().count() == classes.count()


def test_one_row_of_each_group_stays(spark):
    """Repeated ids with other texts, equal rows, rows without an id or text, and columns of clashing names."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (4, c), (4, d), (5, None), (5, None), (None, a), (6, ""), (7, c.upper()), (1, a)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, group_id string, row_key int")
    got = ngram_join.one_of_each_group(docs, 5, 80)
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (4, c), (4, d), (5, None), (5, None), (None, a), (6, "")], key=str)
    assert ngram_join.one_of_each_group(docs.where("false"), 5, 80).collect() == []


def test_tokens_are_shuffled_once(spark, conf):
    """Rows of shared tokens and the heads of buckets each came from a grouping and a join, two shuffles of all rows or three."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    held = [(1, [1, 2, 3]), (2, [2, 3, 4]), (3, [9]), (4, [1, 2, 9, 10])]
    rows = spark.createDataFrame([(t, s, 5) for s, tokens in held for t in tokens], "token long, set_id long, n int")
    shared = ngram_join._shared(rows.unionAll(rows.limit(4)))
    enough = ngram_join._enough(shared.distinct(), lambda n: n - 3)
    heads = ngram_join._head_pairs(rows.withColumn("part", F.col("set_id")).withColumn("held", F.lit(3)), 0)
    for df in (enough, heads):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(token") == 1 and "Join" not in plan
    assert sorted(map(tuple, enough.collect())) == [(1, 3), (2, 2), (4, 3)]
    assert sorted(map(tuple, shared.distinct().select("token").distinct().collect())) == [(1,), (2,), (3,), (9,)]
    parts = rows.withColumn("part", F.when(F.col("set_id") < 3, 1).otherwise(F.col("set_id")))
    assert sorted(map(tuple, ngram_join._shared(parts).select("token", "set_id").collect())) == [(1, 1), (1, 4), (2, 1), (2, 2), (2, 4), (9, 3), (9, 4)]
