"""The other operators against plain Python, and on odd rows."""

import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from parcelwise.llm import (
    decontaminate, language_id, mixing, pii, quality_qda, quality_trees, suffix_dedup, tool_calls, toxicity,
)

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns with clashing names."""
    rows = [(None, None, None, None, 1), (1, "", "en", "s", 2), (1, "", "en", "s", 2), (2, None, "xx", "s", 3)]
    rows += [(3, "the cat of the house " * 40_000, "en", None, 4), (None, "the cat", None, "s", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long")


def empty(df):
    return df.where("false")


# -- mixing


def test_mix_reaches_small_sources(spark):
    """200 sources of 3 words, one each of 1 to 300 words, one of 20,000: all within a few words or a hundredth of their targets."""
    text = lambda n: " ".join(["w"] * n)
    rows = [(f"three{k:03d}", text(3)) for k in range(200)] + [(f"own{n:03d}", text(n)) for n in range(1, 301)]
    rows += [("large", text(200)) for _ in range(100)] + [(None, text(7)), ("empty", ""), ("empty", None)]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, source string, text string")
    taken, target = Counter(), {}
    for r in mixing.mix(docs.repartition(5)).collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(target) == 503 and target["empty"] == 0
    for name, goal in target.items():
        assert abs(taken[name] - goal) <= max(2, goal / 100), name
    assert abs(sum(taken.values()) - sum(target.values())) <= 0.01 * sum(target.values())


def test_mix_follows_targets(spark, docs):
    rows = mixing.mix(docs).select("source", "doc_id", "text", "size", "source_size", "target", "taken").collect()
    assert len(rows) == docs.count()
    taken, sizes = Counter(), Counter()
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"]))
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        sizes[r["source"]] += r["size"]
    names = sorted(sizes)
    left, goal, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    while open_:
        whole = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / whole > 2 * sizes[s]}
        for s in full or open_:
            goal[s] = 2.0 * sizes[s] if full else left * weight[s] / whole
        left -= sum(goal[s] for s in full)
        open_ = open_ - full if full else set()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], goal[r["source"]], rel_tol=1e-9)
    for s in names:
        assert abs(taken[s] - goal[s]) <= 2 * mixing.BLOCK_WORDS
    again = mixing.mix(docs.repartition(7)).select("doc_id", "taken").collect()
    assert sorted(again) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_sainte_lague_is_highest_quotients():
    rng = np.random.default_rng(3)
    for _ in range(50):
        votes = [float(v) for v in rng.integers(0, 1000, 7)]
        seats = int(rng.integers(0, 60))
        quotients = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v for k in range(seats)))[:seats]
        want = Counter(i for _, i in quotients)
        assert mixing.sainte_lague(votes, seats) == [want[i] for i in range(7)]


def test_mix_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 6 and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert [r["size"] for r in rows if r["doc_id"] == 3] == [200_000]
    assert mixing.mix(empty(odd)).collect() == []


# -- personal data


def plain_spans(text):
    """The base as the patterns state it."""
    digits = lambda s: re.sub(r"[^0-9]", "", s)

    def luhn(s):
        total = 0
        for i, c in enumerate(reversed(s)):
            d = int(c) * (2 if i % 2 else 1)
            total += d - 9 if d > 9 else d
        return total % 10 == 0

    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in tests.items()}


def test_base_spans_are_the_patterns(docs):
    for (text,) in docs.select("text").collect():
        assert pii.found(text) == plain_spans(text)


def test_base_spans_on_random_text():
    rng = np.random.default_rng(5)
    pieces = list("0123456789.@+-() aZ_%é\n") + ["a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (988) 555-2485", "@x.y@z.w"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces, rng.integers(0, 40)))
        assert pii.found(text) == plain_spans(text), text


def test_disguises_map_back():
    text = "é joe [at] mail [dot] org, ann at foo dot org; ｊｏｅ＠ｘ．ｃｏｍ plus one five five five one two three four five six"
    base, every = pii.all_spans(text)
    assert not any(base.values())
    assert [text[a:b] for a, b in every["email"]] == ["joe [at] mail [dot] org", "ann at foo dot org", "ｊｏｅ＠ｘ．ｃｏｍ"]
    assert [text[a:b] for a, b in every["phone"]] == ["plus one five five five one two three four five six"]
    clean = "We met at noon. One of the two was at home, three at sea. Dot your i at example.com."
    assert not any(pii.all_spans(clean)[1].values())


def test_spoken_addresses_without_an_at():
    for text in (
        "host 192 dot 168 dot 10 dot 1 is up",
        "host one nine two dot one six eight dot one zero dot one is up",
        "host 192 punkt one six eight PUNTO 10 point one is up",
        "host 192.168.one.1 is up",
        "host one nine two dot 168 dot one zero dot 1 is up",
    ):
        base, every = pii.all_spans(text)
        assert not any(base.values())
        assert [text[a:b] for a, b in every["ip"]] == [text[5:-6]], text
        assert pii.redact(text) == "host [IP] is up"
    for clean in ("It is 3 dot 5 of 7 dot 9.", "The dot one sees on page two is 300 dot 1 dot 1 dot 1.", "One point two is ten. No one.", "Zone.one.two"):
        assert not any(pii.all_spans(clean)[1].values())


def test_disguises_beside_plain_data():
    """What is found behind a disguise may reach beyond a base span, which stays."""
    cases = {
        "Ask john dot smith@example.com now": ("email", "smith@example.com", "john dot smith@example.com", "Ask [EMAIL] now"),
        "Call +49 171 5551 two three four five now": ("phone", "+49 171 5551", "+49 171 5551 two three four five", "Call [PHONE] now"),
        "Ask joe at x dot y@example.com now": ("email", "y@example.com", "joe at x dot y", "Ask [EMAIL] now"),
    }
    for text, (kind, plain, whole, red) in cases.items():
        base, every = pii.all_spans(text)
        assert [text[a:b] for a, b in base[kind]] == [plain]
        assert {text[a:b] for a, b in every[kind]} == {plain, whole}
        assert pii.redact(text) == red
    plain = "Ask john.smith@example.com, +49 171 5551234 or 10.0.0.1 at noon, one of two."
    assert pii.all_spans(plain)[0] == pii.all_spans(plain)[1] == pii.found(plain)


def test_personal_data_odd_rows(odd, docs):
    rows = pii.personal_data(odd).collect()
    assert len(rows) == 6 and all(r["n_email"] == 0 and r["spans"] == "" for r in rows)
    assert pii.personal_data(empty(odd)).collect() == []
    red = pii.redacted(docs)
    assert red.schema == docs.schema
    for r in red.collect():
        assert not any(pii.found(r["text"])[k] for k in ("email", "ip", "phone"))
        assert r["n_chars"] == len(r["text"])


# -- decontamination


def test_items_are_found(spark):
    item = "Ann Lee has 12 apples and buys 7 more for 3 euros, how many apples does the girl have now in her 12 bags?"
    swap = "So Ann Lee has 40 apples and buys 9 more for 5 euros, how many apples does the girl have now in her 40 bags?"
    wrong = "So Ann Lee has 40 apples and buys 9 more for 5 euros, how many apples does the girl have now in her 41 bags?"
    rows = [(1, f"x y. {item} z"), (2, f"Intro {swap} end"), (3, wrong), (4, item.upper()), (5, "nothing here"), (6, None), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (8, None), (7, ""), (None, item), (6, "too short")], "item_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["reparameterised"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert {k: got[k] for k in (1, 2, None)} == {1: (9, False), 2: (9, True), None: (9, False)}
    assert 5 not in got and 6 not in got
    left = decontaminate.without_benchmark(docs, items).collect()
    assert {5, 6} <= {r["doc_id"] for r in left} and {1, 2, None}.isdisjoint({r["doc_id"] for r in left})
    assert decontaminate.contaminated(empty(docs), items).collect() == []
    assert decontaminate.contaminated(docs, empty(items)).collect() == []


def test_items_with_other_names_at_sentence_starts(spark):
    item = "Tom has 12 red apples in one bag. Tom gives 5 of them to a friend. Tom then eats 2 of the rest. How many does he have?"
    other = item.replace("Tom", "Maria").replace("12", "31").replace("5", "9").replace("2 of", "4 of")
    mixed = other.replace("Maria then", "Carla then")
    rows = [(1, other), (2, f"A question: {other} Good luck"), (3, mixed), (4, item), (5, item.replace("Tom has", "So Tom has"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contaminated(docs, items).collect()}
    assert set(got) == {1, 2, 4, 5}
    assert {d: r["reparameterised"] for d, r in got.items()} == {1: True, 2: True, 4: False, 5: False}
    assert all(r["n_windows"] == r["n_matched"] == 21 for r in got.values())


def test_items_of_numbers_are_found_word_for_word(spark):
    sums = "Compute 12 + 34 - 56 * 78 + 90 - 11 exactly"
    table = "Ann Bea Cid Dan 11 12 13 14 15 16 17 18 19 20 21 22 make up the long list of all our numbers"
    rows = [(1, f"Now then, please. {sums}. Thanks"), (2, sums.replace("56", "57")), (3, f"so {table} end"), (4, "12 34 56 78 90 11 " * 9)]
    rows += [(5, table.replace("1", "3"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, sums), (8, table)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, items).collect()}
    assert set(got) == {(1, 7), (3, 8), (5, 8)}
    assert got[1, 7]["coverage"] == 1.0 and not got[1, 7]["reparameterised"]
    assert got[3, 8]["n_windows"] == got[3, 8]["n_matched"] == 18 and got[5, 8]["reparameterised"]


def test_sample_items_are_found(spark, docs):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    words = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    texts = {r["doc_id"]: f" {words(r['text'])} " for r in docs.collect()}
    want = {(d, i["item_id"]) for i in items.collect() for d, t in texts.items() if f" {words(i['text'])} " in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert want and got == want


# -- repeated passages


def test_passages(spark):
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    shared, short = word(90), word(40)
    rows = {i: word(120) for i in range(60)}
    for i in range(0, 30, 3):
        rows[i][10 + i : 10 + i] = shared
    for i in range(1, 30, 3):
        rows[i][20:20] = short
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()] + [(70, None), (71, ""), (None, "a")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in suffix_dedup.repeated_passages(docs).collect()}
    assert got == {i: [[10 + i, 100 + i]] for i in range(0, 30, 3)}
    assert suffix_dedup.repeated_passages(empty(docs)).collect() == []


def test_passages_hold_elsewhere(docs):
    """Every reported span stands in another document, and every copied document is reported."""
    texts = {r["doc_id"]: WORD.findall(r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: r["spans"] for r in suffix_dedup.repeated_passages(docs).collect()}
    places = {}
    for d, w in texts.items():
        for i in range(len(w) - 49):
            places.setdefault(tuple(w[i : i + 50]), set()).add(d)
    for d, spans in got.items():
        for a, b in spans:
            assert b - a >= 50 and any(len(places[tuple(texts[d][i : i + 50])]) > 1 for i in range(a, b - 49))
    copies = Counter(tuple(w) for w in texts.values() if len(w) >= 80)
    assert all(got[d][0][0] <= suffix_dedup.WINDOW for d, w in texts.items() if copies[tuple(w)] > 1)


def brute_passages(texts, width=50):
    """Union of all runs of ``width`` words that stand in another document, by trying every one."""
    places = {}
    for d, w in texts.items():
        for i in range(len(w) - width + 1):
            places.setdefault(tuple(w[i : i + width]), set()).add(d)
    out = {}
    for d, w in texts.items():
        for i in range(len(w) - width + 1):
            if len(places[tuple(w[i : i + width])]) > 1:
                spans = out.setdefault(d, [])
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + width
                else:
                    spans.append([i, i + width])
    return out


def test_passages_among_partial_sharers(spark):
    """Short shared passages of which many other documents hold parts below the least length."""
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    texts = {}
    for n in range(50, 84, 3):
        shared, at = word(n), len(texts)
        texts[at], texts[at + 99] = word(30) + shared + word(30), word(41) + shared + word(7)
        for k in range(1, 99):
            i = int(rng.integers(0, n - 47))
            texts[at + k] = word(25) + shared[i : i + 48] + word(25)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r["spans"] for r in suffix_dedup.repeated_passages(docs).collect()}
    want = brute_passages(texts)
    assert len(want) == 24 and got == want


def test_passages_of_sample_equal_brute_force(docs):
    texts = {r["doc_id"]: WORD.findall(r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: r["spans"] for r in suffix_dedup.repeated_passages(docs).collect()}
    assert got == brute_passages(texts)


def test_every_place_of_a_passage(spark):
    """A passage that a document holds twice, and one behind a header that stands there before other words."""
    rng = np.random.default_rng(10)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    shared, header, rest = word(60), word(40), word(14)
    texts = {
        1: word(30) + shared + word(50) + shared + word(9),
        2: word(5) + shared + word(5),
        3: header + word(40) + header + rest + word(20),
        4: word(33) + header + rest,
        5: shared * 3,
        6: word(49),
    }
    rows = [(d, " ".join(w)) for d, w in texts.items()]
    docs = spark.createDataFrame([*rows, rows[1], (6, " ".join(word(70)))], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in suffix_dedup.repeated_passages(docs).collect()}
    assert got[1] == [[30, 90], [140, 200]] and got[3] == [[80, 134]]
    assert got == brute_passages(texts)
    words = {r["doc_id"]: r["repeated_words"] for r in suffix_dedup.passage_report(docs).collect()}
    assert words == {1: 120, 2: 60, 3: 54, 4: 54, 5: 180}


# -- quality and toxicity


def test_quality_rules(docs, labels, odd):
    trees = quality_trees.train(docs, labels)
    rows = quality_trees.judge(docs, trees).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == 1000
    for r in rows:
        text, w = r["text"], WORD.findall(r["text"])
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeat = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(repeat) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    judged = [(r["kept"], quality[r["doc_id"]]) for r in rows if r["doc_id"] in quality and not r["base_failed"]]
    assert sum(k == bool(q) for k, q in judged) / len(judged) > 0.95
    assert len(quality_trees.judge(odd, trees).collect()) == 6
    assert quality_trees.judge(odd, quality_trees.train(empty(docs), labels)).count() == 6


def test_trees_are_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) - x[:, 2] + rng.normal(size=3000) > 0).astype(float)
    trees = quality_trees.fit(x, y, np.array([1, 0, -1]))
    assert ((trees.score(x) > 0.5) == y).mean() > 0.75
    for k, sign in ((0, 1), (2, -1)):
        moved = x.copy()
        moved[:, k] += 0.7
        assert (sign * (trees.log_odds(moved) - trees.log_odds(x)) >= -1e-9).all()


def held_out(rows, truth, fold, n):
    rows = [r for r in rows if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % n == fold for r in rows)
    known = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth]
    return sum(p == t for p, t in known) / len(known)


def test_quality_classifier(docs, labels, odd):
    model = quality_qda.train(docs, labels)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality_qda.classify(docs, model).collect()
    assert held_out(rows, truth, 0, 5) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    assert len(quality_qda.classify(odd, model).collect()) == 6
    assert quality_qda.classify(odd, quality_qda.train(docs, empty(labels))).count() == 6


def test_toxicity(docs, labels, odd):
    model = toxicity.train(docs, labels)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.classify(docs, model).collect()
    assert held_out(rows, truth, 2, 4) > 0.9 and all(0 <= r["score"] <= 1 for r in rows)
    assert len(toxicity.classify(odd, model).collect()) == 6
    assert toxicity.classify(odd, toxicity.train(docs, empty(labels))).count() == 6


# -- language


def test_languages(spark, docs, odd):
    got = {r["doc_id"]: r for r in language_id.document_languages(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert sum(got[d]["language"] == t for d, t in truth.items()) > 0.98 * len(truth)
    assert sum(r["accepted"] for r in got.values()) > 0.99 * len(truth)
    rows = language_id.with_known_language(odd).collect()
    assert all(r["text"] for r in rows)
    assert language_id.document_languages(empty(odd)).collect() == []


def test_evidence_beyond_text(spark):
    rows = [(i, "the house of the man and the sea", "en", "uk", "a.example.uk") for i in range(30)]
    rows += [(100 + i, "der mann und das haus an der see", "de", "de", "b.example.de") for i in range(30)]
    rows += [(200, "x", "de", "de", "b.example.de"), (201, "x", None, "uk", "a.example.uk"), (202, None, None, None, None)]
    table = spark.createDataFrame(rows, "k long, text string, declared string, suffix string, host string")
    model = language_id.text_model(table)
    got = {r["k"]: r for r in language_id.identify(table, ["k"], model).collect()}
    assert got[200]["language"] == "de" and got[201]["language"] == "en"
    assert not got[202]["accepted"] and got[0]["accepted"]


# -- tool calls


def test_tool_calls(spark):
    call = lambda i, args, name="search": {"id": i, "name": name, "arguments": args}
    said = lambda *calls: json.dumps({"tool_calls": list(calls)})
    answer = lambda i: json.dumps({"tool_call_id": i, "content": f"r {i}"})
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", said(call("b", {"query": "$ref:a", "limit": 2}), call("a", {"limit": 1, "query": "x"}))),
        (1, 2, "tool", answer("a")), (1, 3, "tool", answer("b")), (1, 4, "tool", answer("nobody")),
        (1, 5, "assistant", said(call("c", {"query": 5}), call("d", {"query": "q", "limit": 1, "odd": 1}), call("e", {}, "none"))),
        (2, 0, "assistant", said(call("x", {"query": "$ref:y", "limit": 1}), call("y", {"query": "$ref:x", "limit": 1}))),
        (2, 1, "assistant", "{broken tool_calls"), (None, 0, "user", "a"), (3, 0, None, None),
    ]
    got = tool_calls.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tool_calls.SEARCH).collect()
    calls = {r["call_id"]: r for r in got if r["kind"] == "call"}
    assert (calls["a"]["depth"], calls["b"]["depth"], calls["x"]["depth"]) == (0, 1, None)
    assert {k: calls[k]["status"] for k in ("a", "b", "c", "nobody")} == {"a": "linked", "b": "linked", "c": "unanswered", "nobody": "orphan"}
    assert calls["a"]["problems"] == "" and calls["e"]["problems"] == "unknown tool"
    assert calls["c"]["problems"] == "missing limit; query is no string" and calls["d"]["problems"] == "unknown odd"
    want = {"arguments": {"limit": 1, "query": "x"}, "id": "a", "name": "search", "result": "r a"}
    assert calls["a"]["json"] == json.dumps(want, sort_keys=True, separators=(",", ":"))
    assert sum(r["kind"] == "message" for r in got) == 9


def test_conversations_as_tool_chat(spark):
    table = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    got = tool_calls.formatted(tool_calls.as_tool_chat(table), tool_calls.SEARCH).collect()
    n_user = table.where("role = 'user'").count()
    calls = [r for r in got if r["kind"] == "call" and r["status"] != "orphan"]
    assert len(calls) == n_user and len(got) >= table.count() + n_user
    assert all(json.loads(r["json"]) is not None for r in got)
    assert any("missing limit" in r["problems"] for r in calls) and any("limit is no integer" in r["problems"] for r in calls)
