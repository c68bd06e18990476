"""Token alignment, filter audit and page templates against brute force, and on odd rows."""

import hashlib
import html as entities
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from oracle_check import compare, connect
from tokenizers import Tokenizer

from parcelwise.llm import filter_audit, page_templates, token_alignment
from parcelwise.llm import queries as corpus

FOLDER = "/root/testdata/sf0.001"
BLANK = re.compile(r"[\x20\x09-\x0D]+")


# -- filter audit


def audit_by_hand(docs, labels):
    known = defaultdict(lambda: [0, 0])
    for d, quality, toxic in labels:
        if d is not None:
            known[d] = [max(known[d][0], int(quality == 1)), max(known[d][1], int(toxic == 1))]
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    rows = defaultdict(list)
    for d, text, source in docs:
        text = text or ""
        words = [w for w in BLANK.split(text) if w]
        failed = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
        failed += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        failed += "E" * (d is not None and d > first[text])
        rows[source or ""].append((failed, *(known[d] if d is not None else (0, 0))))
    out = {}
    for part, own in rows.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[0]]
                left = [r for r in left if letter not in r[0]]
                shapley[letter] += len(gone)
                out[part, order, step] = (
                    len(left),
                    len(gone),
                    sum(letter in r[0] for r in own) - len(gone),
                    sum(r[0] == letter for r in own),
                    sum(r[1] for r in gone),
                    sum(r[2] for r in gone),
                )
        for (p, order, step), row in out.items():
            if p == part and len(row) == 6:
                out[p, order, step] = (*row, shapley[order[step - 1]])
    return out


def audited(df):
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in df.collect()}


def random_documents(n, seed):
    r = random.Random(seed)
    bodies = [None, "", "A B", "word " * 60, "x # y", " ".join(f"w{i}" for i in range(70)), "SHOUT " * 80, "é" * 40 + " |"]
    bodies += [" ".join(r.choice("abcdefghij") + str(r.randrange(40)) for _ in range(r.randrange(120))) for _ in range(12)]
    ids = [None, *range(n)]
    docs = [(r.choice(ids), r.choice(bodies), r.choice([None, "", "web", "web", "web", "books"])) for _ in range(n)]
    labels = [(r.choice(ids), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(n)]
    return docs, labels


def test_audit_equals_brute_force(spark):
    docs, labels = random_documents(400, 5)
    got = audited(
        filter_audit.audit(
            spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, part int, mask int"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        )
    )
    assert got == audit_by_hand(docs, labels)


def test_audit_equals_its_sql(spark):
    assert compare(corpus.op12_filter_audit(spark, FOLDER), connect(FOLDER), filter_audit.ORACLE_SQL) is None


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert not audited(filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))


@pytest.mark.parametrize("seed", range(40))
def test_posting_lists(seed):
    r = random.Random(seed)
    lists = [sorted(r.sample(range(60), r.randrange(40))) for _ in range(r.randrange(1, 6))]
    assert filter_audit.union(lists) == sorted(set().union(*lists))
    assert filter_audit.difference(lists[0], lists[-1]) == sorted(set(lists[0]) - set(lists[-1]))
    for target in range(62):
        assert filter_audit.gallop(lists[0], 0, target) == sum(x < target for x in lists[0])


# -- token alignment


ODD_TEXTS = [
    None, "", " ", "\n", " two  spaces ", "a  b c\n d", "tab\tand   blank", "<|endoftext|> <s> </s> <0x41>", "é ́x ﬁ 𝔘 \U0001f600",
    "▁marked a▁b", "it's they're 12,000.50 x_y", "\x00 nul", "long " * 3000, "long " * 3000, "x" * 3000,
]


def aligned_by_hand(texts):
    """Tokens of whole texts; every pair of tokens is compared."""
    pair = token_alignment._pair(token_alignment.TOKENIZERS)
    whole = Tokenizer.from_file(f"{token_alignment.TOKENIZERS}/{token_alignment.BYTE_LEVEL}")
    whole.encode_special_tokens = True
    found, counts = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        sides = []
        for ids, spelled in (
            (whole.encode(" " + (text or ""), add_special_tokens=False).ids, pair.bytes_a),
            (pair.b.encode(text or ""), pair.bytes_b),
        ):
            ends = np.cumsum([len(spelled[i]) for i in ids]).tolist()
            sides.append([(s, e, i) for s, e, i in zip([0, *ends], ends, ids)])
            if not text or b"".join(spelled[i] for i in ids) != raw:
                sides = None
                break
        if sides is None:
            found.append(None)
            continue
        a, b = sides
        links, low = [], 0
        for s, e, i in a:
            while b[low][1] <= s:
                low += 1
            at = low
            while at < len(b) and b[at][0] < e:
                links.append((i, b[at][2]))
                at += 1
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        spell = lambda side, lo, hi: ",".join(str(i) for _, e, i in side if lo < e <= hi)
        groups = [f"{spell(a, lo, hi)}|{spell(b, lo, hi)}" for lo, hi in zip([0, *cuts], cuts)] if len(a) < 2000 else None
        found.append((len(a), len(b), len(cuts), links, groups))
        counts.update(links)
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for x in found:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, groups = x
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else None
        n_best = sum(counts[k] == best[k[1]] for k in links)
        out.append((n_a, n_b, n_groups, len(links), n_best, sum(counts[k] for k in links), sha))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("max_pairs", [token_alignment.MAX_PAIRS, 0])
def test_alignment_equals_brute_force(spark, max_pairs):
    texts = ODD_TEXTS + [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(30).collect()]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, row int, pairs string")
    rows = {r["doc_id"]: r for r in token_alignment.aligned(docs, max_pairs=max_pairs).collect()}
    assert len(rows) == len(texts)
    for k, want in enumerate(aligned_by_hand(texts)):
        got = tuple(rows[k][c] for c in COLUMNS)
        assert got[:6] == want[:6], texts[k]
        assert want[6] is None or got[6] == want[6]
        if want[0]:
            groups = [g.split("|") for g in rows[k]["groups"].split(";")]
            assert sum(len(a.split(",")) * len(b.split(",")) for a, b in groups) == rows[k]["n_group_links"]


def test_alignment_of_nothing_and_of_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r["n_a"] for r in token_alignment.aligned(docs).collect()) == [0, 2]
    assert not token_alignment.aligned(docs.where("false")).collect()
    assert {r["n"] for r in token_alignment.pair_counts(docs).collect()} == {1}


@pytest.mark.parametrize("seed", range(20))
def test_gustavson_product(seed):
    r = np.random.default_rng(seed)
    dense = [r.integers(0, 2, shape) for shape in ((7, 9), (9, 5))]
    a, b = (
        token_alignment.Csr(np.concatenate([[0], np.cumsum(d.sum(1))]), np.nonzero(d)[1], d.shape[1]) for d in dense
    )
    got = token_alignment.product(a, b)
    out = np.zeros((7, 5), int)
    out[got.rows, got.indices] = got.values
    assert (out == dense[0] @ dense[1]).all()
    assert (np.diff(b.transposed().indptr) == dense[1].sum(0)).all()


# -- page templates


def page(body, k=0):
    return f"<!DOCTYPE html><html><head><title>t{k}</title><script>var t='</p>'</script></head><body>{body}</body></html>"


def test_pages_equal_their_articles(spark):
    """The pages there have one article each; its text by an independent reading of the markup."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in corpus.op13_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = " ".join(entities.unescape(re.sub(r"<[^>]+>", "\n", article)).split())
        assert (got[r["page_id"]]["url"], got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (r["url"], want, len(want))


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("<div", ""),
        ("a < b <3 x<p>c", "a < b <3 x c"),
        ("<p>a<b>b</b>c<br>d<p>e &lt;x&gt; &amp; &copy f", "abc d e <x> & © f"),
        ("<article><h1>T</h1><div class='post-comments'><p>no</p></div><p>yes<span class=ad>no</span> it</article><p>out", "T yes it"),
        ("<nav>n</nav><div id=main><header>h</header><p>t</div><aside>s</aside><form>f</form><footer>f</footer>", "t"),
        ("<article><header><h1>T</h1></header>x<footer>by</footer></article>", "T x"),
        ("<ul><li>a<li>b</ul>c</p>d", "a b c d"),
        ("<table><tr><td>1<td>2</table>y", "1 2 y"),
        ("<!-- x -->y<!-- z", "y"),
        ("<div class=cookie-notice>c</div><div role=navigation>n</div><p hidden>h</p>t", "t"),
        ("<a href=\"x>l</a>m", "lm"),
    ],
)
def test_main_text(html, text):
    assert page_templates.main_text(html)[0] == text


def test_template_is_deduced_from_the_host(spark):
    """A constant notice in an unnamed box is template; words that only some pages share are not."""
    r = random.Random(3)
    words = lambda n: " ".join(r.choice("abcdefghij") + str(r.randrange(1000)) for _ in range(n))
    rows, want = [], {}
    for k in range(24):
        host = "https://www.one.example/" if k < 12 else "http://two.example:80/"
        if k == 23:
            host = "//lone.example/"
        paragraphs = [words(8) for _ in range(k % 3 + 1)]
        body = f"<div class=x><h1>{words(3)}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div>"
        notice = "<div><p>Read our terms before you copy anything.</p></div>" if k < 12 or k == 23 else ""
        rows.append((k, host + str(k), page(body + notice, k)))
        title = re.search("<h1>(.*)</h1>", body)[1]
        want[k] = " ".join([title, *paragraphs] + (["Read our terms before you copy anything."] if k == 23 else []))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in page_templates.extracted(pages).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_template_blocks"] == (k < 12) for k, r in got.items())


def test_copies_keep_their_article(spark):
    rows = [(k, "http://one.example/a", page("<article><p>the same words on all pages</p></article>")) for k in range(15)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, token int")
    assert {r["text"] for r in page_templates.extracted(pages).collect()} == {"the same words on all pages"}


def test_classes_are_occurrence_vectors(spark):
    """Classes of two hosts against vectors that are spelled out."""
    r = random.Random(9)
    rows = []
    for k in range(40):
        boxes = "".join(f"<section><h2>s{r.randrange(5)}</h2></section>" for _ in range(r.randrange(3)))
        rows.append(("one" if k % 3 else "two", page(f"<div><b>Fixed words</b><p>w{r.randrange(9)}</p></div>{boxes}", k)))
    found = page_templates.equivalence_classes(spark.createDataFrame(rows, "host string, html string"), 10).collect()
    for host in ("one", "two"):
        pages = [page_templates.page_tokens(page_templates.parse(h))[0].tolist() for h_, h in rows if h_ == host]
        vectors = {t: tuple(p.count(t) for p in pages) for p in pages for t in p}
        got = defaultdict(set)
        for row in found:
            if row["host"] == host:
                got[row["class"]].add(int(np.int64(row["token"]).view(np.uint64)))
        for tokens in got.values():
            of = {vectors[t] for t in tokens}
            assert len(of) == 1 and tokens == {t for t, v in vectors.items() if v in of}
        assert len(got) >= 1


def test_order_and_nesting():
    tokens = np.array([1, 2, 3, 4, 5, 4, 5, 6], np.uint64)
    classes = {1: 7, 2: 7, 6: 7, 4: 8, 5: 8, 3: 9}
    signs = page_templates.class_orders(tokens, classes, 7)
    assert all(signs.values())
    assert page_templates.class_orders(tokens[::-1].copy(), classes, 7)[8] not in (0, signs[8])
    crossed = np.array([1, 4, 2, 5, 4, 5, 6], np.uint64)
    assert page_templates.class_orders(crossed, classes, 7)[8] == 0


def test_pages_odd_rows(spark):
    rows = [(None, None, None), (1, "", ""), (1, "", ""), (2, "http://x.example/", "<p>" + "long words " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in page_templates.extracted(pages).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 2_199_999)]
    assert not page_templates.extracted(pages.where("false")).collect()
