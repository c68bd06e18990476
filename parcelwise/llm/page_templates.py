"""Main text of web pages by deducing the template that the pages of a host share.

A page is a sequence of tokens: start tags, told by their path, and words, told by word and path. Tokens that occur equally
often on every page of a host have one occurrence vector and form an equivalence class. Vectors are never
gathered: each is a sum of page hashes, mixed with the count on the page, so classes come from one grouped sum whatever the size of
a host. A class is valid if it holds a tag, enough pages have it, its tokens follow each other in one order on all of them, and
it nests in one gap of the class that every page has. Valid classes are the template; what stands
between their tokens are the slots. Of those, the slots of the article are kept.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import words as W
from parcelwise.llm.tables import kept

MIN_PAGES = 10  # of a host that a class must be on; fewer pages do not tell a template from articles that agree
MIN_TOKENS = 2  # of a class
BROADCAST_TOKENS = 500_000  # template tokens of all hosts, 16 bytes each, sent to all tasks; beyond it they are joined

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
NOT_TEXT = frozenset(
    "aside button canvas datalist dialog footer form frameset head iframe menu nav noframes noscript object select svg textarea "
    "title template".split()
)
CONTAINERS = frozenset("article main".split())
# What closes an open paragraph or an open element of the same kind.
_SAME = frozenset("li dt dd tr td th option p".split())
# Words in class, id and role that name parts around an article.
AROUND = frozenset(
    "ad ads adbox adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie "
    "cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup "
    "promo promotion promoted recommended related replies search share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription toolbar widget".split()
)
HEADERS = frozenset("header masthead".split())  # outside an article

_MARK = re.compile(
    r"<(?:!--.*?(?:-->|\Z)"
    r"|(script|style)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|/?[a-z!?][^>]*+(?:>|\Z))",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_ROLE = re.compile(r"class|id|role|hidden", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)", re.I)
_PARTS = re.compile(r"[a-z]+")

OUTSIDE, BODY, MAIN = range(3)
TOP = xxhash.xxh3_64_intdigest("")  # the path of a whole page

# Tokens in order: path, where its text belongs, and the words of a block, None for a start tag.
Page = list[tuple[int, int, list[str] | None]]


def _open(name: str, attributes: str, path: int, kind: int) -> tuple[int, int]:
    """The path of an element below another one, and where its text belongs."""
    step = name
    if attributes and _ROLE.search(attributes):
        names = []
        for what, value in _NAMED.findall(attributes):
            parts = _PARTS.findall(value.lower())
            names += parts
            if what.lower() == "class" and parts:
                step += "." + parts[0]
        if not AROUND.isdisjoint(names) or (kind != MAIN and not HEADERS.isdisjoint(names)) or _HIDDEN.search(attributes):
            kind = OUTSIDE
    if name in NOT_TEXT or (name == "header" and kind != MAIN):
        kind = OUTSIDE
    elif kind != OUTSIDE and name in CONTAINERS:
        kind = MAIN
    return xxhash.xxh3_64_intdigest(step, path), kind


def _closed(stack: list, name: str) -> int | None:
    """The depth of the element that an end tag closes; a paragraph's end tag closes no article."""
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth][0] == name:
            return depth
        if name == "p" and stack[depth][0] in CONTAINERS:
            return None
    return None


def parse(html: str | None) -> Page:
    """Tokens of a page of any shape: unknown, unclosed and stray tags do no harm."""
    page: Page = [(TOP, BODY, None)]
    text: list[str] = []
    stack: list[tuple[str, int, int]] = [("", TOP, BODY)]

    def end_block() -> None:
        words = "".join(map(entities.unescape, text)).split()
        text.clear()
        if words:
            page.append((stack[-1][1], stack[-1][2], words))

    html, at, inline_open = html or "", 0, 0
    for mark in _MARK.finditer(html):
        start, end = mark.span()
        if start > at:
            text.append(html[at:start])
        at = end
        _, closes, name, attributes = mark.groups()
        if not name:
            continue
        name = name.lower()
        if name in INLINE and not inline_open and (closes or not attributes):
            continue  # never pushed: it neither hides text nor ends a block
        if closes:
            depth = len(stack) - 1 if stack[-1][0] == name else _closed(stack, name)
            if depth or name not in INLINE:
                if text:
                    end_block()
            if depth:
                inline_open -= sum([s[0] in INLINE for s in stack[depth:]])
                del stack[depth:]
            continue
        inline = name in INLINE
        path, kind = _open(name, attributes, stack[-1][1], stack[-1][2])
        if inline and kind == stack[-1][2]:
            continue
        if text:
            end_block()
        if name in VOID:
            continue
        if not inline:  # a new block ends an open paragraph; an item ends the item before it
            for depth in range(len(stack) - 1, 0, -1):
                open_ = stack[depth][0]
                if open_ == "p" or (open_ == name and name in _SAME):
                    inline_open -= sum([s[0] in INLINE for s in stack[depth:]])
                    del stack[depth:]
                    path, kind = _open(name, attributes, stack[-1][1], stack[-1][2])
                    break
                if open_ not in INLINE:
                    break
        page.append((path, kind, None))
        stack.append((name, path, kind))
        inline_open += inline
    if at < len(html):
        text.append(html[at:])
    if text:
        end_block()
    return page


def word_tokens(path: int, words: list[str]) -> list[int]:
    digest = xxhash.xxh3_64_intdigest
    return [digest(w, path) for w in words]


def page_tokens(page: Page, paths: set[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All tokens in order, and which are tags; with ``paths`` only words on these."""
    tokens: list[int] = []
    tags: list[bool] = []
    for path, _, words in page:
        if words is None:
            tokens.append(path)
            tags.append(True)
        elif paths is None or path in paths:
            tokens += word_tokens(path, words)
            tags += [False] * len(words)
    return np.array(tokens, np.uint64), np.array(tags, bool)


_VECTORS = "host string, token long, path long, low long, high long, pages long, total long"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over each host's pages of a batch, for all tags and for words whose vector there is that of a tag."""
    for hosts, htmls in W.rows_of(batches, 512):
        by_host: dict[str, list[str | None]] = {}
        for host, html in zip(hosts, htmls, strict=True):
            by_host.setdefault(host, []).append(html)
        for host, pages in by_host.items():
            tokens, paths, owners = [], [], []
            for k, html in enumerate(pages):
                for path, _, words in parse(html):
                    own = [path] if words is None else word_tokens(path, words)
                    tokens += own
                    paths += [path] * len(own)
                    owners += [k] * len(own)
            tokens, paths, owners = np.array(tokens, np.uint64), np.array(paths, np.uint64), np.array(owners)
            tags = tokens == paths
            order = np.lexsort((owners, tokens))
            tokens, paths, tags, owners = (x[order] for x in (tokens, paths, tags, owners))
            cell = np.flatnonzero(np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])]))
            counts = np.diff(np.append(cell, len(tokens)))
            tokens, paths, tags, owners = (x[cell] for x in (tokens, paths, tags, owners))
            ids = np.array([xxhash.xxh3_64_intdigest(W.encoded(p)) for p in pages], np.uint64)
            mixed = W.mix(W.mix(ids)[owners] + counts.astype(np.uint64))
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            vector = np.add.reduceat(mixed, first)
            on, total, is_tag = (
                np.add.reduceat(x, first) for x in (np.ones(len(tokens), np.int64), counts, tags.astype(np.int64))
            )
            wanted = (is_tag > 0) | np.isin(vector, vector[is_tag > 0])
            n = int(wanted.sum())
            yield pa.record_batch(
                [
                    pa.array([host] * n, pa.string()),
                    pa.array(W.signed(tokens[first][wanted])),
                    pa.array(W.signed(paths[first][wanted])),
                    pa.array((vector[wanted] & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                    pa.array((vector[wanted] >> np.uint64(32)).astype(np.int64)),
                    pa.array(on[wanted]),
                    pa.array(total[wanted]),
                ],
                names=["host", "token", "path", "low", "high", "pages", "total"],
            )


def _host(url):
    """Lower-case host of a url without user, port or a leading ``www.``; '' where there is none."""
    found = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1)
    return F.coalesce(found, F.lit(""))


def equivalence_classes(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host``, ``class``, ``token``, ``path``, ``root``: tokens in classes with a tag, on enough pages.

    ``pages`` has ``host`` and ``html``. A tag's token is its path. A class is named by its occurrence vector; ``root`` is the class that every
    page of the host has once.
    """
    vectors = pages.select("host", "html").mapInArrow(_vectors, _VECTORS)
    vector = ["low", "high", "pages", "total"]
    summed = kept(
        vectors.groupBy("host", "token").agg(F.min("path").alias("path"), *(F.sum(c).alias(c) for c in vector)), "vectors"
    )
    tag, top = F.col("token") == F.col("path"), F.lit(int(np.uint64(TOP).astype(np.int64)))
    large = (
        summed.groupBy("host", *vector)
        .agg(F.count("*").alias("n"), F.bool_or(tag).alias("has_tag"), F.bool_or(F.col("token") == top).alias("root"))
        .where(F.col("has_tag") & (F.col("n") >= MIN_TOKENS) & (F.col("pages") >= min_pages))
    )
    return summed.join(large, ["host", *vector]).select(
        "host", F.xxhash64(*vector).alias("class"), "token", "path", "root"
    )


def class_orders(tokens: np.ndarray, classes: dict[int, int], root: int | None) -> dict[int, int]:
    """For each class on a page a hash of its order and place, 0 if its tokens are out of order or spread over gaps."""
    at = [k for k, t in enumerate(tokens.tolist()) if t in classes]
    own: dict[int, list[int]] = {}
    for k in at:
        own.setdefault(classes[int(tokens[k])], []).append(k)
    roots = np.array(own.get(root, []))
    out = {}
    for name, places in own.items():
        sequence = tokens[places]
        size = len(set(sequence.tolist()))
        turns, rest = divmod(len(sequence), size)
        ok = not rest and (sequence.reshape(turns, size) == sequence[:size]).all()
        gap = 0
        if ok and name != root:
            ends = np.searchsorted(roots, np.array(places).reshape(turns, size)[:, [0, -1]])
            ok, gap = (ends == ends[0, 0]).all(), int(ends[0, 0])
        out[name] = xxhash.xxh3_64_intdigest(np.append(sequence[:size], np.uint64(gap)).tobytes()) | 1 if ok else 0
    return out


def _unsigned(values: list[int] | None) -> list[int]:
    return np.array(values or [], np.int64).view(np.uint64).tolist()


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for hosts, htmls, *template in W.rows_of(batches, 512):
        known: dict[str, tuple] = {}
        seen: dict[tuple[str, int], list[int]] = {}
        for host, html, tokens, paths, classes, root in zip(hosts, htmls, *template, strict=True):
            if host not in known:
                of = dict(zip(_unsigned(tokens), classes, strict=True))
                first = next((c for c, r in zip(classes, root, strict=True) if r), None)
                known[host] = of, first, {p for p, t in zip(_unsigned(paths), of, strict=True) if p != t}
            of, first, word_paths = known[host]
            for name, sign in class_orders(page_tokens(parse(html), word_paths)[0], of, first).items():
                ends = seen.setdefault((host, name), [sign, sign])
                ends[:] = min(ends[0], sign), max(ends[1], sign)
        signs = np.array(list(seen.values()), np.uint64).reshape(-1, 2) >> np.uint64(1)
        yield pa.record_batch(
            [
                pa.array([h for h, _ in seen], pa.string()),
                pa.array([c for _, c in seen], pa.int64()),
                pa.array(signs[:, 0].astype(np.int64)),
                pa.array(signs[:, 1].astype(np.int64)),
            ],
            names=["host", "class", "least", "most"],
        )


def _with_templates(pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pages with ``token``, ``path``, ``class`` and ``root`` of their host's template as lists, null without any."""
    rows = F.collect_list(F.struct("token", "path", "class", "root"))
    per_host = tokens.groupBy("host").agg(rows.alias("t")).select("host", "t.token", "t.path", "t.class", "t.root")
    small = tokens.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS
    return pages.join(F.broadcast(per_host) if small else per_host, "host", "left")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """The valid classes of ``pages`` (``host``, ``html``): ``host``, ``class``, ``token``, ``path``, ``root``."""
    found = kept(equivalence_classes(pages, min_pages), "classes")
    told = _with_templates(pages, found).where("token IS NOT NULL").select("host", "html", "token", "path", "class", "root")
    orders = told.mapInArrow(_orders, "host string, class long, least long, most long")
    valid = orders.groupBy("host", "class").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least = most AND least > 0")
    return kept(found.join(valid.select("host", "class"), ["host", "class"]), "templates")


def main_text(html: str | None, template: dict[int, set[int]] | None = None) -> tuple[str, int]:
    """The article of a page, and the number of its blocks that the template holds word for word.

    Blocks in an ``article`` or ``main`` element are taken, on pages without either all that are in no part around. Blocks
    whose words are all tokens of the template (words' tokens by path) are left out, unless nothing else is on the page.
    """
    page = [block for block in parse(html) if block[2]]
    kind = max((k for _, k, _ in page), default=OUTSIDE)
    if kind == OUTSIDE:
        return "", 0
    blocks = [(path, words) for path, k, words in page if k == kind]
    template = template or {}
    slots = [
        words for path, words in blocks if path not in template or not template[path].issuperset(word_tokens(path, words))
    ] or [words for _, words in blocks]
    return " ".join([w for words in slots for w in words]), len(blocks) - len(slots)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, urls, htmls, hosts, tokens, paths in W.rows_of(batches, 512):
        known: dict[str, dict[int, set[int]]] = {}
        out = []
        for html, host, own, places in zip(htmls, hosts, tokens, paths, strict=True):
            if host not in known:
                known[host] = {}
                for path, token in zip(_unsigned(places), _unsigned(own), strict=True):
                    known[host].setdefault(path, set()).add(token)
            out.append(main_text(html, known[host]))
        texts = [t for t, _ in out]
        yield pa.record_batch(
            [
                pa.array(ids, pa.int64()),
                pa.array(urls, pa.string()),
                pa.array(texts, pa.string()),
                pa.array(list(map(len, texts)), pa.int64()),
                pa.array([n for _, n in out], pa.int64()),
            ],
            names=["page_id", "url", "text", "n_chars", "n_template_blocks"],
        )


def extracted(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars``, ``n_template_blocks`` for every row of ``pages`` (those and ``html``).

    The text is the article: character references decoded, white space within a block made one space, blocks joined by
    one in page order. Null or empty pages, and pages without such text, have the text ''. Hosts are compared in lower
    case without ``www.``; pages without a url are one host. A host of fewer than ``min_pages`` pages has no template, and
    the names of its elements decide alone. Pages are read whole, of any length and with any errors in their markup. Repeated rows are pages
    of their own; an empty table gives no rows; further columns are ignored.
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"), _host(F.col("url")).alias("host")
    )
    words = templates(own.select("host", "html"), min_pages).where("token != path")
    told = _with_templates(own, words).select("page_id", "url", "html", "host", "token", "path")
    return told.mapInArrow(_texts, "page_id long, url string, text string, n_chars long, n_template_blocks long")
