"""Repeated passages from a sparse suffix array: suffixes at chosen positions, sorted, compared and extended.

A passage of ``MIN_WORDS`` has a minimiser, a position chosen by the content around it, among its first ``WINDOW``
words, the same one in every document that holds it. Only suffixes at minimisers are retained. Passages of one document
with the same minimiser form a stretch; only stretches whose suffix starts like one of another document are
looked at. Equal stretches are one class, and a class of several documents is repeated as a whole. The suffixes of the
others are sorted, neighbours are compared, and their matches extended to the right and to the left. What neighbours
leave unmatched is joined by the hash of each passage, because a sparse order hides matches that lie mostly to the left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import words as W
from parcelwise.llm.tables import dropped, kept

MIN_WORDS = 50
GRAM, WINDOW = 8, 24  # words hashed at a position, and neighbouring positions of which one is chosen
LEAD = MIN_WORDS - WINDOW + 1  # words that equal passages share at least, rightwards from their minimiser
_BASE = 0xBF58476D1CE4E5B9
_INVERSE = pow(_BASE, -1, 1 << 64)


def stretches(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimisers with the first and last start of the passages of ``MIN_WORDS`` that each stands for.

    A passage's minimiser is the smallest ``GRAM``-word hash at its first ``WINDOW`` positions, the last of equals,
    so minimisers rise with the passages.
    """
    n = len(hashes) - MIN_WORDS + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    views = np.lib.stride_tricks.sliding_window_view(W.window_hashes(hashes, GRAM), WINDOW)[:n]
    at, first = np.unique(np.arange(n) + WINDOW - 1 - np.argmin(views[:, ::-1], axis=1), return_index=True)
    return at, first, np.append(first[1:], n) - 1


class Ranges:
    """Hashes of any ranges of words, from sums over the text."""

    def __init__(self, hashes: np.ndarray):
        powers = np.cumprod(np.full(len(hashes), _BASE, np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers)])
        self.back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(hashes), _INVERSE, np.uint64))])

    def __call__(self, start: np.ndarray, words: np.ndarray | int) -> np.ndarray:
        value = (self.sums[start + words] - self.sums[start]) * self.back[start]
        return W.mix(value ^ W.mix(np.zeros(len(start), np.uint64) + np.asarray(words).astype(np.uint64)))


_STRETCH = "code long, context long, doc_id long, words int, starts array<int>"


def _stretch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of each document, equal ones as one row with all their places."""
    for ids, texts in W.rows_of(batches):
        parts, places, counts = [], [], []
        for doc_id, text in zip(ids, texts, strict=True):
            hashes = W.word_hashes(W.words(text))
            at, first, last = stretches(hashes)
            if not len(at):
                continue
            ranges = Ranges(hashes)
            width = last - first + MIN_WORDS
            code, context = ranges(at, LEAD), ranges(first, width)
            order = np.lexsort((first, context, code))
            code, context = code[order], context[order]
            new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (context[1:] != context[:-1])))
            places.append(first[order].astype(np.int32))
            counts.append(np.diff(np.append(new, len(order))))
            doc = np.full(len(new), doc_id, np.int64)
            parts.append((code[new], context[new], doc, width[order][new].astype(np.int32)))
        if parts:
            code, context, doc, width = (np.concatenate(c) for c in zip(*parts, strict=True))
            ends = np.append(0, np.cumsum(np.concatenate(counts))).astype(np.int32)
            starts = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(places)))
            columns = [pa.array(c) for c in (W.signed(code), W.signed(context), doc, width)]
            yield pa.record_batch([*columns, starts], names=["code", "context", "doc_id", "words", "starts"])


_SUFFIX = "code long, context long, low long, high long, lead array<long>, behind array<long>"
_MATCHED = f"{_SUFFIX}, from int, to int"


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffix of each class, read at its place as hashes of words; other texts of that id do not hold the class.

    ``lead`` is the suffix from the minimiser to the end of the stretch, ``behind`` the words before it, the nearest first.
    """
    for texts, places in W.rows_of(batches, 64):
        rows = []
        for text, own in zip(texts, places, strict=True):
            hashes = W.word_hashes(W.words(text))
            ranges = Ranges(hashes)
            for p in own:
                start, words = p["start"], p["words"]
                if start + words > len(hashes):
                    continue
                if int(W.signed(ranges(np.array([start]), words))[0]) != p["context"]:
                    continue
                part = hashes[start : start + words]
                at = int(stretches(part)[0][0])
                part = W.signed(part).tolist()
                rows.append((p["code"], p["context"], p["low"], p["high"], part[at:], part[:at][::-1]))
        if rows:
            yield _batch(rows, ["code", "context", "low", "high"], ["lead", "behind"])


def _batch(rows: list, longs: list[str], lists: list[str], ints: list[str] = []) -> pa.RecordBatch:  # noqa: B006
    kinds = [pa.int64()] * len(longs) + [pa.list_(pa.int64())] * len(lists) + [pa.int32()] * len(ints)
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.record_batch(columns, names=[*longs, *lists, *ints])


def _common(x: list[int], y: list[int]) -> int:
    """Length of the common prefix."""
    return next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))


class _Suffix:
    """A row of the sorted suffixes with the part of its stretch that neighbours hold."""

    def __init__(self, row: tuple):
        self.row = row
        self.code, _, self.low, self.high, self.lead, self.behind = row
        self.start, self.end = len(self.lead) + len(self.behind), 0

    def of_others(self, other: _Suffix) -> bool:
        return not self.low == self.high == other.low == other.high

    def extend(self, other: _Suffix) -> None:
        """Compares with a neighbour: right along the suffixes, then left from the minimisers."""
        if self.code != other.code:
            return
        right, left = _common(self.lead, other.lead), _common(self.behind, other.behind)
        if left + right >= MIN_WORDS:
            for s in (self, other):
                s.start, s.end = min(s.start, len(s.behind) - left), max(s.end, len(s.behind) + right)

    def matched(self) -> tuple:
        return (*self.row, self.start if self.end else 0, self.end)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes, each compared with the nearest before it of another document and with the next."""
    last = other = None
    names = (["code", "context", "low", "high"], ["lead", "behind"], ["from", "to"])
    for columns in W.rows_of(batches, 1024):
        out = []
        for row in zip(*columns, strict=True):
            suffix = _Suffix(row)
            if last is not None:
                if suffix.of_others(last):
                    other = last
                if other is not None:
                    suffix.extend(other)
                out.append(last.matched())
            last = suffix
        if out:
            yield _batch(out, *names)
    if last is not None:
        yield _batch([last.matched()], *names)


_PASSAGES = "code long, context long, low long, high long, from int, to int, passages array<long>"


def _passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all passages of each class."""
    for columns in W.rows_of(batches, 1024):
        rows = []
        for code, context, low, high, lead, behind, start, end in zip(*columns, strict=True):
            part = np.array(behind[::-1] + lead, np.int64).view(np.uint64)
            each = W.signed(W.window_hashes(part, MIN_WORDS)).tolist()
            rows.append((code, context, low, high, each, start, end))
        if rows:
            table = _batch(rows, ["code", "context", "low", "high"], ["passages"], ["from", "to"])
            yield table.select(["code", "context", "low", "high", "from", "to", "passages"])


def _sorted_suffixes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Suffixes of the classes that share a code with others, some of one document, with what their neighbours hold.

    Sorted by code, then by the words of the suffix and those before it, and cut into ranges anywhere, so that a frequent
    code fills no task.
    """
    mixed = classes.groupBy("code").agg(F.count("*").alias("n"), F.max(F.expr("low = high")).alias("alone"))
    opened = classes.join(mixed.where("n > 1 AND alone").select("code"), "code")
    place = F.struct("code", "context", "words", "low", "high", F.col("first.start").alias("start"))
    places = opened.groupBy(F.col("low").alias("doc_id")).agg(F.collect_list(place).alias("places"))
    rows = kept(docs.join(places, "doc_id").select("text", "places").mapInArrow(_suffix_rows, _SUFFIX), "suffixes")
    by = ("code", "lead", "behind")
    matched = rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_neighbours, _MATCHED)
    matched = kept(matched, "neighbours")
    dropped(rows)
    return matched


def _held_parts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """For each class of one document the part that other classes hold: ``code``, ``context``, ``from`` and ``to``.

    Neighbours give the longest match to the right, but a class may share more words to the left with one farther off, or
    with one in the next range. So passages outside the matched part are joined with those of all classes of their code.

    The passages of a class overlap all, so those from the first to the last one held are one part.
    """
    matched = _sorted_suffixes(docs, classes)
    unmatched = matched.where("low = high AND to - from < size(lead) + size(behind)").select("code").distinct()
    rows = matched.join(unmatched, "code", "left_semi").mapInArrow(_passage_rows, _PASSAGES)
    passages = kept(rows, "passages").select(
        "code", "context", "low", "high", "from", "to", F.posexplode("passages").alias("k", "passage")
    )
    held = passages.groupBy("code", "passage").agg(F.min("low").alias("x"), F.max("high").alias("y")).where("x != y")
    exact = (
        passages.where(f"low = high AND NOT (k >= from AND k + {MIN_WORDS} <= to)")
        .join(held.select("code", "passage"), ["code", "passage"])
        .select("code", "context", F.col("k").alias("from"), (F.col("k") + MIN_WORDS).alias("to"))
    )
    near = matched.where("low = high AND to > 0").select("code", "context", "from", "to")
    parts = near.unionByName(exact).groupBy("code", "context")
    return parts.agg(F.min("from").alias("from"), F.max("to").alias("to"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, lists in W.rows_of(batches):
        out = []
        for spans in lists:
            merged: list[list[int]] = []
            for a, b in sorted((s["start"], s["end"]) for s in spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            out.append(merged)
        yield pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.list_(pa.int64())))], names=["doc_id", "spans"]
        )


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans``, ``[start, end)`` in words, of passages that another document holds word for word.

    Spans are the union of all runs of ``MIN_WORDS`` words that stand in another document too, at every place of
    the document where they stand; spans that touch are merged and rise. Words are runs of characters other than
    blanks, case counts.

    Only documents with a span are returned. Null and empty texts and rows without an id have none. Repeated
    rows of one id are one document. Empty tables give no rows; further columns are ignored.
    """
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    every = kept(docs.mapInArrow(_stretch_rows, _STRETCH), "stretches")
    again = every.groupBy("code").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x != y")
    repeated = kept(every.join(again.select("code"), "code"), "repeated")
    first = F.struct("doc_id", F.get("starts", F.lit(0)).alias("start"))
    classes = repeated.groupBy("code", "context").agg(
        F.min("words").alias("words"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min(first).alias("first")
    )
    classes = kept(classes, "classes")
    whole = classes.where("low != high").select("code", "context", F.lit(0).alias("from"), F.col("words").alias("to"))
    spans = (
        repeated.join(whole.unionByName(_held_parts(docs, classes)), ["code", "context"])
        .select("doc_id", "from", "to", F.explode("starts").alias("start"))
        .select("doc_id", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to")).alias("end"))
    )
    return (
        spans.groupBy("doc_id")
        .agg(F.collect_set(F.struct("start", "end")).alias("spans"))
        .mapInArrow(_merged, "doc_id long, spans array<array<long>>")
    )


def passage_report(docs: DataFrame) -> DataFrame:
    """``doc_id`` and digest columns of ``repeated_passages``."""
    spans = repeated_passages(docs)
    listed = F.transform("spans", lambda s: F.concat_ws(":", s.cast("array<string>")))
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + F.get(s, 1) - F.get(s, 0))
    return spans.select(
        "doc_id",
        F.size("spans").cast("long").alias("n_spans"),
        length.alias("repeated_words"),
        F.concat_ws(",", listed).alias("spans"),
    )


# passage_report; spans that touch are merged.
ORACLE_SQL = r"""
WITH cut AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents WHERE doc_id IS NOT NULL
), starts AS (
    SELECT doc_id, words, unnest(range(0, len(words) - 49)) AS start FROM cut WHERE len(words) >= 50
), runs AS (
    SELECT DISTINCT doc_id, start, md5(array_to_string(words[start + 1:start + 50], ' ')) AS run FROM starts
), shared AS (
    SELECT run FROM runs GROUP BY run HAVING min(doc_id) <> max(doc_id)
), held AS (
    SELECT DISTINCT doc_id, start FROM runs SEMI JOIN shared ON runs.run = shared.run
), marked AS (
    SELECT doc_id, start, CASE WHEN start <= lag(start) OVER (PARTITION BY doc_id ORDER BY start) + 50 THEN 0 ELSE 1 END AS opens
    FROM held
), numbered AS (
    SELECT doc_id, start, sum(opens) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM marked
), spans AS (
    SELECT doc_id, min(start) AS first, max(start) + 50 AS past FROM numbered GROUP BY doc_id, span
)
SELECT doc_id::BIGINT AS doc_id, count(*) AS n_spans, sum(past - first)::BIGINT AS repeated_words,
       string_agg(first || ':' || past, ',' ORDER BY first) AS spans
FROM spans GROUP BY doc_id
"""
