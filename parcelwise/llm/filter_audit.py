"""What each of several filters removes, alone and behind the others, in every order of them.

Documents are laid in ranges of part and id. In each range every filter has a posting list, the sorted places of the
documents that fail it. Unions of lists and differences from them are found by galloping merges, and because ranges are
disjoint, their sizes add up. All orders of the filters follow from the sizes for each set of filters that ran before:
with five filters 80 rows a part, whatever the number of documents.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm.tables import kept

FILTERS = "ABCDE"  # few words, repeated words, capitals, symbols, copy of an earlier text
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
SYMBOLS = b"#$%&*|"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
RANGE_ROWS = 100_000  # documents whose lists are held at once
PARTS_HELD = 500  # parts whose sizes a task holds before it writes them
KINDS = ("removed", "good", "toxic")


def own_failures(raw: bytes, n_chars: int) -> int:
    """Bits of the filters that look at one text only: A to D."""
    words = raw.split()
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
        | (100 * (len(raw) - len(raw.translate(None, _UPPER))) > MAX_UPPER_PERCENT * n_chars) << 2
        | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3
    )


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part, ids, texts = batch.slice(start, 256).columns
            lengths = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            raws = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
            masks = [own_failures(raw, n) for raw, n in zip(raws, lengths, strict=True)]
            keys = [hashlib.sha256(raw).digest() for raw in raws]
            yield pa.record_batch(
                [part, ids, pa.array(masks, pa.int32()), pa.array(keys, pa.binary())],
                names=["part", "doc_id", "mask", "text_key"],
            )


def failures(docs: DataFrame) -> DataFrame:
    """``part``, ``doc_id`` and ``mask`` for every row of ``docs`` (``doc_id``, ``text``, ``source``).

    Bit k of ``mask`` says that the document fails the k-th of ``FILTERS``: under 50 words; distinct words under 65 in a
    hundred; more than 5 capitals A-Z in a hundred characters; any of ``#$%&*|``; a text that a smaller id has too. Null
    texts are empty, a null source is the part ''. Rows without an id are no copies and make none. Repeated rows
    count each, and none is a copy of another of its own id. Equal texts are told by SHA-256.
    """
    rows = docs.select(
        F.coalesce("source", F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(_judged, "part string, doc_id long, mask int, text_key binary")
    rows = kept(rows, "judged")
    shared = (
        rows.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    )
    copy = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << FILTERS.index("E"))).otherwise(0)
    return rows.join(shared, "text_key", "left").select("part", "doc_id", F.col("mask").bitwiseOR(copy).alias("mask"))


def gallop(ids: Sequence[int], start: int, target: int) -> int:
    """The first place from ``start`` on whose id is at least ``target``: doubling steps, then bisection."""
    step, end, n = 1, start, len(ids)
    while end < n and ids[end] < target:
        start, end, step = end + 1, end + step, 2 * step
    return bisect_left(ids, target, start, min(end, n))


def union(lists: Sequence[Sequence[int]]) -> list[int]:
    """K-way merge of sorted lists without repeats: runs below all other heads are taken at once."""
    out: list[int] = []
    open_ = [(ids, 0) for ids in lists if ids]
    while len(open_) > 1:
        open_.sort(key=lambda x: x[0][x[1]])
        (ids, at), (other, place) = open_[0], open_[1]
        end = gallop(ids, at, other[place])
        if end > at:
            out += ids[at:end]
        else:  # both have this id; the other list keeps it
            end = at + 1
        if end < len(ids):
            open_[0] = (ids, end)
        else:
            del open_[0]
    for ids, at in open_:
        out += ids[at:]
    return out


def difference(ids: Sequence[int], others: Sequence[int]) -> list[int]:
    """The ids of one sorted list that another does not hold."""
    out: list[int] = []
    at = place = 0
    while at < len(ids):
        place = gallop(others, place, ids[at])
        if place == len(others):
            return out + list(ids[at:])
        end = gallop(ids, at, others[place])
        out += ids[at:end]
        at = end + (end < len(ids) and ids[end] == others[place])
    return out


def range_sizes(masks: np.ndarray, good: np.ndarray, toxic: np.ndarray, n_filters: int) -> np.ndarray:
    """Sizes for one range of documents, by set of filters before, filter and kind.

    ``[before, filter, kind]`` counts documents that fail the filter and none of those before; at ``[0, filter]``
    these are all its failures.
    """
    sizes = np.zeros((1 << n_filters, n_filters, len(KINDS)), np.int64)
    for kind, wanted in enumerate((np.ones(len(masks), bool), good, toxic)):
        lists = [np.flatnonzero(wanted & (masks >> f & 1 == 1)).tolist() for f in range(n_filters)]
        for before in range(1 << n_filters):
            gone = union([lists[f] for f in range(n_filters) if before >> f & 1])
            for f in range(n_filters):
                if not before >> f & 1:
                    sizes[before, f, kind] = len(difference(lists[f], gone))
    return sizes


def _ranges(n_filters: int):
    shape = (1 << n_filters, n_filters, len(KINDS))
    before, filter_ = (x.ravel() for x in np.indices(shape[:2]))
    use = (before >> filter_ & 1) == 0

    def written(held: dict[str, list]) -> pa.RecordBatch:
        cells = int(use.sum())
        sizes = np.concatenate([s.reshape(-1, len(KINDS))[use] for _, s in held.values()])
        return pa.record_batch(
            [
                pa.array(np.repeat(np.array(list(held), object), cells), pa.string()),
                pa.array(np.repeat([n for n, _ in held.values()], cells), pa.int64()),
                pa.array(np.tile(before[use], len(held)), pa.int32()),
                pa.array(np.tile(filter_[use], len(held)), pa.int32()),
                *(pa.array(sizes[:, k]) for k in range(len(KINDS))),
            ],
            names=["part", "n", "before", "filter", *KINDS],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            part = batch.column(0).dictionary_encode()
            masks, good, toxic = (c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])
            codes = part.indices.to_numpy(zero_copy_only=False)
            for code, name in enumerate(part.dictionary.to_pylist()):
                own = np.flatnonzero(codes == code)
                total = held.setdefault(name, [0, np.zeros(shape, np.int64)])
                for start in range(0, len(own), RANGE_ROWS):
                    at = own[start : start + RANGE_ROWS]
                    total[0] += len(at)
                    total[1] += range_sizes(masks[at], good[at] == 1, toxic[at] == 1, n_filters)
            if len(held) >= PARTS_HELD:
                yield written(held)
                held = {}
        if held:
            yield written(held)

    return run


def interactions(failing: DataFrame, labels: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """For every part, set of filters ``before`` (bits) and further ``filter`` (number): what it removes behind them.

    ``failing`` has ``part``, ``doc_id``, ``mask``; ``labels`` has ``doc_id``, ``quality``, ``toxic``. Columns: ``n``
    documents of the part, ``failing`` those that fail the filter, ``removed`` those that also pass all before, and
    of these ``good`` (quality 1) and ``toxic`` (toxic 1). A document labelled more than once has what any of its
    labels says; labels without an id belong to none. An empty table gives no rows.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    marked = kept(
        failing.join(known, "doc_id", "left").select(
            "part",
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            "mask",
            F.coalesce("good", F.lit(0)).alias("good"),
            F.coalesce("toxic", F.lit(0)).alias("toxic"),
        ),
        "marked",
    )
    ranges = marked.repartitionByRange("part", "doc_id", "row").sortWithinPartitions("part", "doc_id", "row")
    sizes = ranges.select("part", "mask", "good", "toxic").mapInArrow(
        _ranges(n_filters), "part string, n long, before int, filter int, removed long, good long, toxic long"
    )
    summed = kept(
        sizes.groupBy("part", "before", "filter").agg(*(F.sum(c).alias(c) for c in ("n", *KINDS))), "sizes"
    )
    alone = summed.where("before = 0").select("part", "filter", F.col("removed").alias("failing"))
    return summed.join(alone, ["part", "filter"])


def orders(letters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """Every order of the filters with its steps: order, step from 1, filter's number, bits of those before."""
    out = []
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            out.append(("".join(order), step, letters.index(letter), before))
            before |= 1 << letters.index(letter)
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step.

    ``kept`` after the step, ``removed`` at it, ``redundant`` (fails the filter, removed earlier), ``unique_fails``
    (fails no other filter), ``good_lost``, ``toxic_lost`` and ``shapley``, what the filter removes summed over all
    orders. Odd rows are treated as in :func:`failures` and :func:`interactions`.
    """
    letters, all_ = FILTERS, (1 << len(FILTERS)) - 1
    found = interactions(failures(docs), labels)
    n_before, others = F.bit_count("before"), F.lit(all_) - F.call_function("shiftleft", F.lit(1), F.col("filter"))
    times = F.element_at(
        F.array(*(F.lit(factorial(k) * factorial(len(letters) - 1 - k)) for k in range(len(letters)))), n_before.cast("int") + 1
    )
    whole = found.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * times).cast("long").alias("shapley"),
        F.max(F.when(F.col("before") == others, F.col("removed"))).alias("unique_fails"),
    )
    steps = docs.sparkSession.createDataFrame(orders(), "filter_order string, step int, filter int, before int")
    # As many rows as orders times filters: 600.
    rows = found.join(whole, ["part", "filter"]).join(F.broadcast(steps), ["filter", "before"])
    return rows.select(
        "part",
        "filter_order",
        "step",
        "removed",
        (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails",
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        "shapley",
        "n",
    ).withColumn("kept", _kept_after()).drop("n")


def _kept_after():
    """Documents of the part less those removed up to this step of its order."""
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    return F.col("n") - F.sum("removed").over(so_far)


ORACLE_SQL = r"""
WITH stats AS (
    SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS body,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), firsts AS (
    SELECT body, min(doc_id) AS first_id FROM stats GROUP BY body
), lab AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), fails AS (
    SELECT s.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
           CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
           || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
           || CASE WHEN 100 * len(regexp_replace(s.body, '[^A-Z]', '', 'g')) > 5 * len(s.body) THEN 'C' ELSE '' END
           || CASE WHEN regexp_matches(s.body, '[#$%&*|]') THEN 'D' ELSE '' END
           || CASE WHEN s.doc_id > f.first_id THEN 'E' ELSE '' END AS failed
    FROM stats s JOIN firsts f ON s.body = f.body LEFT JOIN lab l ON s.doc_id = l.doc_id
), counts AS (
    SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, failed
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter
), orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.letter NOT IN (b.letter, c.letter, d.letter, e.letter) AND b.letter NOT IN (c.letter, d.letter, e.letter)
      AND c.letter NOT IN (d.letter, e.letter) AND d.letter != e.letter
), steps AS (
    SELECT filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS earlier
    FROM orders, range(1, 6) r(step)
), found AS (
    SELECT c.part, s.filter_order, s.step, s.letter,
           sum(CASE WHEN s.earlier = '' OR translate(c.failed, s.earlier, '') = c.failed THEN
                    CASE WHEN contains(c.failed, s.letter) THEN 0 ELSE n END ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN contains(c.failed, s.letter) AND translate(c.failed, s.earlier, '') = c.failed THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN contains(c.failed, s.letter) AND translate(c.failed, s.earlier, '') != c.failed THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN c.failed = s.letter THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN contains(c.failed, s.letter) AND translate(c.failed, s.earlier, '') = c.failed THEN c.good ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN contains(c.failed, s.letter) AND translate(c.failed, s.earlier, '') = c.failed THEN c.toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM counts c, steps s GROUP BY c.part, s.filter_order, s.step, s.letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM found
"""
