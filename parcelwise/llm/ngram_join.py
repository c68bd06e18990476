"""Jaccard join of documents on word shingles, filtered under several global token orders.

A pair that reaches the threshold shares a number of tokens in its prefixes under *every* global order of the
tokens, a number that grows with the sets. So a set is dropped as soon as its prefix under one order shares too few tokens with those
of all sets left, and the filters of three orders are intersected, one after the other, before any pair is built. All orders put
tokens last that are frequent in the corpus, or likely to recur by chance because their words are frequent, and differ
in the hash that orders the rest. Frequencies come from counters of a fixed number over the whole corpus. They only shape
the orders, which never affect the result.

Equal sets are one class. Within a token's bucket, members are first compared with a few heads; sets already connected
need no comparison, and the filter is repeated on the buckets that still hold several components. Of what is left, pairs
are built from the rarest tokens of each set, and verified. So every component is exact, while a group of thousands of near copies costs
work in proportion to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.llm import words as W
from parcelwise.llm.graph import components, extended
from parcelwise.llm.tables import by_shuffle, dropped, kept

TOKEN_CELLS = 1 << 19  # counters of shingles: half a MB for each task; a hundredth of the corpus' words is a good size
WORD_CELLS = 1 << 16  # counters of words, behind them
CELLS = TOKEN_CELLS + WORD_CELLS
BLOCK = 1 << 12  # counters in a row of the sketch
CHANCE = 0.01  # expected occurrences of a shingle by the frequency of its words, above which it moves back
CROWDED = 1 / 256  # of the tasks' sets at a counter, above which the rows of its tokens are dealt over DEALS tasks
DEALS = 32
MORE_ROUNDS = 6  # rounds of heads after the first, before the remaining pairs are compared
PAIR_CELLS = 48  # counters of a set's tokens by hash, that bound what a pair has in common
SIZE_CLASS = 1.05  # largest size in a class of sizes over the smallest


def _ceil_div(a, b):
    return -(-a // b)


# Tokens that prefixes are long enough to share: one for every so many of a set, and one more. The first order sees all
# sets and has short prefixes; the others see what it leaves.
SHARES = (32, 8, 8)


def _prefix(n: int, percent: int, share: int) -> int:
    """Length of a prefix in which a set shares ``n // share + 1`` tokens with any set similar to it and no smaller.

    If the common tokens are z1, z2, ... by the order, at most ``n - ceil(n * percent / 100) + k`` tokens of
    either set come before or at zk. So two prefixes share at least what the smaller set's is made for.
    """
    return n - _ceil_div(n * percent, 100) + n // share + 1


def _fewest(percent: int, share: int = 0) -> Callable[[Column], Column]:
    """Tokens that a set of ``n`` shares at least with any similar one, also a smaller: in prefixes, or in all (0)."""

    def least(n: Column) -> Column:
        smallest = F.ceil(n * percent / 100 - 1e-9)
        return F.floor(smallest / share) + 1 if share else smallest

    return least


def _token_cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(TOKEN_CELLS - 1)).astype(np.int64)


def _word_cells(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(WORD_CELLS - 1)).astype(np.int64)


class TokenOrder:
    """How late a token comes: by its own count, or by what its words' counts let expect."""

    def __init__(self, counts: np.ndarray):
        tokens, words = counts[:TOKEN_CELLS], np.maximum(counts[TOKEN_CELLS:], 1.0)
        usual = max(1.0, float(np.median(tokens)))
        hot = np.floor(4 * np.log2(np.maximum(tokens / usual, 1.0)) + 0.25)
        self.hot = hot.clip(0, 127).astype(np.uint8)
        # Whole numbers, whose sums do not depend on where in a text a shingle stands.
        self.word = np.round(16 * np.log2(words / words.sum())).astype(np.int64)
        self.base = int(16 * np.log2(max(2.0, tokens.sum()) / CHANCE))
        self.crowded = tokens > max(16 * usual, CROWDED * tokens.max())

    def levels(self, hashes: np.ndarray, windows: np.ndarray) -> np.ndarray:
        own = np.concatenate([[0], np.cumsum(self.word[_word_cells(hashes)])])
        width = len(hashes) - len(windows) + 1
        chance = (own[width:] - own[:-width] + self.base) // 16
        return np.maximum(self.hot[_token_cells(windows)], chance.clip(0, 127))

    def token_set(self, text: str | None, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingles of a text and their levels."""
        hashes = W.word_hashes(W.words(text, lower=True))
        windows = W.shingle_windows(hashes, width)
        if not len(windows):
            return windows, np.empty(0, np.int64)
        tokens, first = np.unique(windows, return_index=True)
        return tokens, self.levels(hashes, windows)[first]


def _ordered(tokens: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """The tokens by rising level, then by a hash of their own in each order."""
    rank = W.mix(tokens ^ W.mix(np.array([order + 1], np.uint64)))
    return tokens[np.argsort((levels.astype(np.uint64) << np.uint64(56)) | (rank >> np.uint64(8)))]


def _name(tokens: np.ndarray, names: dict[tuple[int, int], int]) -> int:
    """The first hash of a set, or what it was renamed to because another set has the same."""
    both = _set_id(tokens)
    return names.get(both, both[0])


def _set_id(tokens: np.ndarray) -> tuple[int, int]:
    """Two hashes that depend on the set alone."""
    return int(W.mix(tokens).sum().view(np.int64)), int(W.mix(tokens ^ W._MUL2).sum().view(np.int64))


_INTS = pa.list_(pa.int32())
_LONG_COLUMNS = ("doc_id", "text_key", "n_shingles", "set_id", "check", "block")
_SUMMARY = pa.schema([(c, pa.int64()) for c in _LONG_COLUMNS] + [("counts", _INTS)])
_SUMMARY_SQL = ", ".join(f"{c} long" for c in _LONG_COLUMNS) + ", counts array<int>"


def _summary(*columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SUMMARY, strict=True)], schema=_SUMMARY)


def _blocks(counts: np.ndarray) -> pa.RecordBatch:
    rows = list(counts.astype(np.int32).reshape(-1, BLOCK))
    none = [None] * len(rows)
    return _summary(none, none, none, none, none, range(len(rows)), rows)


def _summaries(width: int) -> Callable:
    """Per document its size and set id; per task the counts of the sketch, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for ids, texts, text_keys in W.rows_of(batches):
            hashes = [W.word_hashes(W.words(t, lower=True)) for t in texts]
            sets = [np.unique(W.shingle_windows(h, width)) for h in hashes]
            counts[:TOKEN_CELLS] += np.bincount(_token_cells(np.concatenate(sets)), minlength=TOKEN_CELLS)
            counts[TOKEN_CELLS:] += np.bincount(_word_cells(np.concatenate(hashes)), minlength=WORD_CELLS)
            keys = [_set_id(s) if len(s) else (None, None) for s in sets]
            none = [None] * len(ids)
            yield _summary(ids, text_keys, [len(s) for s in sets], [k[0] for k in keys], [k[1] for k in keys], none, none)
        if counts.any():
            yield _blocks(counts)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a partition as one sketch, a row for each counter."""
    counts = np.zeros((CELLS // BLOCK, BLOCK), np.int64)
    for batch in batches:
        blocks, lists = batch.columns
        values = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, BLOCK)
        np.add.at(counts, blocks.to_numpy(zero_copy_only=False), values)
    at = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(at), pa.array(counts.ravel()[at])], names=["cell", "n"])


def _token_order(sketches: DataFrame, tasks: int) -> TokenOrder:
    added = sketches.repartition(max(1, round(tasks**0.5))).mapInArrow(_added, "cell long, n long")
    rows = added.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    counts = np.zeros(CELLS)
    counts[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return TokenOrder(counts)


_ROWS_SQL = "token long, deal int, set_id long, n int"


def _prefix_rows(width: int, percent: int, order: TokenOrder, number: int, names: dict) -> Callable:
    """One row for each token in the prefix under an order, once for each set of a task.

    ``deal`` is 0, or for a token at a crowded counter one of 1 to ``DEALS``, by the set.
    """
    fields = [("token", pa.int64()), ("deal", pa.int32()), ("set_id", pa.int64()), ("n", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for (texts,) in W.rows_of(batches, 64):
            out: list[tuple[np.ndarray, int, int]] = []
            for text in texts:
                tokens, levels = order.token_set(text, width)
                if not len(tokens) or (key := _name(tokens, names)) in seen:
                    continue
                seen.add(key)
                length = _prefix(len(tokens), percent, SHARES[number])
                out.append((_ordered(tokens, levels, number)[:length], key, len(tokens)))
            if out:
                lengths = [len(t) for t, _, _ in out]
                tokens, keys = np.concatenate([t for t, _, _ in out]), np.array([k for _, k, _ in out], np.int64)
                deals = np.repeat((keys % DEALS + 1).astype(np.int32), lengths)
                yield pa.record_batch(
                    [
                        pa.array(W.signed(tokens)),
                        pa.array(np.where(order.crowded[_token_cells(tokens)], deals, np.int32(0))),
                        pa.array(np.repeat(keys, lengths)),
                        pa.array(np.repeat(np.array([n for _, _, n in out], np.int32), lengths)),
                    ],
                    schema=pa.schema(fields),
                )

    return run


def _whole_sets(width: int, percent: int, order: TokenOrder, number: int, names: dict) -> Callable:
    """The sets in an order, cut behind the prefix."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("set_id", pa.int64()), ("n", pa.int64()), ("lead", longs), ("rest", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, wanted in W.rows_of(batches, 16):
            keys, sizes, leads, rests = [], [], [], []
            for text, want in zip(texts, wanted, strict=True):
                tokens, levels = order.token_set(text, width)
                if len(tokens) and _name(tokens, names) == want:
                    cut, tokens = _prefix(len(tokens), percent, SHARES[number]), W.signed(_ordered(tokens, levels, number))
                    keys.append(want)
                    sizes.append(len(tokens))
                    leads.append(tokens[:cut])
                    rests.append(tokens[cut:])
            yield pa.record_batch(
                [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(leads, longs), pa.array(rests, longs)],
                schema=schema,
            )

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, label: str) -> DataFrame:
    """The pairs (``a``, ``b``) that overlap under the third order too and reach the threshold."""

    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("set_id").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    sizes_fit = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    least = F.floor(F.least("n_a", "n_b") / SHARES[2]) + 1
    close = kept(
        pairs.join(side("a", "n", "lead"), "a")
        .join(side("b", "n", "lead"), "b")
        .where(sizes_fit & (F.size(F.array_intersect("lead_a", "lead_b")) >= least))
        .select("a", "b"),
        f"{label}-candidates",
    )
    both = F.size(F.array_intersect(F.concat("lead_a", "rest_a"), F.concat("lead_b", "rest_b"))).cast("long")
    return kept(
        close.join(side("a", "n", "lead", "rest"), "a")
        .join(side("b", "n", "lead", "rest"), "b")
        .withColumn("both", both)
        .where(F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * percent)
        .select("a", "b"),
        label,
    )


def _maybe_shared(rows: DataFrame) -> DataFrame:
    """The rows of tokens that several sets hold or that were dealt out, in one shuffle of all rows.

    Dealt tokens are spread, so none fills a task; they are looked at again, like all others, when few rows are left.
    """
    bucket = Window.partitionBy("token", "deal")
    ends = rows.withColumn("low", F.min("set_id").over(bucket)).withColumn("high", F.max("set_id").over(bucket))
    return ends.where("low != high OR deal > 0").drop("deal", "low", "high")


def _ends(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _shared(rows: DataFrame) -> DataFrame:
    """The rows of tokens that several sets hold, or several components if rows have a ``part``, in one shuffle of all rows."""
    part, bucket = "part" if "part" in rows.columns else "set_id", Window.partitionBy("token")
    ends = rows.withColumn("low", F.min(part).over(bucket)).withColumn("high", F.max(part).over(bucket))
    return ends.where("low != high").drop("low", "high")


def _enough(shared: DataFrame, least: Callable[[Column], Column]) -> DataFrame:
    """The sets with at least ``least(n)`` of the rows, and their number, ``held``."""
    counted = shared.groupBy("set_id").agg(F.count("*").alias("held"), F.max("n").alias("n"))
    return counted.where(F.col("held") >= least(F.col("n"))).select("set_id", "held")


def _peeled(rows: DataFrame, least: Callable[[Column], Column], label: str) -> DataFrame:
    """The shared rows of the sets that have enough of them, with the number of the set's, ``held``."""
    shared = kept(_shared(rows), f"{label}-all")
    enough = kept(shared.join(by_shuffle(_enough(shared, least)), "set_id"), label)
    dropped(shared)
    return enough


def _class_of(n: Column) -> Column:
    return F.floor(F.log(n) / float(np.log(SIZE_CLASS))).cast("int")


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """Common tokens that two sets of these sizes need."""
    return F.ceil((n + m) * percent / (100 + percent) - 1e-9)


def _peeled_by_size(rows: DataFrame, percent: int, label: str) -> DataFrame:
    """Rows of whole sets that share enough tokens with sets of other components of one size class, with ``least``.

    How much a pair must share depends on both sizes, so tokens are counted for each class of partners' sizes; ``least`` is the smallest
    such number among the classes where a set has enough. A set that differs from all others in a few more tokens
    than a pair may is dropped here, before any of its pairs is built, however large its group is.
    """
    written = None
    while True:
        held = rows.groupBy("token", _class_of(F.col("n")).alias("class")).agg(
            F.min("part").alias("low"), F.max("part").alias("high"), F.min("n").alias("small"), F.max("n").alias("large")
        )
        n, partner = F.col("n"), F.greatest(F.min("small"), F.ceil(F.first("n") * percent / 100 - 1e-9))
        met = (
            rows.join(by_shuffle(held), "token")
            .where("low != part OR high != part")
            .where((F.col("large") * 100 >= n * percent) & (F.col("small") * percent <= n * 100))
            .groupBy("set_id", "class")
            .agg(F.count("*").alias("shared"), _overlap(F.first("n"), partner, percent).alias("least"))
            .where("shared >= least")
        )
        enough = met.groupBy("set_id").agg(F.min("least").alias("least"))
        fewer = kept(rows.drop("least").join(by_shuffle(enough), "set_id"), label)
        if written is not None:
            dropped(written[0])
        left = fewer.count()
        if not left or (written and left > 0.9 * written[1]):
            return fewer
        rows, written = fewer, (fewer, left)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Bucket rows with the component of their set."""
    joined = rows.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    return joined.withColumn("part", F.coalesce("label", "set_id")).drop("label")


def _open_pairs(rows: DataFrame) -> tuple[int, int]:
    """Rows, and pairs of different components within buckets."""
    per_part = rows.groupBy("token", "part").agg(F.count("*").cast("double").alias("n"))
    per_token = per_part.groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    total = per_token.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()
    return int(total[0] or 0), int(total[1] or 0)


def _head_pairs(rows: DataFrame, seed: int) -> DataFrame:
    """For each set, the head of its buckets, of another component, that it shares most tokens with.

    The head of a bucket is the set with the fewest tokens that no other set holds, the likeliest to be similar to the
    others; of equal ones a seeded choice.
    """
    own, draw = (F.col("n") - F.col("held")).alias("own"), F.xxhash64(F.lit(seed), "set_id").alias("draw")
    rank = F.struct(own, draw, F.col("set_id").alias("head"), F.col("part").alias("head_part"))
    dealt = rows.select("token", "set_id", "n", "held", "part").repartition("token")  # before ranks are built, which are longer
    best = dealt.withColumn("best", F.min(rank).over(Window.partitionBy("token")))
    met = best.select("set_id", "part", "best.head", "best.head_part").where("part != head_part")
    counted = met.groupBy("set_id", "head").agg(F.count("*").alias("shared"))
    best = counted.groupBy("set_id").agg(F.max(F.struct("shared", "head")).alias("best"))
    return best.select(*_ends("set_id", F.col("best.head"))).distinct()


def _rare(rows: DataFrame) -> DataFrame:
    """Of the rows of each set all but the ``least - 1`` most frequent tokens, with the largest component of each bucket.

    Similar sets share at least ``least`` of their rows, so they share one of these, in any one order of all tokens. ``place``
    is a row's place in that order, of ``total``; ``cells`` counts the rows of the set by hash of their token.
    """
    sizes = rows.groupBy("token", "part").agg(F.count("*").alias("own"))
    main = sizes.groupBy("token").agg(F.max(F.struct("own", "part")).alias("main"), F.sum("own").alias("all"))
    cell = F.pmod(F.xxhash64("token"), F.lit(PAIR_CELLS))
    cells = rows.groupBy("set_id").agg(F.array(*(F.count_if(cell == i).cast("int") for i in range(PAIR_CELLS))).alias("cells"))
    rows = rows.join(by_shuffle(main.select("token", "all", F.col("main.part").alias("main"))), "token")
    total = F.count("*").over(Window.partitionBy("set_id"))
    place = F.row_number().over(Window.partitionBy("set_id").orderBy("all", "token"))
    rows = rows.withColumn("place", place).withColumn("total", total).where("place <= total - least + 1")
    return rows.select("token", "set_id", "part", "n", "main", "place", "total").join(by_shuffle(cells), "set_id")


def _remaining_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that share a rare row and may reach the threshold.

    They may by their sizes, by the places of the shared token, and by the counts of their cells: two sets
    have no more tokens of a cell in common than the smaller count. This bound is close where sets miss few tokens, so
    near copies that are not quite similar are not built as pairs. The component with most rows of a bucket is
    never paired with itself, not even to be refused.
    """
    rows = kept(_rare(rows), "rare")
    sides = ("set_id", "part", "n", "place", "total", "cells")
    minor = rows.where("part != main").select("token", *(F.col(c).alias(f"{c}_x") for c in sides))
    n_x, n_y = F.col("n_x"), F.col("n")
    least = _overlap(n_x, n_y, percent)
    ahead = F.least("place", "place_x")
    behind = F.least(F.col("total") - F.col("place"), F.col("total_x") - F.col("place_x"))
    common = reduce(lambda a, b: a + b, (F.least(F.get("cells", F.lit(i)), F.get("cells_x", F.lit(i))) for i in range(PAIR_CELLS)))
    possible = (
        (F.col("part") != F.col("part_x"))
        & ((F.col("part_x") < F.col("part")) | (F.col("part") == F.col("main")))
        & (F.least(n_x, n_y) * 100 >= F.greatest(n_x, n_y) * percent)
        & (F.col("place") <= F.col("total") - least + 1)
        & (F.col("place_x") <= F.col("total_x") - least + 1)
        & (ahead + behind >= least)
        & (common >= least)
    )
    right = rows.withColumnRenamed("token", "token_y")
    return (
        minor.join(right, (F.col("token") == F.col("token_y")) & possible).select(*_ends("set_id_x", "set_id")).distinct()
    )


def _renamed(classes: DataFrame) -> dict[tuple[int, int], int]:
    """New names for sets that share their first hash with another set, by both hashes.

    Of sets with one first hash all but the one with the smallest second hash are renamed. Even of 2**36 sets about a hundred are.
    """
    least = classes.groupBy("set_id").agg(F.min("check").alias("least"), F.count("*").alias("n")).where("n > 1")
    doubles = classes.join(least, "set_id").where("check != least").select("set_id", "check").collect()
    names: dict[tuple[int, int], int] = {}
    salt = 0
    while len(names) < len(doubles):
        salt += 1
        todo = [tuple(r) for r in doubles if tuple(r) not in names]
        tried = {k: int(W.mix(np.array(k, np.int64).view(np.uint64) + np.uint64(salt)).sum().view(np.int64)) for k in todo}
        wanted = list(tried.values())
        taken = {r["set_id"] for r in classes.where(F.col("set_id").isin(wanted)).select("set_id").collect()} | set(names.values())
        for key, name in tried.items():
            if name not in taken and wanted.count(name) == 1:
                names[key] = name
    return names


def _with_names(df: DataFrame, names: dict[tuple[int, int], int]) -> DataFrame:
    """``set_id`` as renamed."""
    if not names:
        return df.drop("check")
    rows = [(*key, name) for key, name in names.items()]
    table = F.broadcast(df.sparkSession.createDataFrame(rows, "set_id long, check long, renamed long"))
    return df.join(table, ["set_id", "check"], "left").withColumn("set_id", F.coalesce("renamed", "set_id")).drop("check", "renamed")


BROADCAST_SETS = 2_000_000  # 16 bytes each


def _texts_of(docs: DataFrame, wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """A text and the name of each wanted set. Up to ``BROADCAST_SETS`` ids are sent to the texts, more are joined."""
    ids = kept(wanted.join(classes, "set_id").select("set_id", F.col("first_id").alias("doc_id")), "wanted")
    if ids.count() <= BROADCAST_SETS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id").select("text", "set_id")


def near_duplicates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    Texts are lower-cased in A-Z and cut into words; a document's set holds its distinct ``width``-word
    shingles. Two documents link if ``100 * intersection >= percent * union``; ``component_id`` is the
    smallest id reachable by links, the own included.

    Null and empty texts have no shingles, link with nothing and are components of their own. Rows without
    an id get component null and link nothing. Repeated rows are each returned. Texts of fewer than
    ``width`` words have their whole sequence as one shingle. An empty table gives no rows; further columns
    are ignored. Texts are read whole. Sets are told apart by 128 bits of hash.
    """
    return grouped(docs, width, percent).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """:func:`near_duplicates` with ``text_key``, ``xxhash64`` of the text, and ``group_id``, one name for all rows of a component.

    ``group_id`` tells components apart that have the same smallest id, because an id is repeated with other texts. It is null
    without shingles and without an id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    summary = kept(keyed.mapInArrow(_summaries(width), _SUMMARY_SQL), "summaries")
    sketches = summary.where("block IS NOT NULL").select("block", "counts")
    order = _token_order(sketches, sketches.where("block = 0").count())
    members = summary.where("block IS NULL").select("doc_id", "text_key", "n_shingles", "set_id", "check")
    classes = members.where("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id", "check")
    classes = kept(classes.agg(F.min("doc_id").alias("first_id")), "classes")
    names = _renamed(classes)
    members, classes = _with_names(members, names), _with_names(classes, names)
    labels = _labels(docs, classes, order, names, width, percent)

    named = classes.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
        "group_id", F.coalesce("label", "set_id")
    )
    smallest = named.groupBy("group_id").agg(F.min("first_id").alias("component_id"))
    named = kept(named.join(smallest, "group_id").select("set_id", "group_id", "component_id"), "components")
    own = F.col("doc_id")
    return members.join(named, "set_id", "left").select(
        "doc_id",
        "text_key",
        "n_shingles",
        F.when(own.isNotNull(), F.col("group_id")).alias("group_id"),
        F.when(own.isNotNull(), F.coalesce("component_id", own)).alias("component_id"),
    )


def one_of_each_group(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, and of its texts the one with the smallest hash.

    Decided for each row by its id and text, so a text stays although its id is repeated with a copy of another one. Rows
    without an id and texts without shingles belong to no component and stay. Of equal rows one stays. All columns stay as they are;
    an empty table stays empty. The keys of rows that go are sent to the texts, up to ``BROADCAST_SETS`` of them, and joined beyond.
    """
    found = kept(grouped(docs, width, percent).where("group_id IS NOT NULL").select("doc_id", "text_key", "group_id"), "groups")
    rows = found.groupBy("group_id", "doc_id", "text_key").agg(F.count("*").alias("copies"))
    best = found.groupBy("group_id").agg(F.min(F.struct("doc_id", "text_key")).alias("best"))
    told = kept(
        rows.join(best, "group_id").select(
            F.col("doc_id").alias("row_id"),
            F.col("text_key").alias("row_key"),
            (F.struct("doc_id", "text_key") == F.col("best")).alias("stays"),
            "copies",
        ),
        "decisions",
    )

    def of(keys: DataFrame, how: str) -> DataFrame:
        if keys.count() <= BROADCAST_SETS:
            keys = F.broadcast(keys)
        return left.join(keys, (left["doc_id"] == keys["row_id"]) & (F.xxhash64(left["text"]) == keys["row_key"]), how)

    left = docs
    left = of(told.where("NOT stays").select("row_id", "row_key"), "left_anti")
    repeated = told.where("stays AND copies > 1").select("row_id", "row_key")
    if repeated.isEmpty():
        return left
    return of(repeated, "left_anti").unionByName(of(repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def _survivors(docs: DataFrame, classes: DataFrame, rows_of: Callable[[int], Callable], percent: int) -> DataFrame:
    """The names of the sets that pass the filters of all orders."""
    texts = docs.where("doc_id IS NOT NULL").select("text")
    rows = kept(_maybe_shared(texts.mapInArrow(rows_of(0), _ROWS_SQL)).distinct(), "prefixes")
    wanted = kept(_enough(_shared(rows), _fewest(percent, SHARES[0])).select("set_id"), "passed")
    dropped(rows)
    for number, share in enumerate(SHARES[1:], 1):
        rows = _texts_of(docs, wanted, classes).select("text").mapInArrow(rows_of(number), _ROWS_SQL).drop("deal")
        # Repeated rows of a token are in one partition already.
        wanted = kept(_enough(_shared(rows).distinct(), _fewest(percent, share)).select("set_id"), "passed")
    return wanted


def _labels(docs: DataFrame, classes: DataFrame, order: TokenOrder, names: dict, width: int, percent: int) -> DataFrame:
    """``node`` and ``label`` of every set that is similar to another: its component, from enough pairs to connect each."""
    wanted = _survivors(docs, classes, lambda number: _prefix_rows(width, percent, order, number, names), percent)
    last = len(SHARES) - 1
    sets = kept(
        _texts_of(docs, wanted, classes).mapInArrow(
            _whole_sets(width, percent, order, last, names), "set_id long, n long, lead array<long>, rest array<long>"
        ).dropDuplicates(["set_id"]),  # repeated rows give their set more than once
        "sets",
    )
    tokens = sets.select("set_id", "n", F.explode(F.concat("lead", "rest")).alias("token"))
    rows = _peeled(tokens, _fewest(percent), "shared")
    alone = rows.withColumn("part", F.col("set_id"))
    labels = components(_verified(_head_pairs(alone, 0), sets, percent, "links"))
    before = float("inf")
    for turn in range(1, MORE_ROUNDS + 2):
        open_ = _peeled(_labelled(rows.select("token", "set_id", "n"), labels), _fewest(percent), "open")
        dropped(rows)
        rows = _peeled_by_size(open_, percent, "open")
        dropped(open_)
        n_rows, n_pairs = _open_pairs(rows)
        if n_pairs <= 4 * n_rows or turn > MORE_ROUNDS or 2 * n_pairs > before:
            break  # few are left, or heads do not connect them
        before = n_pairs
        more = _verified(_head_pairs(rows, turn), sets, percent, "links")
        if more.isEmpty():
            break
        labels = extended(labels, more)
    if n_pairs:
        labels = extended(labels, _verified(_remaining_pairs(rows, percent), sets, percent, "links"))
    dropped(sets, rows)
    return labels


# near_duplicates with four words and 85 in a hundred; equal sets are one class, as in the operator.
ORACLE_SQL = r"""
WITH RECURSIVE cut AS (
    SELECT doc_id, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x20\x09-\x0D]+') AS words
    FROM documents
), sets AS (
    SELECT doc_id, list_sort(list_distinct(CASE
               WHEN len(words) = 0 THEN []
               WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
               ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END)) AS shingles
    FROM cut
), named AS (
    SELECT doc_id, len(shingles) AS n, md5(array_to_string(shingles, chr(10))) AS name, shingles FROM sets
), classes AS (
    SELECT name, min(doc_id) AS first_id, any_value(n) AS n, any_value(shingles) AS shingles
    FROM named WHERE n > 0 AND doc_id IS NOT NULL GROUP BY name
), tokens AS (
    SELECT first_id, n, unnest(shingles) AS token FROM classes
), shared AS (
    SELECT a.first_id AS x, b.first_id AS y, any_value(a.n + b.n) AS n, count(*) AS common
    FROM tokens a JOIN tokens b ON a.token = b.token AND a.first_id < b.first_id GROUP BY a.first_id, b.first_id
), links AS (
    SELECT x, y FROM shared WHERE 100 * common >= 85 * (n - common)
), ways AS (
    SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
    SELECT first_id AS x, first_id AS y FROM classes
    UNION
    SELECT reached.x, ways.y FROM reached JOIN ways ON reached.y = ways.x
), smallest AS (
    SELECT x, min(y) AS component FROM reached GROUP BY x
)
SELECT d.doc_id::BIGINT AS doc_id, d.n::BIGINT AS n_shingles,
       CASE WHEN d.doc_id IS NOT NULL THEN coalesce(s.component, d.doc_id) END::BIGINT AS component_id
FROM named d LEFT JOIN classes c ON d.name = c.name AND d.n > 0 LEFT JOIN smallest s ON s.x = c.first_id
"""
