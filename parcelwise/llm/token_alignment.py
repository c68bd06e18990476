"""Alignment of two tokenizers over the bytes of a text.

Each tokenization is a sparse incidence matrix of tokens and bytes, held as hand-built CSR arrays. The product of one
matrix and the other's transpose, row by row after Gustavson, has an entry for each pair of tokens whose byte ranges
overlap. Cutting both where tokens of both end gives groups, and the product of the two group-incidence matrices
links all tokens of a group.

A text is cut at single spaces between other characters, where both tokenizers start a new token whatever stands
around, and each distinct piece is encoded and multiplied once in a task. So a document is a list of piece numbers, and its
counts are sums over them. Counts of id pairs over the corpus are summed in the tasks first; a table of at most
``MAX_PAIRS`` of them is sent to the tasks, a larger one is joined.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import words as W
from parcelwise.llm.tables import kept

TOKENIZERS = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
MAX_PAIRS = 4_000_000  # id pairs sent to tasks: 17 bytes each
HELD_PIECES = 600_000  # distinct pieces a task remembers
# Fixed value: how the byte-level vocabulary cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ID_BITS = 24  # of the second id in a pair's key
_BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace()]
_CUT = re.compile(r"(?<=\S)(?= \S)")


@dataclass
class Csr:
    """Rows of column numbers; ``values`` count how often each is hit."""

    indptr: np.ndarray
    indices: np.ndarray
    n_cols: int
    values: np.ndarray | None = None

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        indptr = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.n_cols))])
        return Csr(indptr, self.rows[order], len(self.indptr) - 1)


def spans(lengths: np.ndarray, n_cols: int) -> Csr:
    """The incidence of consecutive tokens and their bytes."""
    indptr = np.concatenate([[0], np.cumsum(lengths)])
    return Csr(indptr, np.arange(indptr[-1]), n_cols)


def memberships(groups: np.ndarray, n_groups: int) -> Csr:
    """The incidence of tokens and the one group of each."""
    return Csr(np.arange(len(groups) + 1), groups, n_groups)


def product(a: Csr, b: Csr) -> Csr:
    """``a·b`` after Gustavson: row i is the sum of the rows of ``b`` that row i of ``a`` names."""
    widths = np.diff(b.indptr)[a.indices]
    ends = np.cumsum(widths)
    rows = np.repeat(a.rows, widths)
    taken = np.arange(ends[-1] if len(ends) else 0) + np.repeat(b.indptr[a.indices] - (ends - widths), widths)
    key = rows * b.n_cols + b.indices[taken]
    if len(key) and (key[1:] < key[:-1]).any():
        key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    cells = key[first]
    out = cells // b.n_cols if b.n_cols else cells
    indptr = np.searchsorted(out, np.arange(len(a.indptr)))
    return Csr(indptr, cells - out * b.n_cols, b.n_cols, np.diff(np.append(first, len(key))))


def _byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken

        with open(f"{folder}/{BYTE_LEVEL}", encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]  # without special tokens, so that they are plain text
        alphabet = _byte_alphabet()
        ranks = {bytes(map(alphabet.__getitem__, token)): i for token, i in vocabulary.items()}
        self.a = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [self._piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.len_a = np.array([len(x) for x in self.bytes_a])
        self.len_b = np.array([len(x) for x in self.bytes_b])
        self.n_ids = max(len(self.bytes_a), len(self.bytes_b))
        self.spelled = [f"{i}{end}" for end in ",|;" for i in range(self.n_ids)]

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each piece behind a space, which the second tokenizer adds itself."""
        encode = self.a.encode_ordinary
        return [encode(" " + p) for p in pieces], self.b.encode(pieces, num_threads=1)

    def whole(self, pieces: list[str], a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        """Whether both token sequences spell each piece behind a space."""
        raws = [b" " + W.encoded(p) for p in pieces]
        lengths, joined = np.fromiter(map(len, raws), np.int64, len(raws)), b"".join(raws)
        out = np.ones(len(raws), bool)
        for spelled, widths, ids in ((self.bytes_a, self.len_a, a), (self.bytes_b, self.len_b, b)):
            n, flat = _flat(ids)
            own = np.bincount(np.repeat(np.arange(len(ids)), n), weights=widths[flat], minlength=len(ids))
            spell = spelled.__getitem__
            if (own != lengths).any() or b"".join(map(spell, flat.tolist())) != joined:
                out &= [b"".join(map(spell, x)) == raw for x, raw in zip(ids, raws, strict=True)]
        return out


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of lists, and their numbers one behind the other."""
    return np.fromiter(map(len, lists), np.int64, len(lists)), np.fromiter(chain.from_iterable(lists), np.int64)


@lru_cache(maxsize=2)
def _pair(folder: str) -> Pair:
    return Pair(folder)


def cut(text: str) -> list[str]:
    """Pieces of a text, each without the space before it (before the text itself one is added)."""
    if text[0] == " " or text[-1] == " " or any(c in text and (c + " " in text or " " + c in text) for c in _BLANKS):
        return [p[1:] for p in _CUT.split(" " + text)]
    return text.split(" ")


@dataclass
class Aligned:
    """Sums (``SUMS``) and links of several pieces."""

    sums: np.ndarray
    whole: np.ndarray
    groups: list[str]  # each group ends with a semicolon
    links: np.ndarray  # id pair of each link, as a key
    piece: np.ndarray  # piece of each link, rising


SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_group_links")


def _written(pair: Pair, ids_a, ids_b, last_a, last_b, group_a, group_b, widths) -> list[str]:
    """The groups of each piece as text; ``widths`` are the pieces' numbers of tokens."""
    n_groups = len(last_a)
    ends = np.zeros(len(ids_a) + len(ids_b), np.int64)  # of the text of each token: 0 comma, 1 bar, 2 semicolon
    ids = np.empty(len(ends), np.int64)
    before_b = np.concatenate([[0], last_b])
    at_a = np.arange(len(ids_a)) + before_b[group_a]
    at_b = np.arange(len(ids_b)) + last_a[group_b]
    ids[at_a], ids[at_b] = ids_a, ids_b
    if n_groups:
        ends[at_a[last_a - 1]], ends[at_b[last_b - 1]] = 1, 2
    texts = list(map(pair.spelled.__getitem__, (ends * pair.n_ids + ids).tolist()))
    at = np.concatenate([[0], np.cumsum(widths)]).tolist()
    return ["".join(texts[i:j]) for i, j in zip(at, at[1:])]


def align(pieces: list[str], pair: Pair) -> Aligned:
    """All links of the pieces, by one product over the bytes of all of them."""
    a, b = pair.encode(pieces)
    whole = pair.whole(pieces, a, b)
    if not whole.all():
        a = [x if w else [] for x, w in zip(a, whole, strict=True)]
        b = [x if w else [] for x, w in zip(b, whole, strict=True)]
    n = len(pieces)
    (n_a, ids_a), (n_b, ids_b) = _flat(a), _flat(b)
    of_a, of_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
    ends_a, ends_b = np.cumsum(pair.len_a[ids_a]), np.cumsum(pair.len_b[ids_b])
    total = int(ends_a[-1]) if len(ends_a) else 0

    overlap = product(spans(pair.len_a[ids_a], total), spans(pair.len_b[ids_b], total).transposed())
    rows = overlap.rows

    is_end = np.zeros((2, total + 1), bool)
    is_end[0, ends_a], is_end[1, ends_b] = True, True
    group_at = np.cumsum(is_end.all(axis=0))  # groups that end up to a byte
    group_a, group_b = group_at[ends_a - 1], group_at[ends_b - 1]
    n_all = int(group_at[-1])
    shared = product(memberships(group_a, n_all), memberships(group_b, n_all).transposed())
    last_a, last_b = (np.cumsum(np.bincount(g, minlength=n_all)) for g in (group_a, group_b))

    sums = np.stack(
        [
            n_a,
            n_b,
            np.bincount(of_a[last_a - 1], minlength=n),
            np.bincount(of_a[rows], minlength=n),
            np.bincount(of_a[shared.rows], minlength=n),
        ],
        axis=1,
    )
    groups = _written(pair, ids_a, ids_b, last_a, last_b, group_a, group_b, n_a + n_b)
    return Aligned(sums, whole, groups, ids_a[rows] << ID_BITS | ids_b[overlap.indices], of_a[rows])


class Memory:
    """The pieces a task has met, by number, with their sums and links."""

    def __init__(self, folder: str):
        self.pair = _pair(folder)
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.groups: list[str] = []
        self.sums = np.empty((0, len(SUMS)), np.int64)
        self.whole = np.empty(0, bool)
        self.links = np.empty(0, np.int64)
        self.ends = np.zeros(1, np.int64)  # of each piece's links

    def learn(self, pieces: list[str]) -> None:
        start, found = len(self.numbers), align(pieces, self.pair)
        stop, ends = start + len(pieces), np.cumsum(np.bincount(found.piece, minlength=len(pieces)))
        self.sums = _grown(self.sums, start, found.sums)
        self.whole = _grown(self.whole, start, found.whole)
        self.links = _grown(self.links, int(self.ends[start]), found.links)
        self.ends = _grown(self.ends, start + 1, ends + self.ends[start])
        self.groups += found.groups
        self.numbers.update(zip(pieces, range(start, stop)))

    def read(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Piece numbers of each text; None for texts without tokens."""
        cuts = [cut(t) if t else [] for t in texts]
        get = self.numbers.get
        read = [list(map(get, c)) for c in cuts]
        new = {p for c, at in zip(cuts, read, strict=True) if None in at for p, i in zip(c, at, strict=True) if i is None}
        if new:
            self.learn(list(new))
            read = [
                at if None not in at else [get(p) if i is None else i for p, i in zip(c, at, strict=True)]
                for c, at in zip(cuts, read, strict=True)
            ]
        out = [np.array(at, np.int64) if at else None for at in read]
        return [at if at is not None and self.whole[at].all() else None for at in out]

    def pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct id pairs of a text, rising, and how many of its links hold each."""
        starts, widths = self.ends[at], self.ends[at + 1] - self.ends[at]
        ends = np.cumsum(widths)
        keys = self.links[np.arange(ends[-1]) + np.repeat(starts - (ends - widths), widths)]
        keys.sort()
        last = np.flatnonzero(np.append(keys[1:] != keys[:-1], True))
        return keys[last], np.diff(last, prepend=-1)


def _grown(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``held`` with ``more`` behind its first ``used`` rows, with room for as many again when it must move."""
    stop = used + len(more)
    if stop > len(held):
        wider = np.empty((max(stop, 2 * len(held)), *held.shape[1:]), held.dtype)
        wider[:used] = held[:used]
        held = wider
    held[used:stop] = more
    return held


_LONGS = pa.list_(pa.int64())


def _documents(folder: str, spelled: bool) -> Callable:
    """What each document has by itself, its distinct id pairs and how many links hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(folder)
        for ids, texts in W.rows_of(batches, 128):
            sums, digests, groups, keys, times = [], [], [], [], []
            for at in memory.read(texts):
                none = at is None
                found = (np.empty(0, np.int64),) * 2 if none else memory.pairs(at)
                sums.append(np.zeros(len(SUMS), np.int64) if none else memory.sums[at].sum(axis=0))
                joined = "" if none else "".join(map(memory.groups.__getitem__, at.tolist()))[:-1]
                digests.append("" if none else hashlib.sha256(joined.encode()).hexdigest())
                groups.append(joined if spelled else None)
                keys.append(found[0])
                times.append(found[1])
            yield pa.record_batch(
                [
                    pa.array(ids, pa.int64()),
                    *(pa.array(c) for c in np.array(sums).T.copy()),
                    pa.array(digests, pa.string()),
                    pa.array(groups, pa.string()),
                    pa.array(keys, _LONGS),
                    pa.array(times, _LONGS),
                ],
                names=["doc_id", *SUMS, "groups_sha256", "groups", "pairs", "times"],
            )
            if len(memory.numbers) > HELD_PIECES:
                memory.clear()

    return run


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], np.cumsum(times[order])
    last = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) if len(keys) else np.empty(0, np.int64)
    return keys[last], np.diff(sums[last], prepend=0)


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each id pair, summed in the task."""
    held = (np.empty(0, np.int64),) * 2
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def rows() -> Iterator[pa.RecordBatch]:
        for start in range(0, len(held[0]), 100_000):
            yield pa.record_batch([pa.array(x[start : start + 100_000]) for x in held], names=["pair", "n"])

    for batch in batches:
        waiting.append(tuple(c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns))
        if sum(len(k) for k, _ in waiting) > 2_000_000:
            held = _summed(*(np.concatenate(x) for x in zip(held, *waiting)))
            waiting = []
            if len(held[0]) > MAX_PAIRS:
                yield from rows()
                held = (np.empty(0, np.int64),) * 2
    held = _summed(*(np.concatenate(x) for x in zip(held, *waiting)))
    yield from rows()


def _looked_up(table) -> Callable:
    """``n_best`` and ``count_sum`` of each document from the counts of all id pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = table.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            own = np.searchsorted(keys, pairs.flatten().to_numpy(zero_copy_only=False))
            links = times.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(pairs).to_numpy(zero_copy_only=False))
            columns = {"n_best": links * best[own], "count_sum": links * counts[own]}
            for name, each in columns.items():
                so_far = np.concatenate([[0], np.cumsum(each)])
                sums = np.diff(so_far[np.concatenate([[0], ends])])
                batch = batch.append_column(name, pa.array(sums, pa.int64()))
            yield batch.drop_columns(["pairs", "times"])

    return run


def _counted(rows: DataFrame) -> DataFrame:
    """``pair`` (its key), ``a``, ``b``, ``n`` links over all documents, and ``best``: ``n`` is the highest of ``b``."""
    found = rows.select("pairs", "times").mapInArrow(_pair_counts, "pair long, n long")
    summed = kept(found.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    most = summed.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return kept(
        summed.select("pair", F.shiftright("pair", ID_BITS).alias("a"), b.alias("b"), "n")
        .join(most, "b")
        .select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best")),
        "pair-counts",
    )


_ROWS = "doc_id long, " + ", ".join(f"{c} long" for c in SUMS) + ", groups_sha256 string, groups string"


def pair_counts(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """``a``, ``b``, ``n`` links over all documents, and ``best``: no other ``a`` has more links with ``b``."""
    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _counted(rows.mapInArrow(_documents(folder, False), f"{_ROWS}, pairs array<long>, times array<long>")).drop("pair")


def aligned(
    docs: DataFrame, folder: str = TOKENIZERS, groups: bool = True, max_pairs: int = MAX_PAIRS
) -> DataFrame:
    """The alignment of every row of ``docs`` (``doc_id``, ``text``) under two tokenizers.

    ``n_a``, ``n_b`` tokens; ``n_groups`` groups cut where tokens of both end; ``n_links`` pairs of overlapping tokens;
    ``n_group_links`` pairs of tokens in one group; ``n_best`` links whose id pair is the corpus' most frequent of its
    second id, ties included; ``count_sum`` of the corpus-wide counts over links; ``groups_sha256`` of the groups
    and, if wanted, ``groups`` as text, ``a1,a2|b1;a3|b2,b3``.

    The first tokenizer encodes a space and the text, the second the text, to which it adds the space. Null and empty texts, and
    those that either tokenizer does not spell byte for byte, have no tokens: zeros and ''. Texts are never cut. Repeated rows
    and rows without an id are documents like others; an empty table gives no rows; further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.mapInArrow(_documents(folder, groups), f"{_ROWS}, pairs array<long>, times array<long>")
    rows = kept(rows.withColumn("row", F.monotonically_increasing_id()), "aligned", compression="zstd")
    counts = _counted(rows)
    if counts.count() <= max_pairs:
        found = counts.select("pair", "n", "best").toArrow().sort_by("pair")
        table = docs.sparkSession.sparkContext.broadcast(tuple(c.to_numpy() for c in found.columns))
        out = rows.drop("row").mapInArrow(_looked_up(table), f"{_ROWS}, n_best long, count_sum long")
    else:
        each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
        sums = (
            each.join(counts.withColumnRenamed("pair", "pairs"), "pairs")
            .groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        )
        out = rows.drop("pairs", "times").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return out.select("doc_id", *SUMS, "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else []))
