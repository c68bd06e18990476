"""Toxicity by weak supervision.

Many voters, words and word beginnings of a lexicon and patterns of writing, each say little about a document.
The lexicon is mined from labelled rows by grouped counts. A generative label model estimates from the votes
of all documents, labelled or not, how often each voter speaks in either class and how voters depend on each other
within a class; dependent voters share their weight. Its posteriors are the labels a linear classifier on hashed
words is trained on, which then scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import words as W
from parcelwise.llm.tables import crc_mod, kept

FOLDS, HELD_OUT = 4, 2
STEMS = (4, 5)  # lengths of word beginnings, in characters
MAX_LEXICON = 56  # lexicon voters; with the patterns they fit the bits of a long
MAX_LEXICON_ROWS = 200_000  # labelled rows the lexicon is mined from, by hash of the id; 3 MB of ids and labels
MIN_SUPPORT, MIN_SUPPORT_SHARE = 5, 0.02  # toxic documents that hold a lexicon entry, at least
MIN_LOG_ODDS = 2.0
EM_ROUNDS = 1
LABEL_ACCURACY = 0.98  # of a given label, as a voter beside the others
MAX_TRAINING_ROWS = 6_000  # documents the linear classifier is fitted to, by hash of the id
CELLS = 1 << 13
STEPS, RATE, RIDGE = 120, 0.5, 1e-5
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")
Lexicon = tuple[str, ...]  # words, and beginnings marked by a closing "*"


def _entries(text: str | None) -> set[str]:
    """The words of a text and the beginnings of longer words."""
    found = set(_WORD.findall((text or "").lower()))
    return found | {w[:k] + "*" for w in found for k in STEMS if len(w) > k}


#: Patterns of writing that vote beside the lexicon: shouting, exclamation, masked letters, echo, and long words.
def _patterns(text: str | None) -> list[bool]:
    raw = W.encoded(text)
    tokens = raw.split()
    n = max(1, len(tokens))
    upper = sum(t.isupper() for t in tokens)
    return [
        upper > 0.3 * n,
        raw.count(b"!") > 0.1 * n,
        raw.count(b"*") > 0.1 * n,
        sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) > 0.3 * n,
        raw.count(b"|") > 0.3 * n,
    ]


N_PATTERNS = 5


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task how many documents of either label hold an entry."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for texts, labels in W.rows_of(batches):
        for text, label in zip(texts, labels, strict=True):
            counts[label].update(_entries(text))
    entries = list(counts[0].keys() | counts[1].keys())
    for start in range(0, len(entries), 50_000):
        part = entries[start : start + 50_000]
        yield pa.record_batch(
            [pa.array(part, pa.string()), *(pa.array([counts[k][e] for e in part], pa.int64()) for k in (1, 0))],
            names=["entry", "toxic", "clean"],
        )


def training_labels(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``label`` outside the held-out fold; the larger of several labels of one id."""
    return (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("long").alias("label"))
    )


def _lexicon_rows(labels: DataFrame) -> DataFrame:
    """All labels if there are no more than ``MAX_LEXICON_ROWS``, else about so many, chosen by a hash of the id."""
    n = labels.count()
    if n <= MAX_LEXICON_ROWS:
        return labels
    cells = 1 << 32
    return labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(cells)) < cells * MAX_LEXICON_ROWS // n)


def mine_lexicon(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, float]:
    """The entries that speak most for label 1, and the share of label 1.

    Entries are ranked by support times log odds; of entries that begin alike the first one stays. What reaches the
    driver are the best ``20 * MAX_LEXICON`` entries of counts over ``MAX_LEXICON_ROWS`` labelled documents. Their
    labels go to the texts, so no text is shuffled.
    """
    few = F.broadcast(_lexicon_rows(labels))  # about MAX_LEXICON_ROWS rows at most
    rows = docs.select("doc_id", "text").join(few, "doc_id").select("text", "label")
    sizes = rows.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    toxic, clean = int(sizes["toxic"] or 0), int(sizes["n"] - (sizes["toxic"] or 0))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    best = (
        rows.mapInArrow(_counted, "entry string, toxic long, clean long")
        .groupBy("entry")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= max(MIN_SUPPORT, MIN_SUPPORT_SHARE * toxic))
        .withColumn("odds", odds)
        .where(F.col("odds") >= MIN_LOG_ODDS)
        .orderBy(F.desc(F.col("toxic") * F.col("odds")), F.desc(F.length("entry")), "entry")
        .limit(20 * MAX_LEXICON)
        .collect()
    )
    chosen: list[str] = []
    for row in best:
        stem = row["entry"].rstrip("*")
        if not any(stem.startswith(c.rstrip("*")) or c.startswith(stem) for c in chosen):
            chosen.append(row["entry"])
    return tuple(chosen[:MAX_LEXICON]), (toxic + 1) / (toxic + clean + 2)


def _votes(lexicon: Lexicon) -> Callable:
    bits = {entry: 1 << k for k, entry in enumerate(lexicon)}

    def of(text: str | None, entries: set[str]) -> int:
        out = sum(bits[e] for e in entries & bits.keys())
        return out | sum(1 << (len(bits) + k) for k, said in enumerate(_patterns(text)) if said)

    return of


def _vote_rows(lexicon: Lexicon) -> Callable:
    of = _votes(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in W.rows_of(batches):
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array([of(t, _entries(t)) for t in texts], pa.int64())], names=["doc_id", "votes"]
            )

    return run


def _unpacked(votes: np.ndarray, n: int) -> np.ndarray:
    return ((votes[:, None] >> np.arange(n)) & 1).astype(float)


@dataclass
class LabelModel:
    """P(vote | class) for two classes, the class shares, and the weight a voter keeps beside dependent ones."""

    speaks: np.ndarray  # (2, voters)
    share: float
    weight: np.ndarray  # (voters,)
    correlation: np.ndarray  # (voters, voters), within classes

    def posterior(self, votes: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        """P(class 1) by votes and, where there is one (not NaN), the given label."""
        yes = np.log(self.speaks[1] / self.speaks[0])
        no = np.log((1 - self.speaks[1]) / (1 - self.speaks[0]))
        logit = np.log(self.share / (1 - self.share)) + (votes * yes + (1 - votes) * no) @ self.weight
        if label is not None:
            logit = logit + np.nan_to_num((2 * label - 1) * np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY)))
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def label_model(count: np.ndarray, single: np.ndarray, pair: np.ndarray, share: float) -> LabelModel:
    """The model of expected class counts (2,), votes (2, n) and joint votes (2, n, n)."""
    speaks = (single + 0.5) / (count[:, None] + 1)
    cov = sum(pair[k] - count[k] * np.outer(speaks[k], speaks[k]) for k in (0, 1)) / max(1.0, count.sum())
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    correlation = np.clip(cov / np.outer(spread, spread), -1, 1)
    np.fill_diagonal(correlation, 1.0)
    weight = 1 / np.maximum(correlation, 0).clip(0, 1).sum(axis=1)
    return LabelModel(speaks, share, weight, correlation)


def _expected(model: LabelModel | None, n: int) -> Callable:
    """Per task the expected counts under a model; labelled rows are certain, others silent without a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + n + n * n))
        for batch in batches:
            votes = _unpacked(batch.column(0).to_numpy(zero_copy_only=False), n)
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            known = ~np.isnan(label)
            toxic = np.where(known, np.nan_to_num(label), model.posterior(votes) if model else 0.0)
            for k, p in ((1, toxic), (0, (1 - toxic) * (known | bool(model)))):
                held = votes * p[:, None]
                sums[k] += np.concatenate([[p.sum()], held.sum(axis=0), (votes.T @ held).ravel()])
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at), pa.array(sums.ravel()[at])], names=["at", "value"])

    return run


def fit_label_model(votes: DataFrame, n: int, share: float) -> LabelModel:
    """Expectation maximisation over all rows (``votes``, ``label`` or null), started from the labelled ones.

    Each round is one aggregation to a fixed number of sums.
    """
    model = None
    for _ in range(1 + EM_ROUNDS):
        sums = (
            votes.select("votes", "label")
            .mapInArrow(_expected(model, n), "at long, value double")
            .groupBy("at")
            .agg(F.sum("value").alias("value"))
            .toPandas()
        )
        flat = np.zeros(2 * (1 + n + n * n))
        flat[sums["at"].to_numpy(np.int64)] = sums["value"].to_numpy()
        flat = flat.reshape(2, -1)
        model = label_model(flat[:, 0], flat[:, 1 : 1 + n], flat[:, 1 + n :].reshape(2, n, n), share)
    return model


def _columns(entries: set[str], votes: int, n: int) -> np.ndarray:
    """Columns of the linear classifier that a document has: its voters, then hashed words and beginnings."""
    cells = {n + xxhash.xxh3_64_intdigest(e) % CELLS for e in entries}
    return np.array([k for k in range(n) if votes >> k & 1] + sorted(cells), np.int64)


def _values(columns: np.ndarray, n: int) -> np.ndarray:
    """1 for a voter; words share 1 by their squares, so that long documents do not outweigh short ones."""
    words = columns >= n
    return np.where(words, 1 / np.sqrt(max(1, int(words.sum()))), 1.0)


def _linear_rows(lexicon: Lexicon, model: LabelModel) -> Callable:
    of, n = _votes(lexicon), len(lexicon) + N_PATTERNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, labels in W.rows_of(batches):
            entries = [_entries(t) for t in texts]
            votes = [of(t, e) for t, e in zip(texts, entries, strict=True)]
            known = np.array([np.nan if y is None else y for y in labels], float)
            target = model.posterior(_unpacked(np.array(votes, np.int64), n), known)
            columns = [_columns(e, v, n) for e, v in zip(entries, votes, strict=True)]
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(columns, pa.list_(pa.int64())), pa.array(target)],
                names=["doc_id", "columns", "target"],
            )

    return run


@dataclass
class Toxicity:
    lexicon: Lexicon
    weights: np.ndarray
    start: float
    labels: LabelModel

    def score(self, text: str | None, of: Callable) -> float:
        n = len(self.lexicon) + N_PATTERNS
        entries = _entries(text)
        columns = _columns(entries, of(text, entries), n)
        z = self.start + self.weights[columns] @ _values(columns, n)
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _fit_linear(columns: list[np.ndarray], target: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by gradient steps scaled for each weight."""
    width = n + CELLS
    weights, start = np.zeros(width), float(np.log((target.sum() + 0.5) / (len(target) - target.sum() + 0.5)))
    if not columns:
        return weights, start
    at = np.concatenate(columns)
    row = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    value = np.concatenate([_values(c, n) for c in columns])
    seen, seen_start = np.full(width, 1e-8), 1e-8
    for _ in range(STEPS):
        z = start + np.bincount(row, weights[at] * value, len(columns))
        error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        slope = np.bincount(at, error[row] * value, width) / len(columns) + RIDGE * weights
        seen += slope**2
        weights -= RATE * slope / np.sqrt(seen)
        seen_start += float(error.mean()) ** 2
        start -= RATE * float(error.mean()) / seen_start**0.5
    return weights, start


def train(docs: DataFrame, labels: DataFrame) -> Toxicity:
    """The lexicon, the label model and the linear classifier, from rows outside the held-out fold.

    The lexicon is mined from about ``MAX_LEXICON_ROWS`` labelled documents at most, and the linear classifier fitted to
    at most ``MAX_TRAINING_ROWS`` documents, labelled or not, with posterior labels; the label model counts all documents.
    """
    learnt = kept(training_labels(labels), "labels")
    lexicon, share = mine_lexicon(docs, learnt)
    n = len(lexicon) + N_PATTERNS
    ours = docs.select("doc_id", "text").where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
    votes = kept(ours.mapInArrow(_vote_rows(lexicon), "doc_id long, votes long").join(learnt, "doc_id", "left"), "votes")
    model = fit_label_model(votes, n, share)
    chosen = (
        votes.where("doc_id IS NOT NULL").select("doc_id", "label").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAINING_ROWS)
    )
    rows = (
        ours.join(F.broadcast(chosen), "doc_id")  # at most MAX_TRAINING_ROWS ids
        .select(F.col("doc_id").cast("long"), "text", "label")
        .mapInArrow(_linear_rows(lexicon, model), "doc_id long, columns array<long>, target double")
        .groupBy("doc_id")
        .agg(F.min(F.struct("columns", "target")).alias("row"))  # a repeated id sends one row, the least of its texts
        .select("row.*")
        .toArrow()
    )
    lists, target = rows["columns"].combine_chunks(), rows["target"].to_numpy()
    columns = np.split(lists.flatten().to_numpy(), lists.offsets.to_numpy()[1:-1]) if len(lists) else []
    order = sorted(range(len(columns)), key=lambda i: columns[i].tobytes())  # the same sums for any order of rows
    weights, start = _fit_linear([columns[i] for i in order], target[order], n)
    return Toxicity(lexicon, weights, start, model)


def _scored(model: Toxicity) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _votes(model.lexicon)
        for ids, texts in W.rows_of(batches):
            scores = [round(model.score(t, of), 6) for t in texts]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(scores)], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, model: Toxicity) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row of ``docs`` (``doc_id``, ``text``).

    Null and empty texts have no voter and no word, so they score as the classifier's constant; null ids stay
    null and count as the empty text for the fold. Repeated rows score alike; an empty table gives no rows; further
    columns are ignored.
    """
    return (
        docs.select(F.col("doc_id").cast("long"), "text")
        .mapInArrow(_scored(model), "doc_id long, score double")
        .select(
            "doc_id",
            (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
            "score",
            (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        )
    )
