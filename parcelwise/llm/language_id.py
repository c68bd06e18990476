"""Language identification by fusing the evidence of text, markup, address and host.

The posterior of a language multiplies what four kinds of evidence say about it: the likelihood of the text under
byte trigrams, that of the declared markup language and of the address suffix, and a prior of the host. The
likelihoods of declarations and suffixes, and the priors, are learned by grouped aggregation from what the texts
alone say; host priors are smoothed by their domain's, those by the corpus', and leave out the row itself.
A further hypothesis, that no known language wrote the text, has all trigrams alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import words as W
from parcelwise.llm.tables import kept

LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
CELLS = 1 << 14
FULL_EVIDENCE = 60.0  # trigrams; a long text counts as so many independent ones
HOST_WEIGHT = 20.0  # documents that a parent's prior counts as
TABLE_WEIGHT = 2.0  # documents that the smoothing of declarations and suffixes counts as
UNKNOWN_PRIOR = 0.01
MIN_POSTERIOR = 0.5


# Bytes as lower-case letters; all bytes above ASCII count as letters.
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def _trigrams(text: str | None) -> np.ndarray:
    """Cells of the byte trigrams of the lower-cased text; digits, signs and blanks are one blank."""
    raw = np.frombuffer(W.encoded(text).translate(_LETTERS), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    code = code[(code != 0x202020)]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def _counts(languages: tuple[str, ...]) -> Callable:
    schema = pa.schema([("at", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), CELLS), np.int64)
        place = {name: k for k, name in enumerate(languages)}
        for declared, texts in W.rows_of(batches):
            for name, k in place.items():
                mine = [_trigrams(t) for d, t in zip(declared, texts, strict=True) if d == name]
                if mine:
                    total[k] += np.bincount(np.concatenate(mine), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total.ravel()[at])], schema=schema)

    return run


def text_model(rows: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Log likelihoods of trigram cells by language, from all rows (``declared``, ``text``).

    Rows of no or another declared language say nothing. What reaches the driver are counts of a fixed number
    of cells. A language without rows has all cells alike.
    """
    counted = (
        rows.where(F.col("declared").isin(*languages))
        .select("declared", "text")
        .mapInArrow(_counts(languages), "at long, n long")
        .groupBy("at")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    counts = np.full(len(languages) * CELLS, 0.5)
    counts[counted["at"].to_numpy(np.int64)] += counted["n"].to_numpy(np.float64)
    counts = counts.reshape(len(languages), CELLS)
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _scores(model: np.ndarray) -> Callable:
    """Log likelihood of each language against all cells alike, and the number of trigrams."""
    table = (model + np.log(CELLS)).T.copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            sizes, scores = [], []
            for text in batch.column(at).to_pylist():
                cells = _trigrams(text)
                sizes.append(len(cells))
                weight = len(cells) * FULL_EVIDENCE / (len(cells) + FULL_EVIDENCE)
                scores.append((table[cells].mean(axis=0) if len(cells) else np.zeros(table.shape[1])) * weight)
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            names = [f for i, f in enumerate(batch.schema.names) if i != at]
            matrix = np.array(scores, np.float64).reshape(len(sizes), -1)
            every = [pa.array(matrix[:, k]) for k in range(table.shape[1])]
            yield pa.record_batch(
                [*rest, pa.array(sizes, pa.int64()), *every],
                names=[*names, "n_trigrams", *(f"text_{k}" for k in range(len(every)))],
            )

    return run


def _normalised(columns: list[Column]) -> list[Column]:
    """Probabilities of log weights."""
    top = F.greatest(*columns)
    parts = [F.exp(c - top) for c in columns]
    whole = sum(parts[1:], parts[0])
    return [p / whole for p in parts]


def _sums(rows: DataFrame, key: str, n: int, prefix: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        *(F.sum(f"own_{k}").alias(f"{prefix}_{k}") for k in range(n))
    )


def identify(
    rows: DataFrame, key: list[str], model: np.ndarray, languages: tuple[str, ...] = LANGUAGES
) -> DataFrame:
    """The ``key`` columns with ``language``, ``posterior``, ``text_language``, ``n_trigrams``, ``accepted``.

    ``rows`` has the key, ``text``, ``declared``, ``suffix`` and ``host``. A row is accepted if a
    known language has a posterior of ``MIN_POSTERIOR`` and the text has at least one trigram of letters. Null
    declarations, suffixes and hosts are no evidence; null or empty texts leave the language to the other
    evidence and are not accepted. Equal posteriors go to the first language by name. Repeated rows
    count as often as they stand; an empty table gives no rows. Any number of distinct hosts, suffixes and
    declarations is joined, none is collected.
    """
    n = len(languages)
    fields = ", ".join(f"text_{k} double" for k in range(n))
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key)
    scored = rows.select(*key, "declared", "suffix", "host", "text").mapInArrow(
        _scores(model), f"{types}, declared string, suffix string, host string, n_trigrams long, {fields}"
    )
    own = _normalised([F.col(f"text_{k}") for k in range(n)])
    domain = F.regexp_extract(F.col("host"), r"([^.]+(?:\.[^.]+)?)$", 1)
    scored = kept(scored.select("*", *(p.alias(f"own_{k}") for k, p in enumerate(own)), domain.alias("domain")), "scored")

    overall = scored.agg(*(F.sum(f"own_{k}") for k in range(n)), F.count("*")).first()
    total = [float(x or 0) for x in overall[:n]]
    size = sum(total)
    base = [(t + 1) / (size + n) for t in total]
    weigh = scored
    for name, column in (("declared", "declared"), ("suffix", "suffix"), ("domain", "domain"), ("host", "host")):
        weigh = weigh.join(_sums(scored, column, n, name), column, "left")

    def said(name: str, k: int) -> Column:
        """Log likelihood of a declaration or suffix in a language, without the row itself."""
        seen = [F.col(f"{name}_{j}") - F.col(f"own_{j}") for j in range(n)]
        share = (sum(seen[1:], seen[0]) + TABLE_WEIGHT) / (size + TABLE_WEIGHT)
        here = (seen[k] + TABLE_WEIGHT * share) / (max(total[k], 1e-9) + TABLE_WEIGHT)
        return F.coalesce(F.log(F.greatest(here, F.lit(1e-9)) / share), F.lit(0.0))

    def prior(k: int) -> Column:
        def level(name: str, parent: Column) -> Column:
            seen = [F.greatest(F.col(f"{name}_{j}") - F.col(f"own_{j}"), F.lit(0.0)) for j in range(n)]
            return F.coalesce((seen[k] + HOST_WEIGHT * parent) / (sum(seen[1:], seen[0]) + HOST_WEIGHT), parent)

        return F.log(level("host", level("domain", F.lit(base[k]))))

    logs = [F.col(f"text_{k}") + said("declared", k) + said("suffix", k) + prior(k) for k in range(n)]
    weigh = weigh.select(*key, "n_trigrams", *(F.col(f"text_{k}") for k in range(n)), *(c.alias(f"log_{k}") for k, c in enumerate(logs)))
    every = _normalised([*(F.col(f"log_{k}") + float(np.log1p(-UNKNOWN_PRIOR)) for k in range(n)), F.lit(float(np.log(UNKNOWN_PRIOR)))])
    names = [*languages, UNKNOWN]

    def best(columns: list[Column], labels: list[str]) -> Column:
        top = F.greatest(*columns)
        out = F.lit(labels[-1])
        for c, label in list(zip(columns, labels, strict=True))[-2::-1]:
            out = F.when(c == top, label).otherwise(out)
        return out

    posts = weigh.select(
        *key, "n_trigrams", *(F.col(f"text_{k}") for k in range(n)), *(p.alias(f"post_{k}") for k, p in enumerate(every))
    )
    post = [F.col(f"post_{k}") for k in range(n + 1)]
    text_language = F.when(F.col("n_trigrams") > 0, best([F.col(f"text_{k}") for k in range(n)], list(languages)))
    out = posts.select(
        *key,
        best(post, names).alias("language"),
        F.greatest(*post).alias("posterior"),
        text_language.alias("text_language"),
        "n_trigrams",
    )
    sure = (F.col("language") != UNKNOWN) & (F.col("posterior") >= MIN_POSTERIOR) & (F.col("n_trigrams") > 0)
    return out.withColumn("accepted", sure)


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents as rows of evidence: ``lang`` is the declared language, ``source`` the host."""
    return docs.select(
        "doc_id",
        "text",
        F.lower("lang").alias("declared"),
        F.lit(None).cast("string").alias("suffix"),
        F.col("source").alias("host"),
        F.xxhash64("text").alias("text_key"),
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """Web pages as rows of evidence: visible text, ``lang`` of the root element, host and its suffix."""
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    text = F.regexp_replace("html", r"(?is)<(script|style|title)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#a-zA-Z0-9]+;", " ")
    host = F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    suffix = F.regexp_extract(host, r"\.([a-z]+)$", 1)
    return pages.select(
        "page_id",
        text.alias("text"),
        F.when(declared != "", declared).alias("declared"),
        F.when(suffix != "", suffix).alias("suffix"),
        host.alias("host"),
    )


def document_languages(docs: DataFrame) -> DataFrame:
    """The language of each document, keyed by ``doc_id`` and ``text_key``, the hash of its text."""
    evidence = document_evidence(docs)
    return identify(evidence, ["doc_id", "text_key"], text_model(evidence))


def page_languages(pages: DataFrame) -> DataFrame:
    evidence = page_evidence(pages)
    return identify(evidence, ["page_id"], text_model(evidence))


def with_known_language(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is not accepted; all columns stay.

    The decisions are written before they are filtered: pushed below them, the filter would repeat the formula of
    each probability within the next one and fill the driver's memory with the plan.
    """
    out = kept(document_languages(docs), "languages").where(~F.col("accepted")).select(
        F.col("doc_id").alias("out_id"), F.col("text_key").alias("out_key")
    )
    same = docs["doc_id"].eqNullSafe(out["out_id"]) & F.xxhash64(docs["text"]).eqNullSafe(out["out_key"])
    return docs.join(out.distinct(), same, "left_anti")
