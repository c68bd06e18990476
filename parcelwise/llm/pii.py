"""Personal data behind disguises, with spans in the text as it was written.

Detectors for e-mail addresses, IP addresses, payment cards and phone numbers run twice: on the text
itself, whose spans are the *base*, and on a text rewritten by transducers that fold look-alike letters and
digits, spelled digits and ``at``/``dot`` disguises. Every rewritten character knows the source
characters it came from, so what is found there is mapped back. Spans of the second kind are added unless they
lie within a base span of their kind. Each document is handled alone, in time linear in its length.
"""

from __future__ import annotations

import hashlib
import re
import sys
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import words as W

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a run of digits fails whenever the start of that run does.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[Span]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def found(text: str) -> dict[str, list[Span]]:
    """Leftmost matches per kind that do not overlap, without those whose digits fail their test."""
    digits = lambda m: _NOT_DIGIT.sub("", m[0])
    return {
        "email": list(_emails(text)),
        "ip": [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))],
        "card": [m.span() for m in _CARD.finditer(text) if 13 <= len(d := digits(m)) <= 19 and _luhn(d)],
        "phone": [m.span() for m in _PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }


# Look-alikes of ASCII letters, digits and signs. One character for one.
_CYRILLIC = "аАвВеЕкКмМнНоОрРсСтТуУхХіІјЈѕЅԁԛԝһ"
_CYRILLIC_AS = "aABBeEkKMMHHoOpPcCTTyYxXiIjJsSdqwh"
_GREEK = "αΑΒεΕΗιΙκΚΜνΝοΟρΡτΤυΥχΧΖ"
_GREEK_AS = "aABeEHiIkKMvNoOpPtTuYxXZ"
_SIGNS = "＠．＋－（）․﹒｡＿％﹫\u2010\u2011\u2012\u2013\u2014\u2212\u00a0\u2007\u202f\u2009"
_SIGNS_AS = "@.+-()..._%@------    "
_WIDE = {0xFF10 + i: ord("0") + i for i in range(10)}
_WIDE |= {0xFF21 + i: ord("A") + i for i in range(26)} | {0xFF41 + i: ord("a") + i for i in range(26)}
_DIGIT_BLOCKS = (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6)
LOOKALIKES = (
    str.maketrans(_CYRILLIC + _GREEK + _SIGNS, _CYRILLIC_AS + _GREEK_AS + _SIGNS_AS)
    | _WIDE
    | {block + i: ord("0") + i for block in _DIGIT_BLOCKS for i in range(10)}
)
_STRANGE = re.compile("[" + "".join(map(re.escape, map(chr, LOOKALIKES))) + "]")
# Characters without width.
_HIDDEN = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")
# Digits as words in the four languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
MIN_SPELLED = 3  # neighbouring digits, one of them a word, that are read as a number
_AT, _DOT = r"(?:at|arroba|ät|@)", r"(?:dot|punkt|point|punto|\.)"
_NAME = r"[A-Za-z0-9-]+"
_BRACKETED = {
    "@": re.compile(rf"[ ]?[\[({{<][ ]?{_AT}[ ]?[\])}}>][ ]?", re.IGNORECASE),
    ".": re.compile(rf"[ ]?[\[({{<][ ]?{_DOT}[ ]?[\])}}>][ ]?", re.IGNORECASE),
}
_SPOKEN_AT = re.compile(rf"[ ](?:at|arroba|@)[ ](?={_NAME}(?:\.{_NAME})*[ ](?:dot|punkt|punto)[ ]{_NAME})", re.IGNORECASE)
_SPOKEN_DOT = re.compile(rf"(?<=[A-Za-z0-9])[ ](?:dot|punkt|punto)[ ](?={_NAME})", re.IGNORECASE)
_DIGIT_RUN = re.compile(
    rf"(?<![^\W_])(?:{'|'.join(sorted(DIGIT_WORDS, key=len, reverse=True))}|[0-9])"
    rf"(?:[ .-]{{1,2}}(?:{'|'.join(sorted(DIGIT_WORDS, key=len, reverse=True))}|[0-9])(?![^\W_])){{{MIN_SPELLED - 1},}}",
    re.IGNORECASE,
)
_SPELLED = re.compile(rf"(?:{'|'.join(sorted(DIGIT_WORDS, key=len, reverse=True))})", re.IGNORECASE)
_DIGIT_DOT = re.compile(
    rf"(?:[0-9]|(?<![^\W_]){_SPELLED.pattern})([ ](?:dot|punkt|point|punto)[ ])(?=[0-9]|{_SPELLED.pattern}(?![^\W_]))",
    re.IGNORECASE,
)
_ANY_DOT = re.compile(r"[ ](?:dot|punkt|point|punto)[ ]", re.IGNORECASE)
# Four parts of an address, each in digits or up to three spelled ones.
_PART = rf"(?:[0-9]{{1,3}}|{_SPELLED.pattern}(?:[ ]{_SPELLED.pattern}){{0,2}})(?![^\W_])"
_SPELLED_IP = re.compile(rf"(?<![^\W_]){_PART}(?:\.{_PART}){{3}}", re.IGNORECASE)
_PLUS = re.compile(r"\bplus[ ](?=[0-9])", re.IGNORECASE)


class Rewritten:
    """A text with the source span of each of its characters."""

    def __init__(self, source: str):
        self.text = source
        self.starts: list[int] | range = range(len(source))
        self.ends: list[int] | range = range(1, len(source) + 1)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Puts a text in place of each span; a new character stems from the whole span."""
        if not edits:
            return
        text, starts, ends, done = [], [], [], 0
        for a, b, new in edits:
            text += (self.text[done:a], new)
            starts += self.starts[done:a]
            ends += self.ends[done:a]
            starts += [self.starts[a]] * len(new)
            ends += [self.ends[b - 1]] * len(new)
            done = b
        self.text = "".join(text) + self.text[done:]
        self.starts = [*starts, *self.starts[done:]]
        self.ends = [*ends, *self.ends[done:]]

    def rewrite(self, pattern: re.Pattern, new: str) -> None:
        self.replace([(m.start(), m.end(), new) for m in pattern.finditer(self.text)])

    def source(self, span: Span) -> Span:
        return self.starts[span[0]], self.ends[span[1] - 1]


def _digits_for_words(text: str, runs: re.Pattern = _DIGIT_RUN) -> list[tuple[int, int, str]]:
    """One digit for each spelled one of the runs, joined to the digits beside it."""
    edits = []
    for run in runs.finditer(text):
        if not _SPELLED.search(run[0]):
            continue
        for m in _SPELLED.finditer(text, run.start(), run.end()):
            edits.append((m.start(), m.end(), DIGIT_WORDS[m[0].lower()]))
    return edits


def _joined_digits(before: str, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The edits, with a single blank between two of them taken away."""
    out: list[tuple[int, int, str]] = []
    for a, b, new in edits:
        if out and before[out[-1][1] : a] == " ":
            last = out[-1]
            out[-1] = (last[0], a, last[2])
        out.append((a, b, new))
    return out


def rewritten(text: str) -> Rewritten:
    """The text with its disguises undone."""
    out = Rewritten(text)
    if not text.isascii():
        out.text = text.translate(LOOKALIKES) if _STRANGE.search(text) else text
        out.rewrite(_HIDDEN, "")
    for new, pattern in _BRACKETED.items():
        out.rewrite(pattern, new)
    out.rewrite(_SPOKEN_AT, "@")
    if "@" in out.text:
        out.rewrite(_SPOKEN_DOT, ".")
    if _ANY_DOT.search(out.text):
        out.replace([(*m.span(1), ".") for m in _DIGIT_DOT.finditer(out.text)])
    for runs in (_SPELLED_IP, _DIGIT_RUN) if "." in out.text else (_DIGIT_RUN,):
        edits = _digits_for_words(out.text, runs)
        out.replace(_joined_digits(out.text, edits))
    out.rewrite(_PLUS, "+")
    return out


def _within(span: Span, others: list[Span]) -> bool:
    """Whether one of the ``others``, which rise and do not overlap, holds the whole span."""
    k = bisect_right(others, (span[0], sys.maxsize))
    return k > 0 and others[k - 1][1] >= span[1]


def all_spans(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and base spans with those found behind disguises, per kind and by start."""
    text = text or ""
    base = found(text)
    out = {k: list(v) for k, v in base.items()}
    changed = rewritten(text)
    if changed.text != text:
        for kind, spans in found(changed.text).items():
            mapped = dict.fromkeys(changed.source(s) for s in spans)
            out[kind] = sorted(out[kind] + [s for s in mapped if not _within(s, base[kind])])
    return base, out


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in W.rows_of(batches):
        both = [all_spans(t) for t in texts]
        counts = [pa.array([len(base[k]) for base, _ in both], pa.int64()) for k in KINDS]
        digests = [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in both]
        columns = [pa.array(ids, pa.int64()), *counts, pa.array(digests, pa.string())]
        columns.append(pa.array([listed(every) for _, every in both], pa.string()))
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
        yield pa.record_batch(columns, names=names)


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``) the base counts, their digest, and all spans.

    Offsets are code points, the end exclusive. ``base_sha256`` hashes the list of base spans, ``spans``
    lists all of them as ``kind:start:end``, by kind (email, ip, card, phone) and start, joined by commas. A span
    found behind a disguise may hold base spans, which stay beside it. Null
    and empty texts have counts 0, the digest of nothing and an empty list; null ids stay null. Rows are
    independent, so repeated ones give equal results; further columns are ignored.
    """
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _report, f"doc_id long, {counts}, base_sha256 string, spans string"
    )


def redact(text: str) -> str:
    """The text with a label in place of each span; spans that overlap are covered by one label."""
    _, spans = all_spans(text)
    flat = sorted((a, -b, k) for k, v in spans.items() for a, b in v)
    out, done = [], 0
    for a, minus_b, kind in flat:
        if a >= done:
            out += (text[done:a], f"[{kind.upper()}]")
        done = max(done, -minus_b)
    return "".join(out) + text[done:] if flat else text


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by labels such as ``[EMAIL]``.

    All columns and rows stay, in their order; null texts stay null. Where there is an ``n_chars``, it
    counts the characters of the new text (null for null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else redact(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if (n := batch.schema.get_field_index("n_chars")) >= 0:
                sizes = [None if t is None else len(t) for t in texts]
                columns[n] = pa.array(sizes, batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
