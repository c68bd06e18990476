"""Statistics of whole documents that quality models use."""

from __future__ import annotations

import numpy as np

from parcelwise.llm import words as W

# The symbols counted.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
_UPPER, _LOWER, _DIGITS = (bytes(range(ord(a), ord(b) + 1)) for a, b in ("AZ", "az", "09"))
_POINTS, _MARKS = b".,;:", b"!?"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words",
    "symbols_per_word",
    "dup_line_share",
    "repeat_share",
    "word_length",
    "upper_share",
    "digit_share",
    "mark_share",
    "point_share",
    "distinct_share",
    "top_share",
    "echo_share",
    "lines_per_word",
    "ascii_share",
)


def base_counts(text: str | None) -> tuple[list[int], list[bytes], np.ndarray]:
    """The counts of ``BASE``, the words and their hashes."""
    text = text or ""
    tokens = W.words(text)
    hashes = W.word_hashes(tokens)
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    counts = [
        len(tokens),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        int(W.repeated_windows(hashes, 5).sum()),
    ]
    return counts, tokens, hashes


def _share(raw: bytes, kind: bytes) -> float:
    return (len(raw) - len(raw.translate(None, kind))) / max(1, len(raw))


def document(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of ``BASE`` and the values of ``FEATURES``, all 0 without words but for shares of nothing."""
    counts, tokens, hashes = base_counts(text)
    n = max(1, len(tokens))
    raw = b"".join(tokens)
    _, times = np.unique(hashes, return_counts=True)
    n_lines = (text or "").count("\n") + 1
    return counts, [
        float(np.log1p(counts[0])),
        min(20.0, counts[2] / n),
        counts[3] / n_lines,
        counts[4] / n,
        min(40.0, counts[1] / n),
        _share(raw, _UPPER),
        _share(raw, _DIGITS),
        _share(raw, _MARKS),
        _share(raw, _POINTS),
        len(times) / n,
        float(times.max()) / n if len(times) else 0.0,
        float((hashes[1:] == hashes[:-1]).sum()) / n,
        n_lines / n,
        _share(raw, _LOWER) + _share(raw, _UPPER),
    ]
