"""Quality rules: word and line statistics, and repetition measured on a suffix array.

For each document the suffixes of its word sequence are sorted; runs of suffixes with a longest
common prefix (LCP intervals) are its repeated substrings. The maximal ones, which cannot be
extended to either side, of `min_repeat` words or more give spans; their union's share of the words
and the longest of them are limited.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keelson.llm import frames, textvec
from keelson.llm.suffixes import SuffixRanks, dense_ranks


@dataclass(frozen=True)
class QualityLimits:
    """min_words, max_repeat_percent (words in repeated 5-word windows): base rules. The others: the
    suffix-array rule; a document goes if over max_cover_percent of its words lie in repeats of
    min_repeat words or more, or its longest repeat has over max_longest words."""

    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20
    min_repeat: int = 8
    max_cover_percent: int = 15
    max_longest: int = 100


FIELDS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "n_covered_words": "long", "longest_repeat": "long", "base_failed": "boolean", "kept": "boolean",
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:n]) > 0


def per_doc(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def repeats(words: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each word place, the length of the longest string from there that occurs again in its document."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    doc = textvec.owner(offs).astype(np.uint64)
    # a document's words are symbols of its own, so common prefixes stay inside it
    _, symbols, _ = dense_ranks(textvec.mix64(words ^ textvec.mix64(doc + np.uint64(1))))
    ranks = SuffixRanks(symbols, n)
    lcp = ranks.neighbour_lcp()
    most = lcp.copy()
    most[:-1] = np.maximum(most[:-1], lcp[1:])
    out = np.empty(n, np.int64)
    out[ranks.order] = most
    return out


def measure(table: pa.Table, text: str, limits: QualityLimits) -> list[np.ndarray]:
    data, offs = textvec.buffers(table.column(text))
    hashes, starts, ends, words = textvec.word_hashes(data, offs, textvec.SPACE_WORDS)
    n_words = np.diff(words)
    chars = textvec.code_points(data)
    span_chars = chars[ends] - chars[starts]
    word_chars = per_doc(span_chars, words)
    n_symbols = per_doc(_SYMBOL[data], offs)

    # lines, each with its document; the ends of documents end lines too
    breaks = np.flatnonzero(data == 10)
    line_starts = np.union1d(offs[:-1], breaks + 1)
    line_starts = line_starts[line_starts < len(data)] if len(data) else line_starts[:0]
    line_doc = np.searchsorted(offs, line_starts, "right") - 1
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), offs[line_doc + 1]) if len(line_starts) else line_starts
    trimmed = line_ends - (data[np.maximum(line_ends - 1, 0)] == 10) * (line_ends > line_starts) if len(line_starts) else line_ends
    worded = np.searchsorted(starts, trimmed) > np.searchsorted(starts, line_starts)
    keys = textvec.span_hashes(data, line_starts[worded], trimmed[worded]) ^ textvec.mix64(line_doc[worded].astype(np.uint64) + np.uint64(7))
    order, rank, _ = dense_ranks(textvec.mix64(keys))
    again = np.zeros(len(keys), bool)
    held = rank[order]
    again[1:] = held[1:] == held[:-1]
    n_dup_lines = np.bincount(line_doc[worded][order][again], minlength=len(offs) - 1)

    longest = repeats(hashes, words)
    window = longest >= limits.window
    at = np.flatnonzero(window)
    n_repeat = per_doc(covered(at, np.full(len(at), limits.window), len(hashes)), words)
    # of the repeats, those that the word before does not extend are maximal on the left
    grown = np.zeros(len(hashes), bool)
    grown[1:] = longest[:-1] == longest[1:] + 1
    at = np.flatnonzero((longest >= limits.min_repeat) & ~grown)
    n_covered = per_doc(covered(at, longest[at], len(hashes)), words)
    most = np.zeros(len(offs) - 1, np.int64)
    np.maximum.at(most, textvec.owner(words), longest)

    failed = (n_words < limits.min_words) | (100 * n_repeat > limits.max_repeat_percent * n_words)
    bad = (100 * n_covered > limits.max_cover_percent * n_words) | (most > limits.max_longest)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat, n_covered, most, failed, ~(failed | bad)]


def quality_rules(df: DataFrame, text: str = "text", limits: QualityLimits = QualityLimits(), fields: dict[str, str] | None = None) -> DataFrame:
    """df with the columns of FIELDS, or as `fields` renames them; `kept` is the verdict.

    A null text counts as empty: no words, base_failed, not kept. Rows are judged one by one, so
    repeated rows and ties get equal results; an empty table gives an empty result. Columns of df
    with the new names are replaced, all others are handed on. Words are split at ASCII white space;
    lines at \\n, and only lines with a word count. Texts of any length are processed whole.
    """
    return frames.append(df, text, {(fields or {}).get(n, n): k for n, k in FIELDS.items()}, lambda t: measure(t, text, limits))
