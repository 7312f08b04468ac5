"""Vectorised text primitives over Arrow batches: byte buffers, word spans and 64-bit word hashes.

Everything works on whole batches with numpy, so no per-word Python runs. A null text is an empty
text throughout. Documents never touch each other: spans stop at document boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: A byte belongs to a word unless it is ASCII white space.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, 9, 10, 11, 12, 13]] = False

#: A byte belongs to a word if it is an ASCII letter or digit, or part of a non-ASCII character.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x41:0x5B] = ALNUM_WORDS[0x61:0x7B] = True
ALNUM_WORDS[0x80:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_CODE = mix64(np.arange(1, 257, dtype=U64))
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


_POWERS = 5 << 19  # that a worker keeps; longer texts make their own


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers[name]
    if len(have) < n:
        grown = np.full(max(n, min(2 * len(have), _POWERS)), base, U64)
        grown[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(grown, dtype=U64)
        if len(have) <= _POWERS:
            _powers[name] = have
    return have[:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(wide) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def sized(batches: Iterator[pa.RecordBatch], text: str, target: int) -> Iterator[pa.Table]:
    """Regroup batches to tables with about target bytes of text each; a single longer text stays whole."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first, ends = 0, np.cumsum(lengths)
        before = 0
        while first < batch.num_rows:
            cut = int(np.searchsorted(ends, before + max(target - size, 1), "left")) + 1
            cut = min(max(cut, first + 1), batch.num_rows)
            held.append(batch.slice(first, cut - first))
            size += int(ends[cut - 1]) - before
            before, first = int(ends[cut - 1]), cut
            if size >= target:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def word_spans(data: np.ndarray, offs: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of every word, and the n + 1 offsets of each document's words."""
    return spans_inside(letters[data], offs)


def spans_inside(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_spans(), given which bytes belong to words."""
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    edges = offs[:-1][np.diff(offs) > 0]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    last = edges[1:] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span's bytes, from one running polynomial sum."""
    total = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE_CODE[data] * _power_table("up", _MULT, len(data)), out=total[1:])
        out = (total[ends] - total[starts]) * _power_table("down", _INV, len(data) + 1)[starts]
        return mix64(out ^ (ends - starts).astype(U64))


def word_hashes(data: np.ndarray, offs: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words, and each document's word offsets."""
    starts, ends, words = word_spans(data, offs, letters)
    return span_hashes(data, starts, ends), starts, ends, words


def owner(offs: np.ndarray) -> np.ndarray:
    """The document of every element, given n + 1 offsets."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def window_hashes(words: np.ndarray, offs: np.ndarray, n: int, short_whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's n-word windows in order, with their offsets.

    With short_whole, a document of 1 to n - 1 words has one window, all its words.
    """
    counts = np.diff(offs)
    full = np.maximum(counts - n + 1, 0)
    out_counts = np.where((counts > 0) & (counts < n), 1, full) if short_whole else full
    out_offs = np.concatenate([[0], np.cumsum(out_counts)])
    # window k of a document starts at its word k
    first = np.repeat(offs[:-1] - out_offs[:-1], out_counts) + np.arange(out_offs[-1])
    width = np.minimum(np.repeat(counts, out_counts), n)
    acc = np.zeros(len(first), U64)
    with np.errstate(over="ignore"):
        for k in range(n):
            on = width > k
            if on.all():
                acc = (acc ^ words[first + k]) * _MULT
                acc ^= acc >> U64(29)
            elif on.any():
                part = (acc[on] ^ words[first[on] + k]) * _MULT
                acc[on] = part ^ (part >> U64(29))
        return mix64(acc ^ width.astype(U64)), out_offs


def code_points(data: np.ndarray) -> np.ndarray:
    """Running count of characters before each byte (n + 1 values) of UTF-8 data."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
