"""Language identification of mixed-language text.

Words are runs of letters. The script of a word, from ranges of code points, narrows the languages it
can be in; each of these scores it by its character trigrams. A Viterbi pass over a document's words,
with a penalty for switching language, labels every word, and so spans. The document's language is the
one with the most letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import frames, textvec

UNKNOWN = "und"
BUCKETS = 1 << 16
#: Scripts by ranges of code points (first, last, script).
RANGES = (
    (0x41, 0x5A, "Latin"), (0x61, 0x7A, "Latin"), (0xAA, 0x24F, "Latin"), (0x1E00, 0x1EFF, "Latin"),
    (0x370, 0x3FF, "Greek"), (0x1F00, 0x1FFF, "Greek"),
    (0x400, 0x52F, "Cyrillic"), (0x531, 0x587, "Armenian"), (0x5D0, 0x5F4, "Hebrew"), (0x620, 0x77F, "Arabic"),
    (0x900, 0x97F, "Devanagari"), (0x980, 0x9FF, "Bengali"), (0xB80, 0xBFF, "Tamil"), (0xC00, 0xC7F, "Telugu"), (0xE00, 0xE7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0xAC00, 0xD7AF, "Hangul"),
    (0x3040, 0x30FF, "Kana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0x20000, 0x3FFFF, "Han"),
)
SCRIPTS = ("Other", *dict.fromkeys(r[2] for r in RANGES))

FIELDS = {"lang_pred": "string", "score": "double"}
SPANS = "array<struct<start:int,end:int,lang:string>>"


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # languages x BUCKETS: log probabilities of trigrams
    allowed: np.ndarray  # scripts x languages


_alpha: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the first planes: whether it is a letter, and its script."""
    if not _alpha:
        size = 0x40000
        letters = np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(size)), bool, size)
        script = np.zeros(size, np.int8)
        for low, high, name in RANGES:
            script[low : min(high + 1, size)] = SCRIPTS.index(name)
        _alpha.extend([letters, script])
    return _alpha[0], _alpha[1]


def letters_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of UTF-8 data belong to letters, and the script of each byte's character."""
    letters, script = _tables()
    points = data.astype(np.int32)
    lead = np.flatnonzero(data >= 0xC0)
    wide = np.zeros(len(data), np.int8)
    if len(lead):
        b = data[lead].astype(np.int32)
        size = np.where(b >= 0xF0, 4, np.where(b >= 0xE0, 3, 2))
        padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int32) & 0x3F
        one, two, three = padded[lead + 1], padded[lead + 2], padded[lead + 3]
        cp = np.where(size == 2, (b & 0x1F) << 6 | one, np.where(size == 3, (b & 0x0F) << 12 | one << 6 | two, (b & 0x07) << 18 | one << 12 | two << 6 | three))
        for k in range(4):
            on = (size > k) & (lead + k < len(data))
            points[lead[on] + k] = cp[on]
            wide[lead[on] + k] = 1
    points = np.minimum(points, len(letters) - 1)
    return letters[points], script[points]


def features(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """A bucket for the three bytes around each place; bytes outside words count as a space."""
    own = np.where(inside, textvec.LOWER[data], 32).astype(np.uint32)
    before, after = np.full(len(own), 32, np.uint32), np.full(len(own), 32, np.uint32)
    before[1:], after[:-1] = own[:-1], own[1:]
    return ((before << np.uint32(16) | own << np.uint32(8) | after) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int64)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = 20_000, most: int = 500) -> Model:
    """Learn from rows with a text and a language: about `rows_per_language` of each at most, picked by a
    hash of the text. Trigram and script counts are summed on the cluster; the driver gets at most
    languages x BUCKETS numbers. No usable row gives a model without languages, which answers `und`.
    More than `most` languages raise, as a task holds a table of each: a column with so many is none of languages."""
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(most + 1).collect()}
    if len(sizes) > most:
        raise ValueError(f"{lang} has over {most} values")
    if not sizes:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    names = sorted(sizes)
    share = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, rows_per_language / sizes[n]))])
    rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    code = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), BUCKETS + len(SCRIPTS)), np.int64)
        for table in textvec.sized(batches, "text", frames.CHUNK_BYTES):
            data, offs = textvec.buffers(table.column("text"))
            inside, script = letters_of(data)
            which = np.repeat(np.array([code[x] for x in table.column("lang").to_pylist()], np.int64), np.diff(offs))
            key = which * total.shape[1] + features(data, inside)
            flat = total.reshape(-1)
            flat += np.bincount(key[inside], minlength=total.size)
            heads = inside & ((data & 0xC0) != 0x80)
            flat += np.bincount(which[heads] * total.shape[1] + BUCKETS + script[heads], minlength=total.size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], names=["k", "n"])

    got = rows.mapInArrow(frames.task(count, __name__), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(names) * (BUCKETS + len(SCRIPTS)))
    total[got.column("k").to_numpy()] = got.column("n").to_numpy()
    total = total.reshape(len(names), -1)
    grams, scripts = total[:, :BUCKETS], total[:, BUCKETS:]
    weights = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BUCKETS))
    allowed = (scripts >= 0.01 * scripts.sum(1, keepdims=True)).T & (scripts.T > 0)
    allowed[~allowed.any(1)] = True  # a script that no language was seen in rules out none
    return Model(names, weights.astype(np.float32), allowed)


def viterbi(scores: np.ndarray, words: np.ndarray, penalty: float) -> np.ndarray:
    """Each word's language. scores: words x languages; words: each document's offsets. All documents
    advance together, one word at a time, the longest first."""
    counts = np.diff(words)
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    begin = words[:-1][order]
    n_lang = scores.shape[1]
    came = np.zeros(scores.shape, np.int16)
    out = np.zeros(len(scores), np.int16)
    if not len(scores):
        return out
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # documents with more than t words
    best = np.zeros((len(order), n_lang), np.float32)
    own = np.arange(n_lang, dtype=np.int16)
    for t, a in enumerate(active.tolist()):
        at = begin[:a] + t
        held = best[:a]
        if t:
            top = held.argmax(1)
            other = held[np.arange(a), top][:, None] - penalty
            stay = held >= other
            came[at] = np.where(stay, own, top[:, None])
            held = np.where(stay, held, other)
        best[:a] = held + scores[at]
    state = np.zeros(len(order), np.int16)
    for t in range(int(sizes[0]) - 1, -1, -1):
        a = active[t]
        b = active[t + 1] if t + 1 < len(active) else 0
        if a > b:
            state[b:a] = best[b:a].argmax(1)
        at = begin[:a] + t
        out[at] = state[:a]
        state[:a] = came[at, state[:a]]
    return out


def label(table: pa.Table, text: str, model: Model, penalty: float, spans: bool) -> list:
    data, offs = textvec.buffers(table.column(text))
    inside, script = letters_of(data)
    starts, ends, words = textvec.spans_inside(inside, offs)
    docs, n_lang = len(offs) - 1, len(model.languages)
    if not n_lang or not len(starts):
        return [[UNKNOWN] * docs, np.zeros(docs), *([[[]] * docs] if spans else [])]
    grams = features(data, inside)
    total = np.zeros(len(data) + 1)
    scores = np.empty((len(starts), n_lang), np.float32)
    for k in range(n_lang):
        # trigrams count from a common level, so that sums stay small
        np.cumsum(np.where(inside, model.weights[k][grams] + 10, 0), out=total[1:])
        scores[:, k] = total[ends] - total[starts]
    scores -= scores.max(1, keepdims=True)
    scores[~model.allowed[script[starts]]] -= 1000
    labels = viterbi(scores, words, penalty)
    chars = textvec.code_points(data)
    sizes = chars[ends] - chars[starts]
    doc = textvec.owner(words)
    mass = np.bincount(doc * n_lang + labels, sizes, minlength=docs * n_lang).reshape(docs, n_lang)
    whole = mass.sum(1)
    best = mass.argmax(1)
    some = whole > 0
    names = [model.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
    score = np.where(some, mass[np.arange(docs), best] / np.maximum(whole, 1), 0.0)
    if not spans:
        return [names, score]
    lists: list[list[dict]] = [[] for _ in range(docs)]
    new = np.ones(len(labels), bool)
    new[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(labels)) - 1
    base = chars[offs[:-1]]
    for d, a, b, k in zip(doc[first].tolist(), chars[starts[first]].tolist(), chars[ends[last]].tolist(), labels[first].tolist(), strict=True):
        lists[d].append({"start": a - int(base[d]), "end": b - int(base[d]), "lang": model.languages[k]})
    return [names, score, pa.array(lists, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))]


def identified(df: DataFrame, model: Model, text: str = "text", penalty: float = 12.0, spans: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """df with lang_pred and score (the share of the letters that lie in words of lang_pred), and with
    `spans`, if named: start and end in code points and language of each stretch of words.

    A null or empty text, or one without a letter, is `und` with score 0; ties go to the language that
    sorts first. Rows are judged one by one and whole, so repeated rows get equal results; an empty
    table stays empty. Columns of df with the new names are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    fields = FIELDS | ({spans: SPANS} if spans else {})
    return frames.append(df, text, fields, lambda t: label(t, text, sent.value, penalty, bool(spans)), target=2 * frames.CHUNK_BYTES, keep=keep)
