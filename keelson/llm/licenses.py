"""License scans: winnowed fingerprints pick candidate templates, a banded alignment confirms them.

Templates are cut into words; hashes of short word grams are winnowed and kept in an inverted index. A
document's grams are looked up; hits of one template whose places rise together form a chain, over insertions
and deletions of up to `gap` words. A chain is a candidate, and an alignment of the template's words with the
document's words, in a band around the chain's diagonals, counts what matches. A candidate whose matched share
of the template reaches `coverage` is reported with its span.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import frames, textvec
from keelson.llm.license_texts import TEMPLATES

SPAN = "array<struct<license:string,start:int,end:int,coverage:double>>"
FIELDS = {"n_licenses": "long", "licenses": "string", "best_coverage": "double", "spans_sha256": "string", "spans": "string"}


@dataclass(frozen=True)
class ScanRule:
    """gram: words hashed together. window: of grams, one of each kept in the index. band: how far an
    alignment may leave its chain's diagonals, a quarter of the template's words at most. gap: by how many words the
    diagonals of neighbouring hits may differ, two thirds of the template's words at most. coverage: the least matched
    share of a template's words."""

    gram: int = 3
    window: int = 3
    band: int = 6
    gap: int = 24
    coverage: float = 0.8


def _words(texts: pa.Array | pa.ChunkedArray):
    data, offs = textvec.buffers(texts)
    return data, offs, *textvec.word_hashes(textvec.LOWER[data], offs, textvec.ALNUM_WORDS)


class Index:
    """Templates' words, and their winnowed fingerprints: sorted hashes with template and place."""

    def __init__(self, templates: dict[str, str], rule: ScanRule):
        self.names = sorted(templates)
        _, _, hashes, _, _, words = _words(pa.array([templates[n] for n in self.names], pa.string()))
        self.words = [hashes[words[i] : words[i + 1]] for i in range(len(self.names))]
        entries = set()
        for t, own in enumerate(self.words):
            grams, _ = textvec.window_hashes(own, np.array([0, len(own)]), rule.gram)
            if len(own) < rule.window + rule.gram:  # winnowing would leave too few of a short template
                entries.update((int(g), t, at) for at, g in enumerate(grams))
            for k in range(max(1, len(grams) - rule.window + 1)):
                part = grams[k : k + rule.window]
                if len(part):
                    at = k + len(part) - 1 - int(part[::-1].argmin())  # the last of equal ones
                    entries.add((int(grams[at]), t, at))
        rows = sorted(entries)
        self.hashes = np.array([r[0] for r in rows], np.uint64)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)


def _matched(template: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """The most template words that document words match in order, and the first document place up to which they do;
    place less template place is low to high. A row of the alignment is one integer, a bit for each template word."""
    places: dict[int, int] = {}
    for i, word in enumerate(template.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(template)) - 1
    row, best, end = full, 0, -1  # a 0 in the row is a template word at which one more is matched
    begin = max(0, low)
    for j, word in enumerate(words[begin : max(0, high + len(template))].tolist(), begin):
        hit = places.get(word)
        if hit is None:
            continue
        hit &= (1 << max(j - low + 1, 0)) - 1 & -1 << max(j - high, 0) & full
        if hit := row & hit:
            row = (row + hit | row - hit) & full
            if (count := len(template) - row.bit_count()) > best:
                best, end = count, j
    return best, end


def align(template: np.ndarray, words: np.ndarray, shift: int, band: int, until: int | None = None) -> tuple[int, int, int]:
    """The most template words matched in order by document words within `band` of the diagonals
    document place = template place + (shift to until); and the first and last matched document places."""
    low, high = shift - band, (shift if until is None else until) + band
    count, last = _matched(template, words, low, high)
    if not count:
        return 0, -1, -1
    # backwards from there: the diagonals of the turned sequences
    turn = last + 1 - len(template)
    _, first = _matched(template[::-1], words[: last + 1][::-1], turn - high, turn - low)
    return count, last - first, last


def chains(hits: list[tuple[int, int]], gap: int, length: int) -> list[tuple[int, int]]:
    """Least and greatest diagonal of each chain of hits (document place, template place): along a chain both rise,
    and the diagonal changes by at most `gap` from one hit to the next. length: of the template."""
    hits = sorted(set(hits))
    score, before = [], []
    for i, (at, place) in enumerate(hits):
        best, come = 0.0, -1
        for q in range(i - 1, -1, -1):
            at_q, place_q = hits[q]
            if at - at_q > gap + length:
                break
            apart = abs(at - place - at_q + place_q)
            if at_q < at and place_q < place and apart <= gap and score[q] - apart / (2 * gap + 1) > best:
                best, come = score[q] - apart / (2 * gap + 1), q
        score.append(best + 1)
        before.append(come)
    out, used = set(), [False] * len(hits)
    for i in sorted(range(len(hits)), key=lambda i: -score[i]):
        shifts = []
        while i >= 0 and not used[i]:
            used[i] = True
            shifts.append(hits[i][0] - hits[i][1])
            i = before[i]
        if shifts:
            out.add((min(shifts), max(shifts)))
    return sorted(out)


def scan(table: pa.Table, text: str, index: Index, rule: ScanRule) -> list[list[tuple[str, int, int, float]]]:
    """Finds of each document: license, start and end in code points, matched share; by start, then license."""
    data, offs, hashes, starts, ends, words = _words(table.column(text))
    out: list[list] = [[] for _ in range(len(offs) - 1)]
    if not len(hashes) or not len(index.hashes):
        return out
    grams, gram_offs = textvec.window_hashes(hashes, words, rule.gram)
    left = np.searchsorted(index.hashes, grams, "left")
    hit = np.flatnonzero(index.hashes[np.minimum(left, len(index.hashes) - 1)] == grams)
    chars = None
    candidates: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    doc_of = np.searchsorted(gram_offs, hit, "right") - 1
    for g, d in zip(hit.tolist(), doc_of.tolist(), strict=True):
        e = int(left[g])
        while e < len(index.hashes) and index.hashes[e] == grams[g]:
            candidates[d, int(index.template[e])].append((g - int(gram_offs[d]), int(index.place[e])))
            e += 1
    for (d, t), hits in sorted(candidates.items()):
        own, template = hashes[words[d] : words[d + 1]], index.words[t]
        band = min(rule.band, max(1, len(template) // 4))  # short templates may follow each other closely
        for low, high in chains(hits, min(rule.gap, max(1, 2 * len(template) // 3)), len(template)):
            count, first, last = align(template, own, low, band, high)
            share = count / len(template)
            if share >= rule.coverage:
                if chars is None:
                    chars = textvec.code_points(data)
                base = chars[offs[d]]
                a, b = words[d] + first, words[d] + last
                out[d].append((index.names[t], int(chars[starts[a]] - base), int(chars[ends[b]] - base), share))
    # of one template's finds that overlap, the one with more matched, then the first, stays
    for d, finds in enumerate(out):
        if len(finds) > 1:
            kept: list = []
            for f in sorted(set(finds), key=lambda f: (-f[3], f[2] - f[1], f[1], f[0])):
                if not any(f[0] == k[0] and f[1] < k[2] and k[1] < f[2] for k in kept):
                    kept.append(f)
            out[d] = sorted(kept, key=lambda f: (f[1], f[0]))
    return out


def license_spans(df: DataFrame, templates: dict[str, str] | None = None, text: str = "text", rule: ScanRule = ScanRule(), spans: str = "license_spans") -> DataFrame:
    """df with `spans`: license, start and end (code points), and matched share of the template's words.

    Null and empty texts have none. Rows are scanned one by one and whole, so repeated rows get equal
    results; an empty table stays empty; finds of different templates may overlap; a column of df named
    as `spans` is replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES, rule))

    def make(table: pa.Table) -> list:
        rows = [[{"license": n, "start": a, "end": b, "coverage": c} for n, a, b, c in finds] for finds in scan(table, text, sent.value, rule)]
        return [pa.array(rows, pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64())])))]

    return frames.append(df, text, {spans: SPAN}, make)


def digests(df: DataFrame, templates: dict[str, str] | None = None, text: str = "text", rule: ScanRule = ScanRule(), keep: list[str] | None = None) -> DataFrame:
    """df with the columns of FIELDS, from the same finds: how many, their distinct licenses in order
    and joined by commas, the best share (0 without a find), and license:start:end joined likewise with
    its digest. Cases as in license_spans()."""
    sent = df.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES, rule))

    def make(table: pa.Table) -> list:
        found = scan(table, text, sent.value, rule)
        joined = [",".join(f"{n}:{a}:{b}" for n, a, b, _ in x) for x in found]
        return [
            np.array([len(x) for x in found], np.int64),
            [",".join(sorted({f[0] for f in x})) for x in found],
            np.array([max((f[3] for f in x), default=0.0) for x in found]),
            [hashlib.sha256(j.encode()).hexdigest() for j in joined],
            joined,
        ]

    return frames.append(df, text, FIELDS, make, keep=keep)


def without_licenses(df: DataFrame, refused: set[str], templates: dict[str, str] | None = None, text: str = "text", rule: ScanRule = ScanRule()) -> DataFrame:
    """The rows of df in which no license of `refused` is found, with all columns of df. Cases as in license_spans()."""
    if not refused:
        return df
    found = "__license_spans"
    out = license_spans(df, templates, text, rule, found)
    names = F.transform(found, lambda x: x["license"])
    return out.where(~F.arrays_overlap(names, F.array(*[F.lit(r) for r in sorted(refused)]))).drop(found)
