"""Benchmark decontamination on suffix arrays of the training text.

Each chunk of documents is a shard: the suffixes of its words are sorted, and every suffix of every
test item is looked up by binary search, one word deeper at a time, which gives its longest verbatim
matches and where they are. Suffixes that start with a word of no test item cannot match and are left
out of the array. Test items are broadcast in blocks of at most `block_bytes` of text; each block is
one pass over the shards, so the tests' size is not limited by memory.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import frames, textvec

WINDOW = 13
MATCH = "array<struct<item_id:string,test_word:int,start:int,words:int>>"
FIELDS = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean", "hit_spans": "string"}


@dataclass
class Tests:
    """A block of test items: their words as symbols from 1, closed by 0, and where each window starts."""

    ids: list[str]
    vocabulary: np.ndarray  # sorted hashes; symbol i + 1 is entry i
    symbols: np.ndarray
    item: np.ndarray  # of each place
    offset: np.ndarray  # within the item
    rest: np.ndarray  # words from here to the item's end
    want: np.ndarray  # words of the window that starts here, 0 if none does

    @staticmethod
    def build(ids: list[str | None], texts: list[str | None], window: int) -> Tests:
        data, offs = textvec.buffers(pa.array(texts, pa.string()))
        hashes, _, _, words = textvec.word_hashes(textvec.LOWER[data], offs, textvec.ALNUM_WORDS)
        vocabulary = np.unique(hashes)
        counts = np.diff(words)
        item = textvec.owner(words)
        offset = np.arange(len(hashes)) - words[:-1][item]
        rest = counts[item] - offset
        want = np.where(rest >= window, window, np.where((offset == 0), rest, 0))
        symbols = np.zeros(len(hashes) + len(counts), np.int64)
        symbols[np.arange(len(hashes)) + item] = np.searchsorted(vocabulary, hashes) + 1
        return Tests(["" if i is None else str(i) for i in ids], vocabulary, symbols, item, offset, rest, want)


class Shard:
    """The suffix array of a chunk's words, over the test items' vocabulary."""

    def __init__(self, hashes: np.ndarray, words: np.ndarray, tests: Tests, depth: int):
        n, docs = len(hashes), len(words) - 1
        self.base = words[:-1] + np.arange(docs)  # where each document starts; a 0 closes each
        symbols = np.zeros(n + docs + 1, np.int64)
        if len(tests.vocabulary) and n:
            at = np.searchsorted(tests.vocabulary, hashes)
            at[at == len(tests.vocabulary)] = 0
            known = tests.vocabulary[at] == hashes
            symbols[np.flatnonzero(known) + textvec.owner(words)[known]] = at[known] + 1
        self.symbols = symbols
        live = np.flatnonzero(symbols)
        rank = np.zeros(len(symbols), np.int64)
        key = (symbols[live] << 32) | symbols[live + 1]
        by = np.argsort(key)
        self.order = live[by]
        held, places = key[by], np.arange(len(live))
        self.pairs = held  # the first two words of each suffix in order
        reach = 2
        self._rank(rank, self.order, held, places)
        while reach < depth:
            by = rank[self.order]
            same = by[1:] == by[:-1]
            tied = np.zeros(len(live), bool)
            tied[1:] |= same
            tied[:-1] |= same
            places = np.flatnonzero(tied)
            if not len(places):
                break
            who = self.order[places]
            key = (rank[who] << 32) | rank[np.minimum(who + reach, len(symbols) - 1)]
            # a match that met a 0 within reach is over: what follows must not count
            by = np.argsort(key)
            self.order[places] = who[by]
            self._rank(rank, who[by], key[by], places)
            reach *= 2

    @staticmethod
    def _rank(rank: np.ndarray, who: np.ndarray, key: np.ndarray, places: np.ndarray) -> None:
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        lead = np.flatnonzero(new)
        rank[who] = np.repeat(places[lead] + 1, np.diff(np.append(lead, len(key))))

    def search(self, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For every test suffix: its longest match's words and range in the array, and its window's range.
        Two words are looked up at once; only suffixes that the shard has two words of go on, a word at a time."""
        m = len(tests.item)
        place = np.arange(m) + tests.item
        best_lo, best_hi, length = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
        win_lo, win_hi = best_lo.copy(), best_lo.copy()
        first = tests.symbols[place] << 32

        def note(which: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> None:
            length[which], best_lo[which], best_hi[which] = depth, low, high
            there = tests.want[which] == depth
            win_lo[which[there]], win_hi[which[there]] = low[there], high[there]

        one = np.searchsorted(self.pairs, first), np.searchsorted(self.pairs, first + (1 << 32))
        live = np.flatnonzero(one[1] > one[0])
        note(live, one[0][live], one[1][live], 1)
        live = live[tests.rest[live] > 1]
        key = first[live] | tests.symbols[place[live] + 1]
        lo, hi = np.searchsorted(self.pairs, key), np.searchsorted(self.pairs, key, "right")
        depth = 2
        while len(live):
            found = hi > lo
            live, lo, hi = live[found], lo[found], hi[found]
            note(live, lo, hi, depth)
            more = tests.rest[live] > depth
            live, lo, hi = live[more], lo[more], hi[more]
            want = tests.symbols[place[live] + depth]
            lo, hi = self._bound(lo, hi, want, depth), self._bound(lo, hi, want + 1, depth)
            depth += 1
        return length, best_lo, best_hi, win_lo, win_hi

    def _bound(self, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, depth: int) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            at = self.order[np.minimum(mid, len(self.order) - 1)] + depth
            less = open_ & (self.symbols[np.minimum(at, len(self.symbols) - 1)] < want)
            hi = np.where(open_ & ~less, mid, hi)
            lo = np.where(less, mid + 1, lo)
        return lo


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges' members one after another, and the range of each."""
    sizes = hi - lo
    which = np.repeat(np.arange(len(lo)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[which], which


def _marks(table: pa.Table, text: str, tests: Tests, spans: str, items: str) -> list:
    """This block's hit words and items joined to those of earlier blocks."""
    data, offs = textvec.buffers(table.column(text))
    hashes, _, _, words = textvec.word_hashes(textvec.LOWER[data], offs, textvec.ALNUM_WORDS)
    docs = len(words) - 1
    shard = Shard(hashes, words, tests, int(tests.rest.max(initial=1)))
    _, _, _, lo, hi = shard.search(tests)
    found = np.flatnonzero(hi > lo)
    member, which = expand(lo[found], hi[found])
    at = shard.order[member] if len(member) else member
    doc = np.searchsorted(shard.base, at, "right") - 1
    start, width, item = at - doc, tests.want[found][which], tests.item[found][which]
    step = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + width, -1)
    pairs = np.unique(doc * (len(tests.ids) + 1) + item)
    lists: list[list[str]] = [[] for _ in range(docs)] if items not in table.column_names else table.column(items).to_pylist()
    for d, i in zip((pairs // (len(tests.ids) + 1)).tolist(), (pairs % (len(tests.ids) + 1)).tolist(), strict=True):
        lists[d] = [*lists[d], tests.ids[i]]
    if spans in table.column_names:
        for d, raw in enumerate(table.column(spans).to_pylist()):
            own = np.frombuffer(raw, np.int32).reshape(-1, 2) + words[d]
            np.add.at(step, own[:, 0], 1)
            np.add.at(step, own[:, 1], -1)
    hit = np.cumsum(step[:-1]) > 0
    # maximal runs within documents
    first = hit.copy()
    last = hit.copy()
    edge = words[:-1][np.diff(words) > 0]
    inner = np.ones(len(hit), bool)
    inner[edge] = False
    first[1:] &= ~(hit[:-1] & inner[1:])
    last[:-1] &= ~(hit[1:] & inner[1:])
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    own = np.searchsorted(words, a, "right") - 1
    runs = np.stack([a - words[own], b - words[own]], 1).astype(np.int32)
    return [np.diff(words), frames.packed(runs, 2 * np.bincount(own, minlength=docs)), pa.array(lists, pa.list_(pa.string()))]


def _verdict(n_words: np.ndarray, spans: pa.Array, items: pa.Array, percent: int) -> list:
    runs = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in spans.to_pylist()]
    n_hit = np.array([int((r[:, 1] - r[:, 0]).sum()) for r in runs], np.int64)
    ids = [sorted(set(x)) for x in items.to_pylist()]
    digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]
    text = [",".join(f"{a}:{b}" for a, b in r.tolist()) for r in runs]
    return [n_words, n_hit, np.array([len(x) for x in ids], np.int64), digest, (n_hit > 0) & (100 * n_hit >= percent * n_words), text]


def blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int):
    """The test items in lists of at most about block_bytes of text each, one list at a time on the driver."""
    own = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t")).distinct()
    total = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes)
    if n <= 1:
        yield own.collect()
        return
    for k in range(n):
        yield own.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, percent: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """df with the columns of FIELDS.

    A window is `window` consecutive words of an item, or all of a shorter one; `n_hit` counts the
    document's words inside any occurrence of one, `n_items` the items (distinct identifiers) with an
    occurring window, `hit_spans` lists the runs of hit words as start:end, and `contaminated` says
    that n_hit is above 0 and at least `percent` % of the words. Null texts have no words, on either
    side, and are clean; a null identifier is the empty string. Repeated rows are judged alike. An
    empty benchmark marks nothing; an empty table stays empty. Columns of df with the new names are
    replaced, all others handed on. Texts of any length are searched whole.
    """
    return _judged(df, benchmark, {n: n for n in FIELDS}, text, item_id, item_text, window, percent, block_bytes)


_OWN = "__contamination_"  # how no column of a user should begin


def _judged(df: DataFrame, benchmark: DataFrame, names: dict[str, str], text: str, item_id: str, item_text: str, window: int, percent: int, block_bytes: int) -> DataFrame:
    """One pass over df for each block of test items; the last one gives the verdict as well."""
    out = frames.without(df, list(names.values()))
    spans, items = f"{_OWN}spans", f"{_OWN}items"
    context, last = df.sparkSession.sparkContext, None
    for rows in blocks(benchmark, item_id, item_text, block_bytes):
        if last is not None:
            out = frames.append(out, text, {f"{spans}_new": "binary", f"{items}_new": "array<string>"}, lambda t, sent=last: _marks(t, text, sent.value, spans, items)[1:])
            out = out.drop(spans, items).withColumnsRenamed({f"{spans}_new": spans, f"{items}_new": items})
        last = context.broadcast(Tests.build([r[0] for r in rows], [r[1] for r in rows], window))
    out = frames.append(out, text, {names[n]: k for n, k in FIELDS.items()}, lambda t, sent=last: _verdict(*_marks(t, text, sent.value, spans, items), percent))
    return out.drop(spans, items)


def decontaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, percent: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of df that are not contaminated, with df's own columns, whatever their names; nulls and ties as in contamination()."""
    names = {n: _OWN + n for n in FIELDS}
    return _judged(df, benchmark, names, text, item_id, item_text, window, percent, block_bytes).where(~F.col(names["contaminated"])).drop(*names.values())


def matches(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = WINDOW, block_bytes: int = 16 << 20) -> DataFrame:
    """df with `matches`: for each test suffix with a verbatim match of `least` words or more in the document's shard,
    one entry for each place of the longest match: item, word of the item, word of the document, words matched. Cases as
    in contamination(); a column of df named `matches` is replaced."""
    context = df.sparkSession.sparkContext
    out = frames.without(df, ["matches"])
    lists = []
    for k, rows in enumerate(blocks(benchmark, item_id, item_text, block_bytes)):
        sent = context.broadcast(Tests.build([r[0] for r in rows], [r[1] for r in rows], least))
        out = frames.append(out, text, {f"{_OWN}matches{k}": MATCH}, lambda t, sent=sent: [_longest(t, text, sent.value, least)])
        lists.append(f"{_OWN}matches{k}")
    return out.withColumn("matches", F.concat(*lists)).drop(*lists)


def _longest(table: pa.Table, text: str, tests: Tests, least: int) -> pa.Array:
    data, offs = textvec.buffers(table.column(text))
    hashes, _, _, words = textvec.word_hashes(textvec.LOWER[data], offs, textvec.ALNUM_WORDS)
    shard = Shard(hashes, words, tests, int(tests.rest.max(initial=1)))
    length, lo, hi, _, _ = shard.search(tests)
    found = np.flatnonzero(length >= least)
    member, which = expand(lo[found], hi[found])
    at = shard.order[member] if len(member) else member
    doc = np.searchsorted(shard.base, at, "right") - 1
    out: list[list] = [[] for _ in range(len(words) - 1)]
    for d, p, s in zip(doc.tolist(), (at - shard.base[doc]).tolist(), found[which].tolist(), strict=True):
        out[d].append({"item_id": tests.ids[tests.item[s]], "test_word": int(tests.offset[s]), "start": p, "words": int(length[s])})
    return pa.array([sorted(x, key=lambda m: (m["item_id"], m["test_word"], m["start"])) for x in out], pa.list_(pa.struct([("item_id", pa.string()), ("test_word", pa.int32()), ("start", pa.int32()), ("words", pa.int32())])))
