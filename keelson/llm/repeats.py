"""Removal of byte strings that occur more than once anywhere in the corpus.

Which 200-byte strings repeat is read off Burrows-Wheeler transforms by threshold-bounded interval
expansion: from the interval of the empty string, intervals of strings are extended backwards,
breadth first; an interval whose lower border was not yet known fixes the common prefix there, in
increasing order of value. Expansion stops at the minimum length; borders it never reached are those
between suffixes that share that many bytes.

No transform of the whole corpus is needed. Every window of `length` bytes has an anchor, the least
hash of its `gram`-byte substrings, which equal windows share. Windows in a row with one anchor are a
region; regions are dealt out by their anchor's hash, and only those whose hash occurs again are
fetched. Equal regions are one text with a weight. Regions of a hash are then all of the text in which
their windows can repeat, and a group of hashes has a transform of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import frames, textvec

FIELDS = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
HOT = 2000
_PIECE = 8 << 20  # window starts handled at once in very long texts


@dataclass(frozen=True)
class RepeatRule:
    """length: bytes of a repeated string. gram: bytes hashed to choose anchors. bucket_bytes: text
    for one transform, about. crowded: regions of a hash from which they are split into parts of `part`
    windows, each dealt out by the bytes that its windows have in common, so that near copies make no
    large group; from a hundred times as many on, each window is a part, and equal ones are one text."""

    length: int = 200
    gram: int = 64
    bucket_bytes: int = 1 << 20
    crowded: int = 2_000
    part: int = 16


def anchors(data: np.ndarray, offs: np.ndarray, rule: RepeatRule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Regions: anchor hash, document, first and last window start and anchor (places in data)."""
    parts = []
    for low in range(0, max(len(data), 1), _PIECE):
        high = min(low + _PIECE, len(data))
        parts.append(_anchors(data[low : min(high + rule.length - 1, len(data))], low, high, offs, rule))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(data: np.ndarray, low: int, high: int, offs: np.ndarray, rule: RepeatRule) -> tuple:
    none = np.zeros(0, np.int64)
    if len(data) < rule.length:
        return np.zeros(0, np.uint64), none, none, none, none
    at = np.arange(len(data) - rule.gram + 1)
    hashes = textvec.span_hashes(data, at, at + rule.gram)
    least = (hashes & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64)
    width, have = rule.length - rule.gram + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    starts = np.arange(min(len(least), high - low))
    place = starts + low
    doc = np.searchsorted(offs, place, "right") - 1
    ok = place + rule.length <= offs[doc + 1]
    anchor = (least[: len(starts)] & np.uint64((1 << 24) - 1)).astype(np.int64)
    starts, doc, anchor = starts[ok], doc[ok], anchor[ok]
    if not len(starts):
        return np.zeros(0, np.uint64), none, none, none, none
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return hashes[anchor[first]], doc[first], starts[first] + low, starts[last] + low, anchor[first] + low


class Transform:
    """The Burrows-Wheeler transform of several texts, each closed by a symbol of its own."""

    def __init__(self, texts: list[bytes]):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        n = len(raw)
        symbols = raw.astype(np.int16) + 1
        symbols[self.starts + lengths] = 0
        used = np.unique(symbols)
        dense = np.zeros(258, np.int16)
        dense[used] = np.arange(len(used)) + (used[0] != 0)
        self.symbols = symbols = dense[symbols]
        self.order = self._sorted(symbols, int(len(used)) + 1, int(lengths.max(initial=0)) + 1)
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n, dtype=np.int32)
        self.before = symbols[self.order - 1]  # of each row; the texts' ends keep rows of different texts apart
        self.up = place[self.order - 1]  # the row of the suffix one symbol longer
        self.closed = len(texts)

    @staticmethod
    def _sorted(symbols: np.ndarray, size: int, longest: int) -> np.ndarray:
        n, bits = len(symbols), max(1, int(size).bit_length())
        reach = 62 // bits
        key = np.zeros(n, np.int64)
        ended = np.zeros(n, bool)
        for k in range(reach):
            own = np.zeros(n, np.int16)
            own[: max(n - k, 0)] = symbols[k:]
            own[ended] = 0
            ended |= own == 0
            key <<= bits
            key |= own
        order = np.argsort(key, kind="stable").astype(np.int32)
        rank = np.empty(n, np.int32)
        held, places = key[order], np.arange(n, dtype=np.int32)
        del key, ended, own
        who = order
        # distance to the text's end: a suffix that has ended needs no look further on
        ends = np.flatnonzero(symbols == 0)
        left = (np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)).astype(np.int32)
        while True:
            new = np.ones(len(held), bool)
            new[1:] = (held[1:] != held[:-1]) | (places[1:] != places[:-1] + 1)
            lead = np.flatnonzero(new)
            rank[who] = np.repeat(places[lead], np.diff(np.append(lead, len(held))))
            if reach >= longest:
                break
            by = rank[order]
            tied = np.zeros(n, bool)
            same = (by[1:] == by[:-1]) & (left[order[1:]] >= reach)
            tied[1:] |= same
            tied[:-1] |= same
            places = np.flatnonzero(tied).astype(np.int32)
            if not len(places):
                break
            who = order[places]
            held = rank[who].astype(np.int64) << 32
            held |= rank[np.minimum(who + reach, n - 1)]
            by = np.argsort(held, kind="stable")
            who, held = who[by], held[by]
            order[places] = who
            reach *= 2
        # what is still tied has ended alike; the texts' order decides
        by = rank[order].astype(np.int64) << 32
        by |= order
        return order[np.argsort(by, kind="stable")]

    def repeated(self, length: int) -> np.ndarray:
        """For each place of the joined texts, whether its `length` symbols start at another place too."""
        n = len(self.symbols)
        known = np.zeros(n + 1, bool)
        known[0] = known[n] = True
        run = np.ones(n, bool)
        run[1:] = self.before[1:] != self.before[:-1]
        run_of = np.cumsum(run) - 1
        run_start = np.flatnonzero(run)
        run_end = np.append(run_start[1:], n)
        # strings of one symbol: each text's end by itself, then every other symbol's rows
        heads = self.symbols[self.order]
        lower = np.concatenate([np.arange(self.closed), self.closed + np.flatnonzero(np.diff(heads[self.closed :], prepend=-1))])
        upper = np.append(lower[1:], n)
        known[lower] = True
        alphabet = int(heads.max(initial=0)) + 1
        for _ in range(1, length):
            if not len(lower):
                break
            first, last = run_of[lower], run_of[upper - 1]
            sizes = last - first + 1
            which = np.repeat(np.arange(len(lower)), sizes)
            runs = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[which]
            low, high = np.maximum(run_start[runs], lower[which]), np.minimum(run_end[runs], upper[which]) - 1
            symbol = self.before[low]
            keep = symbol > 0
            which, low, high, symbol = which[keep], low[keep], high[keep], symbol[keep]
            key = which * alphabet + symbol
            if len(key) > 1:
                by = np.argsort(key, kind="stable")
                key, low, high = key[by], low[by], high[by]
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                lead = np.flatnonzero(new)
                low, high = low[lead], high[np.append(lead[1:], len(key)) - 1]
            lower, upper = self.up[low], self.up[high] + 1
            fresh = ~known[lower]
            lower, upper = lower[fresh], upper[fresh]
            known[lower] = True
        row = ~known[:-1] | ~known[1:]
        out = np.zeros(n, bool)
        out[self.order] = row
        return out


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def repeated_windows(texts: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each distinct text, the runs of window starts (first, last) whose window occurs twice or more."""
    transform = Transform(texts)
    flags = transform.repeated(length)
    out = []
    for start, text, weight in zip(transform.starts.tolist(), texts, weights, strict=True):
        windows = len(text) - length + 1
        own = np.ones(windows, bool) if weight > 1 else flags[start : start + windows]
        a, b = runs_of(own)
        out.append(np.stack([a, b - 1], 1).astype(np.int32))
    return out


def _regions(docs: DataFrame, rule: RepeatRule) -> DataFrame:
    def make(table: pa.Table) -> Iterator[list]:
        data, offs = textvec.buffers(table.column("text"))
        hashes, doc, first, last, anchor = anchors(data, offs, rule)
        yield [hashes, table.column("key").combine_chunks().take(pa.array(doc)), (first - offs[doc]).astype(np.int32), (last - first + 1).astype(np.int32), (anchor - first).astype(np.int32)]

    return frames.explode(docs, "text", {"hash": "long", "key": "binary", "start": "int", "windows": "int", "ahead": "int"}, make)


def parts_of(windows: int, ahead: int, width: int) -> list[tuple[int, int, int]]:
    """A region's windows in parts (first, last, anchor's distance from the last): windows whose distance to
    the anchor has the same multiple of width are in one part, so that equal windows are in like parts."""
    out, first = [], 0
    while first < windows:
        least = (ahead - first) // width * width
        last = min(ahead - least, windows - 1)
        out.append((first, last, least))
        first = last + 1
    return out


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[pa.StructArray, np.ndarray]:
    """The structs of a column of lists one after another, and the row of each; nulls are empty lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.repeat(np.arange(len(column)), sizes)


def _texts(docs: DataFrame, wanted: DataFrame, rule: RepeatRule) -> DataFrame:
    """(key, start, hash, region, text): the regions' bytes, for every row of docs."""
    joined = docs.join(wanted, "key")

    def make(table: pa.Table) -> Iterator[list]:
        data, offs = textvec.buffers(table.column("text"))
        keys, (items, doc) = table.column("key").combine_chunks(), flat(table.column("regions"))
        start, windows, ahead, hashes, crowd = (items.field(c).to_numpy() for c in ("start", "windows", "ahead", "hash", "crowd"))
        begin, core, group = offs[doc] + start, np.zeros(0, np.int64), hashes.view(np.uint64)
        crowded = crowd >= rule.crowded
        if crowded.any():
            own = np.flatnonzero(~crowded)
            parts = [(i, *p) for i in np.flatnonzero(crowded).tolist() for p in parts_of(int(windows[i]), int(ahead[i]), 1 if crowd[i] >= 100 * rule.crowded else rule.part)]
            which, first, last, least = (np.array(x, np.int64) for x in zip(*parts, strict=True))
            # what every window of such a part holds, wherever the region begins and ends
            core = begin[which] + ahead[which] - least
            width = np.where(crowd[which] >= 100 * rule.crowded, 1, rule.part)
            code = textvec.span_hashes(data, core, core + rule.length - width + 1) ^ textvec.mix64(least.astype(np.uint64) + np.uint64(1))
            at = np.concatenate([own, which])
            group = np.concatenate([group[own], code])
            begin, start, doc = begin[at] + np.concatenate([0 * own, first]), start[at] + np.concatenate([0 * own, first]), doc[at]
            windows = np.concatenate([windows[own], last - first + 1])
        end = begin + windows + rule.length - 1
        one, two = (textvec.span_hashes(x, begin, end) ^ textvec.mix64(group) for x in (data, data ^ np.uint8(0xA5)))
        order = np.lexsort((two, one))
        new = np.ones(len(one), bool)
        new[order[1:]] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])  # once a stretch of documents is enough
        sizes = np.where(new, end - begin, 0)
        raw = data[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        texts = pc.if_else(pa.array(new), frames.packed(raw, sizes), pa.scalar(None, pa.binary()))
        yield [keys.take(pa.array(doc)), start.astype(np.int32), group.view(np.int64), frames.packed(np.stack([one, two], 1).ravel(), np.full(len(one), 2)), texts]

    return frames.explode(joined, "text", {"key": "binary", "start": "int", "hash": "long", "region": "binary", "text": "binary"}, make)


def repeated_spans(docs: DataFrame, rule: RepeatRule = RepeatRule()) -> DataFrame:
    """docs: (key, text), key standing for the text. One row for each key with repeats: (key, spans),
    spans being packed int32 pairs of first and last window start, in no order."""
    found = frames.settled(_regions(docs, rule), "anchors")
    again = frames.settled(found.groupBy("hash").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1"), "again")
    # hashes with over a HOT-th of all regions, fewer than HOT, meet theirs without a shuffle
    hot = again.where(F.col("crowd") > found.count() / HOT)
    marked = found.join(F.broadcast(hot.withColumnRenamed("crowd", "known")), "hash", "left")
    names = ["hash", "key", "start", "windows", "ahead", "crowd"]
    met = marked.where("known is null").drop("known").join(again, "hash").select(*names).unionByName(marked.where("known is not null").withColumnRenamed("known", "crowd").select(*names))
    wanted = met.distinct().groupBy("key").agg(F.collect_list(F.struct("hash", "start", "windows", "ahead", "crowd")).alias("regions"))
    wanted = frames.settled(wanted, "wanted")
    frames.discard(found, again)
    texts = frames.settled(_texts(docs, wanted, rule), "regions")
    frames.discard(wanted)
    distinct = texts.groupBy("hash", "region").agg(F.count(F.lit(1)).alias("weight"), F.max("text").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(frames.slices(docs.sparkSession), -(-total // (4 * rule.bucket_bytes)))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by hash; a transform takes whole hashes until it has text enough
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            spans = repeated_windows([t for _, t, _ in held], [w for _, _, w in held], rule.length)
            some = [i for i, s in enumerate(spans) if len(s)]
            return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in some], pa.binary()), pa.array([spans[i].tobytes() for i in some], pa.binary())], names=["region", "spans"])

        alone: list[tuple] = []  # texts that no other shares a hash with: their weight decides
        group: list[tuple] = []

        def close() -> None:
            nonlocal size
            if len(group) > 1:
                held.extend(group)
                size += sum(len(t) for _, t, _ in group)
            elif group and group[0][2] > 1:
                alone.append((group[0][0], np.array([0, len(group[0][1]) - rule.length], np.int32).tobytes()))
            group.clear()

        for batch in batches:
            for h, region, weight, text in zip(*(batch.column(c).to_pylist() for c in ("hash", "region", "weight", "text")), strict=True):
                if h != last:
                    close()
                    if size >= rule.bucket_bytes:
                        yield flush()
                        held, size = [], 0
                group.append((region, text, weight))
                last = h
        close()
        if held:
            yield flush()
        if alone:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in alone], pa.binary()), pa.array([x for _, x in alone], pa.binary())], names=["region", "spans"])

    solved = distinct.repartition(n, "hash").sortWithinPartitions("hash").mapInArrow(frames.task(solve, __name__), "region binary, spans binary")
    solved = frames.settled(solved, "solved")
    spans = texts.select("key", "start", "region").distinct().join(solved, "region").groupBy("key").agg(F.collect_list(F.struct("start", "spans")).alias("found"))
    spans = frames.settled(spans, "spans")
    frames.discard(texts, solved)
    return spans


def _gone(found: pa.Array | pa.ChunkedArray, offs: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of the texts at offs a found window covers."""
    items, doc = flat(found)
    raw, at = textvec.buffers(items.field("spans"))
    pairs = np.frombuffer(raw.tobytes(), np.int32).reshape(-1, 2) + np.repeat(offs[doc] + items.field("start").to_numpy(), np.diff(at) // 8)[:, None]
    size = int(offs[-1])
    step = np.bincount(pairs[:, 0], minlength=size + 1) - np.bincount(pairs[:, 1] + length, minlength=size + 1)
    return np.cumsum(step[:size]) > 0


def _removed(table: pa.Table, length: int) -> list:
    data, offs = textvec.buffers(table.column("text"))
    gone = _gone(table.column(FOUND), offs, length)
    total = np.append(0, np.cumsum(gone))
    removed = total[offs[1:]] - total[offs[:-1]]
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    edges = offs[:-1][np.diff(offs) > 0]
    first[edges] = gone[edges]
    total = np.append(0, np.cumsum(first))
    spans = total[offs[1:]] - total[offs[:-1]]
    digests = []
    for a, b, n in zip(offs[:-1].tolist(), offs[1:].tolist(), removed.tolist(), strict=True):
        digests.append(hashlib.sha256(data[a:b][~gone[a:b]] if n else data[a:b]).hexdigest())
    return [np.diff(offs), removed, spans, digests]


def _cut(table: pa.Table, text: str, length: int) -> list:
    column = table.column(text).combine_chunks()
    data, offs = textvec.buffers(column)
    gone = _gone(table.column(FOUND), offs, length)
    out = []
    for t, a, b in zip(column.to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        own = gone[a:b]
        out.append(data[a:b][~own].tobytes().decode("utf-8", "ignore") if own.any() else t)
    return [out]


FOUND, _KEY, _NEW = "__repeats_found", "__repeats_key", "__repeats_text"  # names that no column of a user should have


def _with_spans(df: DataFrame, text: str, rule: RepeatRule) -> DataFrame:
    docs = df.select(frames.text_key(text).alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    spans = repeated_spans(docs, rule).select(F.col("key").alias(_KEY), F.col("found").alias(FOUND))
    return df.withColumn(_KEY, frames.text_key(text)).join(spans, _KEY, "left").drop(_KEY)


def removal_digests(df: DataFrame, text: str = "text", rule: RepeatRule = RepeatRule(), doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of df: bytes of the text, bytes
    removed, maximal removed runs, and digest of what remains. Other columns, whatever their names, are left out.

    A byte goes if a string of rule.length bytes that covers it starts anywhere else too, in this row
    or another; so repeated rows remove each other, first ones included. Texts are judged as UTF-8
    bytes; a null text is empty. Texts shorter than rule.length stay. Long ones are judged whole, in pieces
    that overlap. An empty table stays empty.
    """
    joined = _with_spans(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", rule)
    return frames.append(joined, "text", FIELDS, lambda t: _removed(t, rule.length), keep=["doc_id"])


def without_repeats(df: DataFrame, text: str = "text", rule: RepeatRule = RepeatRule()) -> DataFrame:
    """df with the repeated bytes cut out of the text (bytes left of a character cut in two go as well).
    Cases as in removal_digests(); null texts stay null, and all other columns are handed on, whatever their names."""
    out = frames.append(_with_spans(df, text, rule), text, {_NEW: "string"}, lambda t: _cut(t, text, rule.length))
    return out.select(*[F.col(_NEW).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])
