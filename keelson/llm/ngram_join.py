"""N-gram Jaccard self-join with token-combination prefixes.

A document is the set of its n-word shingles. All sets are put in one order: rare shingles, then
those of middling and then those of high document frequency. A prefix is extended until losing as many
shingles as the similarity allows must leave a signature: each rare or middling shingle is one by
itself, and of the frequent class every two prefix shingles that follow each other are one. Two similar
sets share a signature; sets with equal shingles are one node from the start.

Why neighbours are enough: if no rare or middling shingle is common, those that only one of two similar
sets has leave at most d gaps in the common frequent ones, and d + 2 common ones cannot all be parted by
d gaps, so two of them follow each other in both sets. The prefix is as long as that takes. So a set has
fewer signatures than shingles, however long it is.

Nodes that share a signature are linked along a chain, the candidates are verified on the full sets, and
components are formed. Then nodes of a signature that lie in different components are compared by sketches
inside tasks. Where that leaves few pairs for each node, these are listed, each once, and verified. Where it
leaves many, as in a large group of near copies, only a forest of them is: its trees are families, which hold
every pair that was left. A family's full sets are compared inside tasks, and only links that join two
components leave the task. So no link between components is lost, and the rows made stay in proportion to the
signatures. A signature or family of many nodes is cut in cells by sizes that can be similar, and these in
blocks of bounded rows and bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import frames, textvec
from keelson.llm.components import components, stars

_CLASS_SHIFT = np.uint64(62)
_HASH = np.uint64((1 << 62) - 1)
COUNTED_BYTES = 24 << 20  # text over which a task counts shingles before it hands on those seen often enough


@dataclass(frozen=True)
class JoinRule:
    """Link if 100 * intersection >= percent * union of n-word shingle sets.

    middling: document frequency from which a shingle goes after the rare ones; frequent: that from which it
    is indexed in pairs (from 75 percent on; below, all are indexed by themselves); listed: the most shingles
    whose frequency is broadcast, 16 bytes each (beyond it, `middling` rises; results do not depend on it);
    salted: members of a frequent signature for each first chain; few: nodes of a signature whose pairs need no
    sketches inside tasks, and pairs for each node up to which those of other signatures are listed; block,
    block_bytes: nodes, and bytes of their sets, that are compared in one piece.
    """

    n: int = 5
    percent: int = 80
    middling: int = 12
    frequent: int = 500
    listed: int = 1 << 20
    salted: int = 2000
    few: int = 8
    block: int = 2048
    block_bytes: int = 8 << 20


def shingle_sets(table: pa.Table, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingles (62-bit hashes, ascending) and their offsets."""
    data, offs = textvec.buffers(table.column(text))
    hashes, _, _, words = textvec.word_hashes(textvec.LOWER[data], offs, textvec.SPACE_WORDS)
    windows, ends = textvec.window_hashes(hashes, words, n)
    windows &= _HASH
    out, counts = [], np.zeros(len(ends) - 1, np.int64)
    for d in range(len(ends) - 1):
        own = np.sort(windows[ends[d] : ends[d + 1]])
        if len(own) > 1:
            own = own[np.append(True, own[1:] != own[:-1])]
        out.append(own)
        counts[d] = len(own)
    return np.concatenate(out) if out else windows[:0], np.concatenate([[0], np.cumsum(counts)])


def set_ids(sets: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 64-bit identifier of each set, from sums and xors of its members' codes."""
    filled = np.diff(offs) > 0
    out = np.zeros(len(offs) - 1, np.uint64)
    if filled.any():
        with np.errstate(over="ignore"):
            at = offs[:-1][filled]
            a = np.add.reduceat(textvec.mix64(sets ^ np.uint64(0x51ED270B)), at)
            b = np.bitwise_xor.reduceat(textvec.mix64(sets + np.uint64(0x2545F491)), at)
            out[filled] = textvec.mix64(a ^ textvec.mix64(b + np.diff(offs)[filled].astype(np.uint64)))
    return out


def frequencies(docs: DataFrame, text: str, rule: JoinRule) -> DataFrame:
    """Shingles that occur in three documents or more of some stretch of text: (shingle, df), df being
    what such stretches add up to. It only orders shingles, so a count that is too low loses nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= 3
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], names=["shingle", "df"])

        for table in textvec.sized(batches, text, frames.CHUNK_BYTES):
            held.append(shingle_sets(table, text, rule.n)[0])
            size += table.column(text).nbytes
            if size >= COUNTED_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.select(text).mapInArrow(frames.task(run, __name__), "shingle long, df long").groupBy("shingle").agg(F.sum("df").alias("df"))


def listed(docs: DataFrame, text: str, rule: JoinRule) -> tuple[np.ndarray, np.ndarray]:
    """At most rule.listed shingles of the highest frequencies, sorted by shingle, with these."""
    counts = frames.settled(frequencies(docs, text, rule).where(F.col("df") >= rule.middling), "frequencies")
    least = rule.middling
    if counts.count() > rule.listed:
        # the lowest frequency whose shingles still fit, from a histogram by powers of 1.1
        steps = counts.groupBy(F.floor(F.log("df") / F.log(F.lit(1.1))).alias("step")).count().orderBy(F.desc("step")).collect()
        total = 0
        for step, n in steps:
            total += n
            if total > rule.listed:
                break
            least = 1.1**step
    rows = counts.where(F.col("df") >= least).limit(rule.listed).toArrow()
    shingles, df = rows.column("shingle").to_numpy().view(np.uint64), rows.column("df").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], df[order]


def signatures(sets: np.ndarray, offs: np.ndarray, known: np.ndarray, df: np.ndarray, hot: float, rule: JoinRule) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each document's signatures, and with how many others each is shared about."""
    share = np.zeros(len(sets), np.int64)
    if len(known) and len(sets):
        at = np.minimum(np.searchsorted(known, sets), len(known) - 1)
        found = known[at] == sets
        share[found] = df[at[found]]
    paired = rule.percent >= 75  # then d + 2 shingles are common to any two similar sets that d tell apart
    level = np.where(paired & (share >= hot), 2, np.where(share > 0, 1, 0)).astype(np.uint64)
    keys = sets | (level << _CLASS_SHIFT)
    out, shares = [], []
    for d in range(len(offs) - 1):
        own, n = keys[offs[d] : offs[d + 1]], int(offs[d + 1] - offs[d])
        if n < 2 and (not n or rule.percent > 50):  # only an equal set is similar; a larger set may lose nothing to a superset
            out.append(own[:0])
            shares.append(share[:0])
            continue
        lost = n - -(-rule.percent * n // 100)
        order = np.argsort(own)
        own, near = own[order], share[offs[d] : offs[d + 1]][order]
        single = int(np.searchsorted(own, np.uint64(2) << _CLASS_SHIFT))
        take = min(single, lost + 1)
        sigs, weights = textvec.mix64(own[:take]), near[:take]
        if take <= lost:  # the sets may have frequent shingles alone in common
            apart = n * (100 - rule.percent) // rule.percent  # the most shingles that tell it from a similar set
            to = single + apart + 2 + lost - 2 * single
            run, often = own[single:to], near[single:to]
            with np.errstate(over="ignore"):
                pairs = textvec.mix64(textvec.mix64(run[:-1]) + np.uint64(3) * textvec.mix64(run[1:]))
            sigs, weights = np.concatenate([sigs, pairs]), np.concatenate([weights, np.minimum(often[:-1], often[1:])])
        out.append(sigs)
        shares.append(weights)
    return out, shares


CELLS = 256


def sketches(sets: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """How many members of each set fall in each of 256 cells of their hashes, a byte each. The sum of two
    sets' lesser counts bounds their intersection from above. Empty where a count needs more than a byte."""
    docs = len(offs) - 1
    counts = np.bincount(textvec.owner(offs) * CELLS + (sets >> np.uint64(40) & np.uint64(CELLS - 1)).astype(np.int64), minlength=docs * CELLS).reshape(docs, CELLS)
    fits = counts.max(1, initial=0) < 256
    raw = counts.astype(np.uint8)
    return [raw[d].tobytes() if fits[d] else b"" for d in range(docs)]


def _possible(pairs: DataFrame, reps: DataFrame, rule: JoinRule) -> DataFrame:
    """The pairs whose sketches leave room for a link."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            total = batch.column("p").to_numpy() + batch.column("q").to_numpy()
            keep = np.ones(len(x), bool)
            both = np.array([len(a) == CELLS and len(b) == CELLS for a, b in zip(x, y, strict=True)], bool)
            at = np.flatnonzero(both)
            if len(at):
                a = np.frombuffer(b"".join(x[i] for i in at), np.uint8).reshape(-1, CELLS)
                b = np.frombuffer(b"".join(y[i] for i in at), np.uint8).reshape(-1, CELLS)
                common = np.minimum(a, b).sum(1, dtype=np.int64)
                keep[at] = 100 * common >= rule.percent * (total[at] - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = reps.select(F.col("node").alias("a"), F.col("sketch").alias("x"), F.col("n").alias("p"))
    right = reps.select(F.col("node").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("q"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "p", "q").mapInArrow(frames.task(compare, __name__), "a long, b long")


_PAIRS = 1 << 15  # that are compared at once
_HELD = 16_384  # rows of whole cells that are compared together
LEFT, RIGHT, GUEST = 1, 2, 4


def _split(joined: DataFrame, rule: JoinRule) -> tuple[DataFrame, DataFrame]:
    """Rows (sig, node, n, component) of signatures with several components, dealt to cells of few and of many nodes.

    Both are (cell, side, node, n, component). A signature of at most `block` nodes is one cell. Larger ones are
    cut by size: a node is at home in its band and a guest in the one below, and similar sizes are at most a band
    apart. Bands are cut in blocks of nodes, and a cell is two of these. side: in which of the two blocks the node
    is, and whether it is a guest; two guests, or two nodes of one of two blocks, are compared elsewhere.
    """
    sizes = joined.groupBy("sig").agg((F.min("component") != F.max("component")).alias("split"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("sum"))
    blocks = F.greatest(F.ceil(F.col("rows") / rule.block), F.ceil(F.col("sum") * 8 / rule.block_bytes)).cast("int")
    rows = frames.settled(joined.join(sizes.where("split").select("sig", "rows", blocks.alias("blocks")), "sig"), "split")
    few = rows.where(F.col("rows") <= rule.few)
    one = rows.where((F.col("rows") > rule.few) & (F.col("blocks") == 1))
    few, one = (x.select(F.col("sig").alias("cell"), F.lit(LEFT | RIGHT).alias("side"), "node", "n", "component") for x in (few, one))
    band = F.floor(F.log("n") / (math.log(100 / rule.percent) * (1 + 1e-9)))
    many = rows.where((F.col("rows") > rule.few) & (F.col("blocks") > 1)).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    many = many.withColumn("home", F.explode(F.array(F.struct(band.alias("band"), F.lit(0).alias("guest")), F.struct((band - 1).alias("band"), F.lit(GUEST).alias("guest")))))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), LEFT | RIGHT).when(F.col("own") < F.col("other"), LEFT).otherwise(RIGHT) + F.col("home.guest")
    cell = F.xxhash64("sig", "home.band", F.least("own", "other"), F.greatest("own", "other"))
    return few, one.unionByName(many.select(cell.alias("cell"), side.cast("int").alias("side"), "node", "n", "component"))


def _whole(batches: Iterator[pa.RecordBatch], rule: JoinRule) -> Iterator[pa.Table]:
    """Tables of whole cells from batches sorted by cell: several while they are small together."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size >= _HELD or sum(t.nbytes for t in held) >= 2 * rule.block_bytes:
            table = pa.concat_tables(held)
            cell = table.column("cell").to_numpy()
            cut = int(np.searchsorted(cell, cell[-1], "left"))  # the last cell may go on
            if cut:
                yield table.slice(0, cut)
            held, size = [table.slice(cut)], table.num_rows - cut
    if held:
        yield pa.concat_tables(held)


def _candidates(cell: np.ndarray, side: np.ndarray, n: np.ndarray, component: np.ndarray, rule: JoinRule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places to compare, some at a time; rows are sorted by cell, then n."""
    edge = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    ends = np.repeat(np.append(edge[1:], len(cell)), np.diff(np.append(edge, len(cell))))
    which = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(cell))))
    # the first place in a cell whose set is too large for each
    span = int(n.max(initial=0)) + 1
    large = np.searchsorted(which * span + n, which * span + np.minimum(100 * n // rule.percent, span - 1), "right")
    first = np.arange(len(cell)) + 1
    count = np.maximum(np.minimum(large, ends) - first, 0)
    total = np.cumsum(count)
    low = 0
    while low < len(cell):
        high = max(int(np.searchsorted(total, (total[low - 1] if low else 0) + _PAIRS, "right")), low + 1)
        a = np.repeat(np.arange(low, high), count[low:high])
        b = np.arange(len(a)) - np.repeat(np.cumsum(count[low:high]) - count[low:high], count[low:high]) + first[a]
        met = ((side[a] & LEFT) & (side[b] & RIGHT) >> 1) | ((side[b] & LEFT) & (side[a] & RIGHT) >> 1)
        keep = (component[a] != component[b]) & (met > 0) & ((side[a] & side[b] & GUEST) == 0)
        if keep.any():
            yield a[keep], b[keep]
        low = high


def _columns(table: pa.Table) -> tuple[list[np.ndarray], pa.Table]:
    """A table's rows by cell and n, and its cell, side, n and component."""
    order = np.lexsort((table.column("n").to_numpy(), table.column("cell").to_numpy()))
    table = table.take(pa.array(order))
    return [table.column(c).to_numpy() for c in ("cell", "side", "n", "component")], table


def _listed_pairs(rows: DataFrame, rule: JoinRule) -> DataFrame:
    """The pairs (a, b) to compare of cells of few nodes, each once."""

    def listed_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, rule):
            (cell, side, n, component), table = _columns(table)
            node = table.column("node").to_numpy()
            for a, b in _candidates(cell, side, n, component, rule):
                both = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(frames.task(listed_in, __name__), "a long, b long").distinct()


def _near(rows: DataFrame, rule: JoinRule) -> DataFrame:
    """Pairs (a, b, dense) of cells' rows (with sketches) that may be similar: all of a cell's, or if they are more
    than `few` for each row, dense ones that join the same rows."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, rule):
            (cell, side, n, component), table = _columns(table)
            node = table.column("node").to_numpy()
            raw = table.column("sketch").to_pylist()
            known = np.array([len(x) == CELLS for x in raw], bool)
            cells = np.frombuffer(b"".join(x if len(x) == CELLS else bytes(CELLS) for x in raw), np.uint8).reshape(-1, CELLS)
            which = np.cumsum(np.append(True, cell[1:] != cell[:-1])) - 1
            most = rule.few * np.bincount(which)
            count = np.zeros(len(most), np.int64)
            held = np.zeros((2, 0), np.int64)
            for a, b in _candidates(cell, side, n, component, rule):
                common = np.minimum(cells[a], cells[b]).sum(1, dtype=np.int32)
                ok = (100 * common >= rule.percent * (n[a] + n[b] - common)) | ~known[a] | ~known[b]
                count += np.bincount(which[a[ok]], minlength=len(count))
                held = np.concatenate([held, np.stack([a[ok], b[ok]])], axis=1)
                dense = (count > most)[which[held[0]]]
                if dense.any():  # rows of different cells are different rows, so trees stay inside cells
                    tree = stars(*held[:, dense])
                    held = np.concatenate([held[:, ~dense], np.stack([tree.column(0).to_numpy(), tree.column(1).to_numpy()])], axis=1)
            a, b = node[held[0]], node[held[1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array((count > most)[which[held[0]]])], names=["a", "b", "dense"])

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(frames.task(compare, __name__), "a long, b long, dense boolean")


def _common(members: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many members each pair of sets has in common: products of the sets' rows of ones, some columns at a time."""
    if len(a) < 4 * len(members):
        out = np.empty(len(a), np.int64)
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            both = np.concatenate([members[x], members[y]])
            both.sort()
            out[i] = (both[1:] == both[:-1]).sum()
        return out
    sizes = np.array([len(m) for m in members])
    owner = np.repeat(np.arange(len(members)), sizes)
    _, place, often = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    shared = often > 1
    column = np.cumsum(shared) - 1
    on = shared[place]
    owner, place = owner[on], column[place[on]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = np.zeros((len(members), len(members)), np.float32)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, _PRODUCT):
        at = slice(*np.searchsorted(place, [low, low + _PRODUCT]))
        ones = np.zeros((len(members), min(_PRODUCT, int(place[-1]) + 1 - low)), np.float32)
        ones[owner[at], place[at] - low] = 1
        total += ones @ ones.T
    return total[a, b].astype(np.int64)


_PRODUCT = 2048  # columns of such a product


def _joining(rows: DataFrame, rule: JoinRule) -> DataFrame:
    """Links (u, v) between components of cells' rows with `members`: fewer in each cell than it has components."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, rule):
            (cell, side, n, component), table = _columns(table)
            members = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("members").combine_chunks()]
            edges = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                found = []
                for a, b in _candidates(cell[low:high], side[low:high], n[low:high], component[low:high], rule):
                    common = _common(members[low:high], a, b)
                    ok = 100 * common >= rule.percent * (n[low + a] + n[low + b] - common)
                    found.append((component[low + a[ok]], component[low + b[ok]]))
                if any(len(u) for u, _ in found):
                    yield stars(*(np.concatenate(x) for x in zip(*found, strict=True)))

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(frames.task(compare, __name__), "u long, v long")


def _lists(values: list[np.ndarray], dtype, kind) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, dtype)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat.astype(dtype), kind))


def nodes(docs: DataFrame, rule: JoinRule) -> DataFrame:
    """(node, n_shingles, sketch, sigs, salts) for each row of docs, with its columns but `text`; written to the shared folder."""
    known, df = listed(docs, "text", rule)
    sent = docs.sparkSession.sparkContext.broadcast((known, df))

    def make(table: pa.Table) -> list:
        sets, offs = shingle_sets(table, "text", rule.n)
        ids = set_ids(sets, offs)
        sigs, shares = signatures(sets, offs, *sent.value, rule.frequent, rule)
        salts = [(np.uint64(i) % (s // rule.salted + 1).astype(np.uint64)).astype(np.int32) for i, s in zip(ids, shares, strict=True)]
        return [ids, np.diff(offs), pa.array(sketches(sets, offs), pa.binary()), _lists(sigs, np.int64, pa.int64()), _lists(salts, np.int32, pa.int32())]

    fields = {"node": "long", "n_shingles": "long", "sketch": "binary", "sigs": "array<long>", "salts": "array<int>"}
    return frames.settled(frames.append(docs, "text", fields, make, drop_text=True), "nodes")


def _members(ends: DataFrame, docs: DataFrame, reps: DataFrame, rule: JoinRule) -> DataFrame:
    """(node, members): the sets of these nodes, packed; written to the shared folder."""
    wanted = frames.small(frames.settled(reps.select("doc_id", "key", "node").join(ends, "node", "left_semi"), "wanted"))
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]) & docs["key"].eqNullSafe(wanted["key"])).select("node", "text")

    def make(table: pa.Table) -> list:
        sets, offs = shingle_sets(table, "text", rule.n)
        return [set_ids(sets, offs), frames.packed(sets, np.diff(offs))]

    # repeated rows bring one text again
    sets = frames.append(texts, "text", {"own": "long", "members": "binary"}, make, keep=["node"]).where("own = node").select("node", "members")
    return frames.settled(sets.groupBy("node").agg(F.first("members").alias("members")), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, rule: JoinRule) -> DataFrame:
    """Of pairs (a, b), those whose sets are similar."""
    sets = _members(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), docs, reps, rule)
    left, right = sets.select(F.col("node").alias("a"), F.col("members").alias("x")), sets.select(F.col("node").alias("b"), F.col("members").alias("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= rule.percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = frames.settled(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(frames.task(compare, __name__), "a long, b long"), "links")
    frames.discard(sets)
    return out


def _pairs(rows: DataFrame, by: list[str], rule: JoinRule) -> DataFrame:
    """Neighbouring nodes of each group in the order of their sizes, where sizes allow a link."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("n", "node")
    near = rows.withColumn("p", F.lag("node").over(w)).withColumn("m", F.lag("n").over(w)).where((F.col("p") != F.col("node")) & (100 * F.col("m") >= rule.percent * F.col("n")))
    return near.select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")).distinct()


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, key): identifier and key together stand for a row's text."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("key"))


def _labelled(own: DataFrame, rule: JoinRule) -> tuple[DataFrame, DataFrame]:
    """Of own (doc_id, text, key): its rows with node and n_shingles and without texts, and (node, component) of the
    nodes with links."""
    every = nodes(own, rule)
    filled = every.where("n_shingles > 0")
    reps = filled.groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("s"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    reps = frames.settled(reps.select("node", "s.doc_id", "s.key", "n", "sketch"), "reps")
    rows = filled.where("size(sigs) > 0").select("node", F.col("n_shingles").alias("n"), F.explode(F.arrays_zip("sigs", "salts")).alias("s")).select(F.col("s.sigs").alias("sig"), F.col("s.salts").alias("salt"), "node", "n")
    shared = rows.groupBy("sig").agg((F.min("node") != F.max("node")).alias("shared")).where("shared").select("sig")
    rows = frames.settled(rows.join(shared, "sig", "left_semi").distinct(), "signatures")

    tried = frames.settled(_possible(_pairs(rows, ["sig", "salt"], rule), reps, rule), "possible")
    links = _verified(tried, own, reps, rule).select(F.col("a").alias("u"), F.col("b").alias("v"))
    named = components(links)
    joined = rows.join(named, "node", "left").select("sig", "node", "n", F.coalesce("component", "node").alias("component"))
    few, many = _split(joined, rule)
    frames.discard(rows)
    near = frames.settled(_near(many.join(reps.select("node", "sketch"), "node").select("cell", "side", "node", "n", "component", "sketch"), rule), "near")
    more = _possible(_listed_pairs(few, rule).join(tried, ["a", "b"], "left_anti"), reps, rule)
    more = frames.settled(more.unionByName(near.where("not dense").select("a", "b")).distinct().join(tried, ["a", "b"], "left_anti"), "possible")
    frames.discard(tried, few)
    links = links.unionByName(_verified(more, own, reps, rule).select(F.col("a").alias("u"), F.col("b").alias("v")))
    dense = near.where("dense").select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not dense.isEmpty():
        family = components(dense).withColumnRenamed("component", "sig").join(reps.select("node", "n"), "node").join(named, "node", "left")
        few, many = _split(family.select("sig", "node", "n", F.coalesce("component", "node").alias("component")), rule)
        sets = _members(family.select("node"), own, reps, rule)
        links = links.unionByName(frames.settled(_joining(few.unionByName(many).join(sets, "node").select("cell", "side", "node", "n", "component", "members"), rule), "links"))
        frames.discard(sets, few)
    frames.discard(near, more)
    named = components(links.unionByName(named.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    return every.drop("sketch", "sigs", "salts"), named


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: JoinRule = JoinRule()) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles and component_id, the least doc_id that links lead to.

    A document of fewer than n words has one shingle, all its words; one without words (null texts too)
    has none and is linked with nothing: its component_id is its own doc_id. Words are split at ASCII
    white space and A-Z lower-cased. Repeated rows and copies share a component; a component whose
    identifiers are all null has a null one, else nulls do not count. An empty table gives no rows. Texts of any
    length are compared whole. Other columns of docs, whatever their names, are not looked at.
    """
    every, named = _labelled(_rows(docs, doc_id, text), rule)
    filled = every.where("n_shingles > 0")
    label = filled.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = label.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    label = label.join(least, "component").select("node", "component_id")
    with_words = filled.select("doc_id", "node", "n_shingles").join(label, "node").select("doc_id", "n_shingles", "component_id")
    return with_words.unionByName(every.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


_KEY, _ID = "__join_key", "__join_id"  # names that no column of a user should have


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: JoinRule = JoinRule()) -> DataFrame:
    """The rows of docs less near copies: of each component of linked documents the row with the least doc_id stays,
    and of rows with that doc_id the one with the least digest of its text.

    Null identifiers come after all others. Rows without words (null texts too) are linked with nothing and stay.
    Of rows with one identifier and one text a single one stays. One identifier on different texts is no link.
    All columns of docs are handed on, whatever their names; an empty table stays empty.
    """
    every, named = _labelled(_rows(docs, doc_id, text), rule)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("s")
    kept = every.where("n_shingles > 0").join(named, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(first).select("s.doc_id", "s.key")
    kept = kept.unionByName(every.where("n_shingles = 0").select("doc_id", "key").distinct()).select(F.col("doc_id").alias(_ID), F.col("key").alias(_KEY))
    marked = docs.withColumns({_ID: F.col(f"`{doc_id}`").cast("long"), _KEY: F.xxhash64(f"`{text}`")})
    out = marked.join(kept, marked[_ID].eqNullSafe(kept[_ID]) & (marked[_KEY] == kept[_KEY]), "left_semi")
    return out.dropDuplicates([_ID, _KEY]).drop(_ID, _KEY)
