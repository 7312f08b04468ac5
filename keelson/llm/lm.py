"""Language-model scoring: unigram counts of all words, and a log-bilinear model of word classes.

The model gives a word's class from the two classes before it, and the word within its class from its
count. Frequent words are classes of their own, the more of them the more training text there is; all
others share a class by their ending. The log-bilinear model is trained in numpy by noise-contrastive
estimation, from every trigram of the training text: slices of it change copies of the model, which are
averaged. Batched matrix products then give normalised log probabilities for every context.

Counts of words meet documents without shuffling words one by one: a task turns its stretch of text
into distinct words with sparse lists of documents, dealt out by the word's hash in packed blocks. Where
a hash's blocks meet, counts are summed and each document's share is sent back. Of a word that many documents
of a stretch have, only the count travels: the list stays with the stretch, which is sent the word's sum. So no
word, however frequent, makes one bucket large.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import frames, textvec

FIELDS = {"n_tokens": "long", "lbl": "double", "own_words": "double", "in_class": "double"}
STRETCH_BYTES = 12 << 20  # text from which a task makes one set of blocks
BUCKET_BYTES = 16 << 20  # text for each bucket of hashes
SPREAD = 64  # documents of a stretch from which a word's list stays with the stretch
TASKS = 20_000  # that buckets or slices are dealt to at most, several each beyond it
SLICE_BYTES = 16 << 20  # least training text that changes a copy of the model
ROUNDS = 3  # in which copies are averaged
RATE = 0.1
HEAVY = 8  # a trigram seen more often than this counts in several steps


@dataclass(frozen=True)
class ModelShape:
    """words: the least number of frequent words with a class each. endings: classes of the others. size: of
    the vectors. steps, batch: at least so much training; noise: of it; seed makes it repeatable."""

    words: int = 40
    endings: int = 22
    size: int = 24
    steps: int = 1200
    batch: int = 1024
    noise: int = 10
    seed: int = 7


def endings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """A class from 0 to n - 1 for each word, by its last two bytes."""
    last = data[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64) if len(ends) else last
    return (textvec.mix64(last << np.uint64(8) | before) % np.uint64(n)).astype(np.uint8)


def _words(table: pa.Table, shape: ModelShape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offs = textvec.buffers(table.column("text"))
    data = textvec.LOWER[data]
    hashes, starts, ends, words = textvec.word_hashes(data, offs, textvec.SPACE_WORDS)
    return hashes, endings(data, starts, ends, shape.endings), words


def _join(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, each after its length."""
    return b"".join(x for a in arrays for x in (np.int64(len(a)).tobytes(), np.ascontiguousarray(a).tobytes()))


def _split(raw: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, kind, n, at + 8))
        at += 8 + n * np.dtype(kind).itemsize
    return out


def _blocks(docs: DataFrame, buckets: int, shape: ModelShape) -> DataFrame:
    """(bucket, stretch, kind, payload): kind 0 the keys of a stretch's documents and its lists of frequent words,
    kind 1 its words of a bucket, those of frequent words without lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = docs_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            stretch = part << 24 | count
            keys = b"".join(k for h in held for k in h[0])
            hashes, kinds = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            doc, train = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
            held.clear()
            order = np.argsort(hashes, kind="stable")  # a bucket is a range of hashes; documents stay in order
            bucket = (hashes >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
            hashes, kinds, doc, bucket = hashes[order], kinds[order], doc[order], bucket[order].astype(np.int64)
            new_word = np.ones(len(hashes), bool)
            new_word[1:] = hashes[1:] != hashes[:-1]
            new_pair = new_word.copy()
            new_pair[1:] |= doc[1:] != doc[:-1]
            pair = np.flatnonzero(new_pair)
            often = np.diff(np.append(pair, len(hashes)))
            word = np.flatnonzero(new_word)
            total = np.zeros(len(hashes) + 1, np.int64)
            np.cumsum(train[doc], out=total[1:])
            trained = total[np.append(word[1:], len(hashes))] - total[word]
            spread = np.diff(np.searchsorted(pair, np.append(word, len(hashes))))
            stays = spread > SPREAD
            of_pair = np.repeat(stays, spread)
            own = pair[of_pair]
            rows = [(stretch % buckets, stretch, 0, _join(np.frombuffer(keys, np.uint8), hashes[word][stays], spread[stays].astype(np.uint32), doc[own].astype(np.uint32), often[of_pair].astype(np.uint32)))]
            pair, often, spread = pair[~of_pair], often[~of_pair], np.where(stays, 0, spread)
            some = np.unique(bucket[word])
            edges_w = np.searchsorted(bucket[word], np.append(some, buckets))
            ends_p = np.append(0, np.cumsum(spread))
            for k, b in enumerate(some.tolist()):
                w = slice(edges_w[k], edges_w[k + 1])
                p = slice(ends_p[w.start], ends_p[w.stop])
                rows.append((b, stretch, 1, _join(hashes[word][w], trained[w].astype(np.uint32), kinds[word][w], spread[w].astype(np.uint32), doc[pair][p].astype(np.uint32), often[p].astype(np.uint32))))
            names = ["bucket", "stretch", "kind", "payload"]
            for k in range(0, len(rows), 64):
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[k : k + 64]], pa.schema([("bucket", pa.int32()), ("stretch", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())]))

        for table in textvec.sized(batches, "text", frames.CHUNK_BYTES):
            hashes, kinds, words = _words(table, shape)
            held.append((table.column("key").to_pylist(), hashes, kinds, textvec.owner(words) + docs_held, table.column("train").to_numpy().astype(np.int64)))
            docs_held += table.num_rows
            size += table.column("text").nbytes
            if size >= STRETCH_BYTES:
                yield from flush()
                held, size, docs_held, count = [], 0, 0, count + 1
        if held:
            yield from flush()

    return docs.mapInArrow(frames.task(run, __name__), "bucket int, stretch long, kind int, payload binary")


def least_count(size: int) -> int:
    """Training occurrences from which a word is a class, for so many bytes of training text: their root by 8, so
    that classes grow about as the root of the text."""
    return max(10, math.isqrt(size) // 8)


def _met(table: pa.Table, shape: ModelShape, least: int) -> pa.Table:
    """What a bucket gives: kind 0 as it came, kind 1 documents' shares of a stretch, kind 2 the bucket's most
    frequent words and all that occur `least` times, and training tokens and distinct words by ending, kind 3
    the counts of a stretch's frequent words."""
    rows = table.to_pylist()
    blocks = [(r["stretch"], _split(r["payload"], "<u8", "<u4", "u1", "<u4", "<u4", "<u4")) for r in rows if r["kind"] == 1]
    out = [(0, r["stretch"], r["payload"]) for r in rows if r["kind"] == 0]
    if blocks:
        every = np.concatenate([b[0] for _, b in blocks])
        vocabulary, place = np.unique(every, return_inverse=True)
        counts = np.bincount(place, np.concatenate([b[1] for _, b in blocks]), len(vocabulary)).astype(np.int64)
        kinds = np.zeros(len(vocabulary), np.uint8)
        kinds[place] = np.concatenate([b[2] for _, b in blocks])
        gain = np.log10(counts + 1.0)
        at = 0
        for stretch, (own, _, _, spread, doc, often) in blocks:
            which = np.repeat(place[at : at + len(own)], spread)
            stays = spread == 0
            if stays.any():
                out.append((3, stretch, _join(own[stays], counts[place[at : at + len(own)][stays]])))
            at += len(own)
            some, near = np.unique(doc, return_inverse=True)
            share = np.bincount(near, gain[which] * often, len(some))
            known = np.bincount(near, (counts[which] > 0) * often.astype(np.float64), len(some))
            out.append((1, stretch, _join(some, share, known.astype(np.uint32))))
        top = np.lexsort((vocabulary, -counts))[: max(shape.words, int((counts >= least).sum()))]
        distinct = np.bincount(kinds[counts > 0], minlength=shape.endings)
        tokens = np.bincount(kinds, counts, shape.endings).astype(np.int64)
        out.append((2, 0, _join(vocabulary[top], counts[top], kinds[top], tokens, distinct)))
    return pa.Table.from_pylist([dict(zip(("kind", "stretch", "payload"), r, strict=True)) for r in out], pa.schema([("kind", pa.int32()), ("stretch", pa.int64()), ("payload", pa.binary())]))


def _shares(table: pa.Table) -> pa.Table:
    """Documents' sums over all buckets: (key, share, known)."""
    rows = sorted(table.to_pylist(), key=lambda r: r["payload"])
    keys, often, spread, doc, times = _split(next(r["payload"] for r in rows if r["kind"] == 0), "u1", "<u8", "<u4", "<u4", "<u4")
    keys = keys.tobytes()
    n = len(keys) // 16
    counts = np.zeros(len(often), np.int64)
    for r in rows:
        if r["kind"] == 3:
            own, count = _split(r["payload"], "<u8", "<i8")
            counts[np.searchsorted(often, own)] = count
    counts = np.repeat(counts, spread)
    share = np.bincount(doc, np.log10(counts + 1.0) * times, n).astype(np.float64)
    known = np.bincount(doc, (counts > 0) * times.astype(np.float64), n).astype(np.int64)
    for r in rows:
        if r["kind"] == 1:
            doc, a, b = _split(r["payload"], "<u4", "<f8", "<u4")
            share[doc] += a
            known[doc] += b
    return pa.table({"key": pa.array([keys[16 * i : 16 * i + 16] for i in range(n)], pa.binary()), "share": share, "known": known})


@dataclass
class Classes:
    """The frequent words (sorted hashes, with their counts), the endings' training tokens and distinct words."""

    words: np.ndarray
    counts: np.ndarray
    tokens: np.ndarray
    distinct: np.ndarray

    def of(self, hashes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Class of each word: its own (from 0), or that of its ending after those."""
        out = kinds.astype(np.int64) + len(self.words)
        if len(self.words) and len(hashes):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            own = self.words[at] == hashes
            out[own] = at[own]
        return out


def _sequences(table: pa.Table, classes: Classes, shape: ModelShape, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of each document's words and of its end (class size - 2), and the documents' offsets."""
    hashes, kinds, words = _words(table, shape)
    docs = len(words) - 1
    own = np.full(len(hashes) + docs, size - 2, np.int64)
    own[np.arange(len(hashes)) + textvec.owner(words)] = classes.of(hashes, kinds)
    return own, words + np.arange(docs + 1)


def _contexts(own: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two before each place of whole documents; size - 1 stands before the start."""
    one, two = np.full(len(own), size - 1, own.dtype), np.full(len(own), size - 1, own.dtype)
    one[1:], two[2:] = own[:-1], own[:-2]
    over = np.flatnonzero(own[:-1] == size - 2) + 1  # documents' first places but the very first
    one[over] = two[over] = size - 1
    over = over[over + 1 < len(own)] + 1
    two[over] = size - 1
    return one, two


class Model:
    """A log-bilinear model in two levels: a class's group in context, then the class within its group.

    counts: of the classes; the last one only stands before the start. Groups are of like frequency and
    some root of the classes in number, so that scores are normalised exactly at the cost of about that root. A score is a vector times the sum of the two context vectors, each through its
    position's matrix, plus a bias. `order` sorts classes by falling count; rows of q are in that order.
    """

    def __init__(self, counts: np.ndarray, shape: ModelShape):
        size, d = len(counts), shape.size
        weight = counts[: size - 1] + 0.5
        self.order = np.argsort(-weight, kind="stable")
        self.rank = np.empty(size, np.int32)
        self.rank[self.order], self.rank[size - 1] = np.arange(size - 1), size - 1
        weight = weight[self.order]
        mass = np.cumsum(np.sqrt(weight))
        many = math.ceil(math.sqrt(size - 1) / 1.5)
        _, self.group = np.unique(np.minimum(((mass - np.sqrt(weight)) / mass[-1] * many).astype(np.int64), many - 1), return_inverse=True)
        self.low = np.append(np.flatnonzero(np.diff(self.group, prepend=-1)), size - 1)
        of_group = np.add.reduceat(weight, self.low[:-1])
        self.inside = (weight / of_group[self.group]).astype(np.float32)
        self.groups = (of_group / of_group.sum()).astype(np.float32)
        rng = np.random.default_rng(shape.seed)
        # the last column is the bias, less the logarithm of the expected number of noise classes
        vectors = lambda n: np.hstack([rng.normal(0, 0.1, (n, d)), np.full((n, 1), -np.log(shape.noise))]).astype(np.float32)
        self.p = {"r": rng.normal(0, 0.1, (size, d)).astype(np.float32), "q": vectors(size - 1), "g": vectors(len(self.groups)), "c": np.vstack([np.eye(d), 0.5 * np.eye(d)]).astype(np.float32)}

    def learn(self, own: np.ndarray, one: np.ndarray, two: np.ndarray, shape: ModelShape, passes: int, rate: float, seed: tuple) -> dict[str, np.ndarray]:
        """Changes the model by `passes` passes over all trigrams, in an order of the seed's; how much each row saw.

        Noise-contrastive estimation: tell each class from `noise` classes by their frequencies, whose
        part of the gradient is taken as expected instead of drawn. Steps are scaled as by Adagrad, by row.
        """
        rng, p, low, d = np.random.default_rng(seed), self.p, self.low, shape.size
        size, many = len(p["r"]), len(self.groups)
        own, one, two = self.rank[own], self.rank[one], self.rank[two]
        seen = np.bincount(self.group[own], minlength=many).astype(np.float32)
        near_seen = (np.bincount(one, minlength=size) + np.bincount(two, minlength=size)).astype(np.float32)
        tokens = len(own)
        # repeated trigrams are learned from together, by their weight
        codes, often = np.unique((own.astype(np.int64) * size + one) * size + two, return_counts=True)
        times = -(-often // HEAVY)
        own, one, two = (np.repeat(x.astype(np.int32), times) for x in (codes // (size * size), codes // size % size, codes % size))
        weights = np.repeat((often / times).astype(np.float32), times)
        del codes, often, times
        sums = {k: np.full(len(v), 1e-8, np.float32) for k, v in p.items()}
        noise_in, noise_of = shape.noise * self.inside, shape.noise * self.groups
        batch = max(shape.batch, 64 * many)
        room, at_most = np.empty(batch * max(many, int(np.diff(low).max())), np.float32), np.arange(batch)

        def change(k: str, rows: slice | np.ndarray, grad: np.ndarray) -> None:
            sums[k][rows] += np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
            p[k][rows] -= grad * (rate / np.sqrt(sums[k][rows]))[:, None]

        def errors(context: np.ndarray, vectors: np.ndarray, noise: np.ndarray, true: np.ndarray, weight: np.ndarray) -> np.ndarray:
            e = room[: len(true) * len(noise)].reshape(len(true), len(noise))
            np.matmul(context, -vectors.T, out=e)
            np.exp(e, out=e)
            e += 1
            at = at_most[: len(true)]
            right = 1 / e[at, true] - 1
            np.divide(noise, e, out=e)
            e[at, true] += right
            e *= weight[:, None]
            return e

        with np.errstate(over="ignore"):
            for _ in range(passes):
                turn = rng.permutation(len(own)).astype(np.int32)
                for at in range(0, len(own), batch):
                    t = turn[at : at + batch]
                    t = t[np.argsort(own[t], kind="stable")]
                    w, weight, near = own[t], weights[t], np.concatenate([one[t], two[t]])
                    n = len(t)
                    r = p["r"][near]
                    r = np.hstack([r[:n], r[n:]])
                    context = np.ones((n, d + 1), np.float32)
                    np.matmul(r, p["c"], out=context[:, :d])
                    g = self.group[w]
                    e = errors(context, p["g"], noise_of, g, weight)
                    back = e @ p["g"]
                    change("g", slice(None), e.T @ context)
                    cuts = np.searchsorted(w, low)
                    for k in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(low) > 1)).tolist():
                        here, rows = slice(cuts[k], cuts[k + 1]), slice(low[k], low[k + 1])
                        e = errors(context[here], p["q"][rows], noise_in[rows], w[here] - low[k], weight[here])
                        back[here] += e @ p["q"][rows]
                        change("q", rows, e.T @ context[here])
                    back = np.ascontiguousarray(back[:, :d])
                    grad = back @ p["c"].T
                    change("c", slice(None), r.T @ back)
                    grad = np.vstack([grad[:, :d], grad[:, d:]])
                    by = np.argsort(near, kind="stable")
                    near = near[by]
                    first = np.flatnonzero(np.diff(near, prepend=-1))
                    change("r", near[first], np.add.reduceat(grad[by], first))
        return {"r": near_seen, "q": seen[self.group], "g": np.full(many, tokens, np.float32), "c": np.full(2 * d, tokens, np.float32)}

    def log10(self, own: np.ndarray, one: np.ndarray, two: np.ndarray, held: int = 1 << 12) -> np.ndarray:
        """Normalised log10 probability of each class in its context."""
        d = self.p["r"].shape[1]
        by_place = self.p["r"] @ self.p["c"][:d], self.p["r"] @ self.p["c"][d:]
        vectors = {k: self.p[k] + np.append(np.zeros((len(n), d), np.float32), np.log(n)[:, None], 1) for k, n in (("q", self.inside), ("g", self.groups))}
        size = len(self.p["r"])
        codes, back = np.unique((self.rank[own].astype(np.int64) * size + self.rank[one]) * size + self.rank[two], return_inverse=True)
        own, one, two = codes // (size * size), codes // size % size, codes % size  # by rank: few groups meet in each block
        out = np.empty(len(own))

        def level(context: np.ndarray, rows: np.ndarray, true: np.ndarray) -> np.ndarray:
            z = context @ rows.T
            z -= z.max(1, keepdims=True)
            at = z[np.arange(len(true)), true]
            return at - np.log(np.exp(z, out=z).sum(1))

        for at in range(0, len(own), held):
            t = slice(at, at + held)
            w = own[t]
            context = np.ones((len(w), d + 1), np.float32)
            np.add(by_place[0][one[t]], by_place[1][two[t]], out=context[:, :d])
            log = level(context, vectors["g"], self.group[w]).astype(np.float64)
            cuts = np.searchsorted(w, self.low)
            for k in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(self.low) > 1)).tolist():
                here = slice(cuts[k], cuts[k + 1])
                log[here] += level(context[here], vectors["q"][self.low[k] : self.low[k + 1]], w[here] - self.low[k])
            out[t] = log
        return out[back] / np.log(10)


def passes_over(tokens: int, shape: ModelShape) -> int:
    """Passes over all trigrams: one at least, and as many as `steps` batches take."""
    return max(1, -(-shape.steps * shape.batch // max(tokens, 1)))


def train(codes: np.ndarray, counts: np.ndarray, size: int, shape: ModelShape) -> np.ndarray:
    """Log10 probabilities (size * size contexts, size classes) of a model of counted trigrams: codes of two
    classes before, then the class; class size - 1 only stands before the start."""
    if not len(codes):
        return np.full((size * size, size), -np.log10(size))
    every = np.repeat(codes, counts)
    two, one, own = every // (size * size), every // size % size, every % size
    model = Model(np.bincount(own, minlength=size), shape)
    model.learn(own, one, two, shape, passes_over(len(own), shape), RATE, (shape.seed,))
    two, one, own = (x.ravel() for x in np.indices((size, size, size - 1)))
    out = np.full((size * size, size), -50.0)
    out[:, : size - 1] = model.log10(own, one, two).reshape(size * size, size - 1)
    return out


def _trained(docs: DataFrame, classes: Classes, counts: np.ndarray, size_bytes: int, shape: ModelShape) -> Model:
    """The model of all of docs (text, place): every training trigram is learned from.

    Documents are dealt by `place` into slices that grow with the model, so that models sent stay a part of
    the input. In each of a few rounds a slice's share of documents changes a copy of the model, and copies
    are averaged, each row by what it saw. Slices depend on the documents alone, not on how they are stored.
    """
    spark, size, tokens = docs.sparkSession, len(counts), int(counts.sum())
    model = Model(counts, shape)
    width = sum(v.nbytes for v in model.p.values())
    slices = -(-size_bytes // min(max(12 * width, SLICE_BYTES), 6 * SLICE_BYTES))
    rounds = ROUNDS if slices > 1 else 1
    blocks = -(-width // (1 << 20))
    passes = passes_over(tokens, shape)

    def code(table: pa.Table) -> list:
        own, offs = _sequences(table, classes, shape, size)
        return [frames.packed(own.astype(np.int32), np.diff(offs))]

    def pack(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("place").to_pylist(), table.column("codes").to_pylist(), strict=True))
        return pa.table({"unit": table.column("unit")[:1], "codes": pa.array([b"".join(c for _, c in rows)], pa.binary())})

    coded = frames.append(docs.select("place", "text"), "text", {"codes": "binary"}, code, drop_text=True)
    coded = coded.withColumn("unit", F.pmod("place", F.lit(slices * rounds)))
    coded = frames.settled(frames.grouped(coded, "unit", min(slices * rounds, TASKS), pack, "unit long, codes binary"), "slices")
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], k: int = k, sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for unit, codes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    own = np.frombuffer(codes.as_buffer(), np.int32)
                    copy = pickle.loads(pickle.dumps(sent.value))
                    seen = copy.learn(own, *_contexts(own, size), shape, passes, RATE / (k + 1), (shape.seed, unit))
                    parts = {n: (np.array_split(copy.p[n], blocks), np.array_split(seen[n], blocks)) for n in copy.p}
                    rows = [_join(*(x for n in parts for x in ((parts[n][0][b] * parts[n][1][b][:, None]).ravel(), parts[n][1][b]))) for b in range(blocks)]
                    yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([unit] * blocks, pa.int64()), pa.array(rows, pa.binary())], names=["block", "unit", "payload"])

        def add(table: pa.Table, kind: str, by: list[str]) -> pa.Table:
            total: list[np.ndarray] = []
            for _, payload in sorted(zip(table.column("unit").to_pylist(), table.column("payload").to_pylist(), strict=True)):
                own = _split(payload, *[kind] * 8)
                total = [a + b for a, b in zip(total, own, strict=True)] if total else [x.astype(np.float64) for x in own]
            return pa.table({**{c: table.column(c)[:1] for c in by}, "unit": table.column("unit")[:1], "payload": pa.array([_join(*total)], pa.binary())})

        # some root of the copies are added first, so that no task reads more than that root of them
        met = coded.where(F.col("unit") % rounds == k).mapInArrow(frames.task(learn, __name__), "block int, unit long, payload binary")
        some = met.withColumn("part", (F.floor(F.col("unit") / rounds) % math.isqrt(slices)).cast("int")).groupBy("block", "part").applyInArrow(lambda t: add(t, "<f4", ["block", "part"]), "block int, part int, unit long, payload binary")
        every = some.groupBy("block").applyInArrow(lambda t: add(t, "<f8", ["block"]), "block int, unit long, payload binary")
        for row in every.select("block", "payload").toLocalIterator():
            got = _split(row[1], *["<f8"] * 8)
            for i, n in enumerate(model.p):
                at = np.array_split(np.arange(len(model.p[n])), blocks)[row[0]]
                on = got[2 * i + 1] > 0
                model.p[n][at[on]] = (got[2 * i].reshape(len(at), -1)[on] / got[2 * i + 1][on][:, None]).astype(np.float32)
    frames.discard(coded)
    return model


def scored(df: DataFrame, text: str = "text", doc_id: str = "doc_id", modulus: int = 7, held: int = 2, shape: ModelShape = ModelShape()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of df.

    Training rows are those whose crc32 of doc_id as text, modulo `modulus`, is not `held` (a null
    identifier counts as an empty one). A null text is empty: one token, its end. Repeated rows count
    as often as they occur and get equal scores but for rounding. Without any training token all counts are 0 and the
    model is uniform. An empty table gives no rows. Texts of any length are scored whole.
    """
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("key", frames.text_key("text")).withColumn("held_out", frames.bucket_of("doc_id", modulus) == held)
    keyed = docs.select("text", "key", (~F.col("held_out")).cast("int").alias("train"), F.xxhash64("doc_id", "key").alias("place"))
    trained = F.when(~F.col("held_out"), F.octet_length("text"))
    size = docs.agg(F.sum(F.octet_length("text")), F.sum(trained), F.sum((~F.col("held_out")).cast("long"))).first()
    buckets = max(1, -(-(size[0] or 0) // BUCKET_BYTES))
    ends, least = size[2] or 0, least_count(size[1] or 0)

    blocks = _blocks(keyed.drop("place"), buckets, shape)
    met = frames.grouped(blocks, "bucket", min(buckets, TASKS), lambda t: _met(t, shape, least), "kind int, stretch long, payload binary")
    met = frames.settled(met, "counts")
    shares = met.where("kind <> 2").groupBy("stretch").applyInArrow(_shares, "key binary, share double, known long")
    shares = frames.settled(shares.groupBy("key").agg(F.min("share").alias("share"), F.min("known").alias("known")), "shares")

    # each bucket's frequent words, and tokens and distinct words by ending; the most frequent of all are kept
    hashes, counts, kinds = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    rest, distinct = np.zeros(shape.endings, np.int64), np.zeros(shape.endings, np.int64)
    for row in met.where("kind = 2").select("payload").toLocalIterator():
        h, c, k, n, d = _split(row[0], "<u8", "<i8", "u1", "<i8", "<i8")
        hashes, counts, kinds = np.concatenate([hashes, h]), np.concatenate([counts, c]), np.concatenate([kinds, k])
        top = np.lexsort((hashes, -counts))[: max(shape.words, int((counts >= least).sum()))]
        hashes, counts, kinds = hashes[top], counts[top], kinds[top]
        rest, distinct = rest + n, distinct + d
    tokens = int(rest.sum())
    vocabulary = int(distinct.sum()) + (ends > 0)
    top = np.flatnonzero(counts > 0)
    top = top[np.argsort(hashes[top])]
    rest -= np.bincount(kinds[top], counts[top], shape.endings).astype(np.int64)
    distinct -= np.bincount(kinds[top], minlength=shape.endings)
    classes = Classes(hashes[top], counts[top], rest, distinct)
    n_class = len(top) + shape.endings + 2
    every = np.concatenate([classes.counts, rest, [ends, 0]])
    model = _trained(keyed.where("train = 1"), classes, every, (size[1] or 0) + ends, shape) if ends else None
    sent = spark.sparkContext.broadcast((classes, model))

    def make(table: pa.Table) -> list:
        own_classes, own_model = sent.value
        own, offs = _sequences(table, own_classes, shape, n_class)
        log = np.full(len(own), -np.log10(n_class)) if own_model is None else own_model.log10(own, *_contexts(own, n_class))
        doc = textvec.owner(offs)
        gain = np.zeros(n_class)
        gain[: len(own_classes.words)] = np.log10(own_classes.counts + 1.0)
        inside = np.zeros(n_class)
        inside[len(own_classes.words) : len(own_classes.words) + shape.endings] = np.log10(own_classes.tokens + own_classes.distinct + 1.0)
        sums = [np.bincount(doc, x, table.num_rows) for x in (log, gain[own], inside[own])]
        return [np.diff(offs), *sums]

    out = frames.append(docs.select("doc_id", "held_out", "key", "text"), "text", FIELDS, make, drop_text=True).join(shares, "key")
    total = tokens + ends
    base = F.col("share") + F.lit(float(np.log10(ends + 1.0))) - F.col("n_tokens") * F.lit(float(np.log10(total + vocabulary + 1.0)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("lbl") + F.col("share") - F.col("own_words") - F.col("in_class")).alias("score"),
    )
