"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece's bytes there is one token that ends the prefix's encoding. It is found
from the shorter prefixes: of the tokens that end there, exactly one is compatible with the last
token of the prefix before it, where a pair is compatible if BPE would leave the two side by side.
The table of last tokens is therefore an encoding of all prefixes at once: bytes can be appended
exactly without starting over, and after an edit only the places from the edit on are computed anew.

Text is first cut by the vocabulary's pattern; each match is encoded separately.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from keelson.llm import frames

FIELDS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
WORD_BYTES, PIECE_BYTES = 160 << 20, 48 << 20  # about what words, and pieces of words, with their ids may take in a Python worker
APART = 300_000  # pairs of tokens of which a worker keeps whether they stay apart
_ENTRY = 220  # bytes of an entry besides its text and ids


class Vocabulary:
    """Token ranks with what tells whether two neighbouring tokens stay apart."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.none = max(self.tokens, default=0) + 2  # above any rank
        self.halves: dict[int, tuple[int, int]] = {}
        self._apart: dict[int, bool] = {}
        #: Tokens that merging cannot make from their own bytes; they end no prefix.
        self.unreachable: set[int] = set()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            parts = self._merged(token, rank) if len(token) > 1 else [rank]
            if len(parts) == 2:
                self.halves[rank] = (parts[0], parts[1])
            else:
                self.halves[rank] = (rank, rank)
                if len(token) > 1:
                    self.unreachable.add(rank)
        #: Tokens by their bytes from the last to the first, as nested tables; under 256 the rank of what ends there.
        self.backwards: dict = {}
        for token, rank in ranks.items():
            if rank not in self.unreachable:
                node = self.backwards
                for byte in reversed(token):
                    node = node.setdefault(byte, {})
                node[256] = rank

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def _merged(self, piece: bytes, below: int) -> list[int]:
        """What merges of ranks under `below` make of the bytes."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves left and right side by side: no merge across their border comes before
        those that made the tokens, looking at ever earlier halves next to the border."""
        key = left * self.none + right
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= APART:
                self._apart.clear()
            known = self._apart[key] = self._stay(left, right)
        return known

    def _stay(self, left: int, right: int) -> bool:
        tokens, ranks, halves = self.tokens, self.ranks, self.halves
        limit = self.none
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            # merges to the left come first among equals, so a tie with the left token's own merge crosses nothing
            if joined is not None and joined < limit:
                return False
            whole_left, whole_right = len(tokens[left]) == 1, len(tokens[right]) == 1
            if whole_left and whole_right:
                return True
            if whole_right or (not whole_left and left > right):
                limit, left = left, halves[left][1]
            elif whole_left or right >= left:
                limit, right = right + 1, halves[right][0]

    def last_tokens(self, piece: bytes, done: list[int] | None = None) -> list[int]:
        """The last token of each prefix's encoding, from 1 byte on. done: the table of a prefix, to go on from."""
        last = list(done or ())
        backwards, apart, shift = self.backwards, self._apart, self.none
        for end in range(len(last), len(piece)):
            node, start = backwards, end + 1
            while start:
                start -= 1
                node = node.get(piece[start])
                if node is None:
                    raise ValueError(f"no token ends {piece[: end + 1]!r}")
                rank = node.get(256)
                if rank is None:
                    continue
                if not start:
                    last.append(rank)
                    break
                before = last[start - 1]
                ok = apart.get(before * shift + rank)
                if ok if ok is not None else self.apart(before, rank):
                    last.append(rank)
                    break
        return last

    def walk(self, last: list[int], end: int | None = None) -> list[int]:
        """The encoding of the first `end` bytes, read backwards off the table."""
        out, at = [], len(last) if end is None else end
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[out[-1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """As BPE encodes one match of the pattern: a piece that is a token stands for itself."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk(self.last_tokens(piece))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


def pack(ids: list[int]) -> bytes:
    """Unsigned 32-bit little-endian integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Piece:
    """An editable piece: its bytes and their table of last tokens."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, data
        self.last = vocabulary.last_tokens(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.last = self.vocabulary.last_tokens(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Put new for bytes start to end; the table before start stays."""
        self.data = self.data[:start] + new + self.data[end:]
        self.last = self.vocabulary.last_tokens(self.data, self.last[:start])

    def ids(self, end: int | None = None) -> list[int]:
        return self.vocabulary.walk(self.last, end)


class Kept:
    """Ids of texts, for about `most` bytes: once the newer half is full the older one goes, but for what was asked for since."""

    def __init__(self, most: int):
        self.most = most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0  # bytes of the newer half

    def put(self, text: str, ids: bytes) -> None:
        if len(text) <= 64:
            if self.held > self.most // 2:
                self.old, self.new, self.held = self.new, {}, 0
            self.new[text] = ids
            self.held += len(text) + len(ids) + _ENTRY

    def older(self, text: str) -> bytes | None:
        ids = self.old.get(text)
        if ids is not None:
            self.put(text, ids)
        return ids


class Encoder:
    """Texts to ids, each as packed unsigned 32-bit little-endian integers.

    A single ASCII space between two other characters always starts a match of the pattern, so what
    lies between such spaces is encoded by itself and kept; in texts with double spaces, or with one
    at an end, the pattern cuts the whole.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.words, self.pieces = Kept(WORD_BYTES), Kept(PIECE_BYTES)

    def _cut(self, pieces: list[str]) -> bytes:
        known, out = self.pieces, []
        for piece in pieces:
            ids = known.new.get(piece) or known.older(piece)
            if ids is None:
                ids = pack(self.vocabulary.encode_piece(piece.encode()))
                known.put(piece, ids)
            out.append(ids)
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        ids = self.words.older(word)
        if ids is None:
            pieces = self.pattern.findall(word)
            ids = pack(self.vocabulary.encode_piece(word.encode())) if len(pieces) == 1 else self._cut(pieces)
            self.words.put(word, ids)
        return ids

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [self.encode(text) for text in texts]

    def encode(self, text: str) -> bytes:
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return self._cut(self.pattern.findall(text))
        parts = text.split(" ")
        get, make = self.words.new.get, self._word
        head = self._cut(self.pattern.findall(parts[0])) if parts[0] else b""
        return head + b"".join([get(w) or make(w) for w in [" " + p for p in parts[1:]]])


_encoders: dict[tuple[str, str], tuple[Encoder, np.ndarray, np.ndarray]] = frames.kept()


def encoder(path: str, pattern: str) -> tuple[Encoder, np.ndarray, np.ndarray]:
    """The worker's encoder of this vocabulary; token bytes one after another and their offsets, to decode by."""
    if (path, pattern) not in _encoders:
        v = Vocabulary.load(path)
        size = max(v.tokens) + 1
        lengths = np.array([len(v.tokens.get(i, b"")) for i in range(size)], np.int64)
        data = np.frombuffer(b"".join(v.tokens.get(i, b"") for i in range(size)), np.uint8)
        _encoders[path, pattern] = Encoder(v, pattern), data, np.concatenate([[0], np.cumsum(lengths)])
    return _encoders[path, pattern]


def decode_packed(ids: bytes, data: np.ndarray, offs: np.ndarray) -> bytes:
    at = np.frombuffer(ids, "<u4").astype(np.int64)
    lengths = offs[at + 1] - offs[at]
    ends = np.cumsum(lengths)
    shift = np.repeat(offs[at] - (ends - lengths), lengths)
    return data[shift + np.arange(len(shift))].tobytes()


def encoded(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """df with `ids` (array<int>), the encoding of every text; a null text has no ids.

    Any text is encoded whole; an empty table stays empty; repeated rows are encoded alike; a column
    of df named as `ids` is replaced.
    """

    def make(table: pa.Table) -> list:
        lists = encoder(vocabulary, pattern)[0].encode_all([t or "" for t in table.column(text).to_pylist()])
        offs = np.concatenate([[0], np.cumsum([len(x) // 4 for x in lists])]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(lists), np.int32)))]

    return frames.append(df, text, {ids: "array<int>"}, make)


def digests(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with the columns of FIELDS, after a round trip: count and digest of the ids, and digest of
    the bytes decoded from them. Nulls and other cases as in encoded()."""

    def make(table: pa.Table) -> list:
        own, data, offs = encoder(vocabulary, pattern)
        lists = own.encode_all([t or "" for t in table.column(text).to_pylist()])
        return [
            np.array([len(x) // 4 for x in lists], np.int64),
            [hashlib.sha256(x).hexdigest() for x in lists],
            [hashlib.sha256(decode_packed(x, data, offs)).hexdigest() for x in lists],
        ]

    return frames.append(df, text, FIELDS, make, keep=keep)
