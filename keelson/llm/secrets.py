"""Secret scans: three pattern rules, and a token-efficiency test for random strings.

Words and common identifiers compress to few tokens under a byte-level BPE vocabulary; random strings
do not. Runs of credential characters with letters are tokenised, and one whose characters per token are
low is reported, or else pieces of it of which that holds, unless it is a digest of a known length, a UUID or another
known identifier.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import frames

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: What every match of ASSIGN holds, in lower case.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
PIECE = re.compile(r"[^/=+]{20,}")
#: Digests (hexadecimal of MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512), UUIDs, numbers with separators.
KNOWN = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+)\Z")

SPAN = "array<struct<kind:string,start:int,end:int>>"
FIELDS = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string"}

_encodings: dict[tuple[str, str], tiktoken.Encoding] = frames.kept()


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    if (path, pattern) not in _encodings:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path, pattern] = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the pattern rules' matches, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, enc: tiktoken.Encoding, ratio: float) -> list[tuple[int, int, int]]:
    """Runs of under `ratio` characters per token that hold letters and are no known identifier; of a run that
    is none as a whole, its pieces between '/', '=' and '+'."""

    def random(run: str) -> bool:
        return len(run) >= 20 and any(c.isalpha() for c in run) and not KNOWN.match(run) and len(run) < ratio * len(enc.encode_ordinary(run))

    out = []
    for m in CANDIDATE.finditer(text):
        run = m[0].strip("=-_/+")
        at = m.start() + m[0].index(run)
        if random(run):
            out.append((at, 3, at + len(run)))
        elif len(run) > 20 and not KNOWN.match(run):
            for piece in PIECE.finditer(run):
                own = piece[0].strip("-_")
                if len(own) < len(run) and random(own):
                    a = at + piece.start() + piece[0].index(own)
                    out.append((a, 3, a + len(own)))
    return out


def scan(text: str, enc: tiktoken.Encoding, ratio: float) -> tuple[list, list]:
    """Base spans, and all spans; an added span that a base one overlaps is left out."""
    base = base_spans(text)
    more = [s for s in random_spans(text, enc, ratio) if not any(b[0] < s[2] and s[0] < b[2] for b in base)]
    return base, sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ratio: float = 2.2, spans: str = "secret_spans") -> DataFrame:
    """df with `spans`: kind, start and end (code points, end exclusive) of every find, by start, then kind.

    A null or empty text has none. Rows are scanned one by one and whole, so repeated rows get equal
    results; an empty table stays empty; a column of df named as `spans` is replaced.
    """

    def make(table: pa.Table) -> list:
        enc = encoding(vocabulary, pattern)
        rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(t or "", enc, ratio)[1]] for t in table.column(text).to_pylist()]
        return [pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]

    return frames.append(df, text, {spans: SPAN}, make)


def digests(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ratio: float = 2.2, keep: list[str] | None = None) -> DataFrame:
    """df with the columns of FIELDS: counts of the base kinds, digest of the base spans as kind:start:end,
    and all spans joined likewise. Cases as in secret_spans()."""

    def make(table: pa.Table) -> list:
        enc = encoding(vocabulary, pattern)
        both = [scan(t or "", enc, ratio) for t in table.column(text).to_pylist()]
        counts = [np.array([sum(s[1] == k for s in base) for base, _ in both], np.int64) for k in range(3)]
        return [*counts, [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in both], [joined(all_) for _, all_ in both]]

    return frames.append(df, text, FIELDS, make, keep=keep)


_MASKED = "__secrets_masked"  # a name that no column of a user should have


def masked(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ratio: float = 2.2, mask: str = "[SECRET]", length: str | None = "n_chars") -> DataFrame:
    """df with every found span replaced by `mask` in the text; `length`, if df has it, is set to the new
    number of characters of changed texts. Overlapping spans are replaced as one. Texts without a find, nulls among them, stay."""

    def make(table: pa.Table) -> list:
        enc = encoding(vocabulary, pattern)
        out = []
        for t in table.column(text).to_pylist():
            spans = scan(t, enc, ratio)[1] if t else []
            if spans:
                parts, at = [], 0
                for a, _, b in spans:
                    if a >= at:
                        parts += [t[at:a], mask]
                    at = max(at, b)
                t = "".join([*parts, t[at:]])
            out.append(t)
        return [out]

    names = df.columns
    out = frames.append(df, text, {_MASKED: "string"}, make)
    changed = ~F.col(_MASKED).eqNullSafe(F.col(f"`{text}`"))
    new = {text: F.col(_MASKED)}
    if length in names:
        new[length] = F.when(changed, F.char_length(_MASKED).cast(df.schema[length].dataType)).otherwise(F.col(f"`{length}`"))
    return out.select(*[(new[c].alias(c) if c in new else F.col(f"`{c}`")) for c in names])
