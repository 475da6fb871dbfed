"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

The BPE encoding of a byte string has a simple invariant: cut off its last token and what remains
is the encoding of that shorter prefix. So each prefix has exactly one valid last token, and one
number a prefix stores all encodings. The last token of a prefix is the vocabulary entry that ends
there and forms a valid pair with the last token of the prefix before it: a pair is valid when
merging both byte strings by the ranks would never join across their border.

Appending bytes therefore leaves all earlier entries as they are, and after an edit only the
entries from the edit on are made anew.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNKS = 400_000  # chunks of text that a Python worker remembers, twice
CHUNK_CHARS = 64  # longer ones are not remembered
PIECES = 600_000  # matches of the pattern that it remembers
SHORT = 64  # bytes that are encoded from the end; longer strings from the start
BATCH_ROWS = 1_000
PAIRS = 1_000_000  # pairs of tokens that it remembers


class Vocabulary:
    """Ranks of byte strings; the rank is the token id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks), default=1)
        self._halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        """Lines of base64 token and rank."""
        return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines()) if t})

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one; a token that no merge makes is its own halves."""
        if token not in self._halves:
            parts = _merge(self.tokens[token], self.ranks, below=token)
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else (token, token)
        return self._halves[token]

    def joins(self, left: int, right: int) -> bool:
        """True if the two tokens stand side by side in the encoding of their joined bytes."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        fits = self.pairs[left, right] = self._border_holds(left, right)
        return fits

    def _border_holds(self, left: int, right: int) -> bool:
        """Take the two tokens apart in the reverse order of their merges.

        While both existed, a merge across the border would have come first only if its rank was
        below that of the later of the two merges that are undone.
        """
        made = len(self.tokens)  # rank of the merge that comes next on either side
        while True:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < made:
                return False
            inner, outer = self.halves(left)[1], self.halves(right)[0]
            if inner == left and outer == right:
                return True
            if outer == right or (inner != left and left > right):
                made, left = left, inner
            else:
                made, right = right + 1, outer  # on equal ranks the merge further left comes first


def _merge(data: bytes, ranks: dict[bytes, int], below: int) -> list[int]:
    """Plain merging in the order of ranks, with merges of rank < ``below`` only."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Prefixes:
    """Encoding of one byte string, open to appends and edits.

    ``last[i]`` is the last token of the first i bytes, filled when it is asked for: the end of the
    string needs only the prefixes that its candidates lead to.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, b""
        self.last: list[int | None] = [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        """Entries of earlier prefixes stay."""
        start = len(self.data)
        self.data += data
        self.last += [None] * len(data)
        if len(data) > SHORT:  # from the left, so that no chain of open prefixes gets long
            for end in range(start + 1, len(self.data) + 1):
                self._fill(end)

    def _fill(self, end: int) -> int:
        v, data, last = self.vocabulary, self.data, self.last
        ranks, pairs = v.ranks, v.pairs
        for begin in range(max(0, end - v.longest), end):
            token = ranks.get(data[begin:end])
            if token is None:
                continue
            if begin:
                left = last[begin]
                if left is None:
                    left = self._fill(begin)
                fits = pairs.get((left, token))
                if fits is None:
                    fits = v.joins(left, token)
                if not fits:
                    continue
            last[end] = token
            return token
        raise ValueError(f"no token ends at byte {end}")

    def replace(self, start: int, end: int, data: bytes) -> None:
        """Put ``data`` in place of bytes start..end; entries before ``start`` stay."""
        rest = self.data[end:]
        self.data = self.data[:start]
        del self.last[start + 1 :]
        self.append(data + rest)

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            token = self.last[end]
            out.append(self._fill(end) if token is None else token)
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class Encoder:
    """Splits text by the pattern and encodes each match separately.

    A space between two other characters that are not white space always starts a match, so the
    text may first be cut there; what follows such a space is looked up as one chunk. Texts with
    other uses of the space go through the pattern as a whole.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.split = regex.compile(pattern).findall
        self.uneven = re.compile(r" \s|\s | $").search
        self._now: dict[str, bytes] = {}  # chunks met since _before was set aside
        self._before: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def pieces(self, text: str) -> bytes:
        """Ids of the matches of a text as little-endian 32-bit integers."""
        known = self._pieces
        out = []
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                data = piece.encode()
                whole = self.vocabulary.ranks.get(data)
                tokens = Prefixes(self.vocabulary, data).ids() if whole is None else [whole]
                ids = struct.pack(f"<{len(tokens)}I", *tokens)
                if len(data) <= SHORT:
                    if len(known) >= PIECES:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def _chunk(self, chunk: str) -> bytes:
        ids = self._before.get(chunk)
        if ids is None:
            ids = self._now.get(chunk)
        if ids is None:
            ids = self.pieces(" " + chunk)
        if len(chunk) <= CHUNK_CHARS:
            if len(self._now) >= CHUNKS:
                self._before, self._now = self._now, {}
            self._now[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.uneven(text):
            return self.pieces(text)
        chunks = text.split(" ")
        found = list(map(self._now.get, chunks))
        found[0] = self.pieces(chunks[0])
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self._chunk(chunks[i])
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[tuple[bytes, str], Encoder] = {}  # of this Python worker


def encoder(data: bytes, pattern: str) -> Encoder:
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(Vocabulary.parse(data), pattern)
    return _ENCODERS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and n_tokens, ids (little-endian unsigned 32-bit), decoded (bytes).

    One pass without a shuffle. A null text is empty: no ids, no bytes. Every row gives one row, also
    repeated ones; columns called like the new ones are replaced. The rank file (about 1 MB) is read by
    the driver and broadcast, so that executors need no copy of it.
    """
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    kept = [c for c in docs.columns if c not in (text_col, *(f.name for f in new))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                ids = [e.encode(t or "") for t in part.column(len(kept)).to_pylist()]
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                decoded = pa.array([e.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], counts, pa.array(ids, pa.binary()), decoded], [*kept, "n_tokens", "ids", "decoded"]
                )

    schema = T.StructType([*(docs.schema[c] for c in kept), *new])
    return docs.select(*kept, text_col).mapInArrow(run, schema)
