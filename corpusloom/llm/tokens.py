"""Encoding of texts with a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern, and the bytes of a piece are merged pairwise, always the pair of
lowest rank, the leftmost among equals. A segment tree over the byte positions holds at each leaf the rank of the pair
that starts there and at each node the leftmost minimum, so the next merge is read at the root, and a merge changes
three leaves (the pair itself, the position swallowed, and the live neighbour before it): O(log n) for each merge, which
keeps pieces of any length cheap. Pieces that a worker met before are looked up; the table of known pieces is bounded.

Texts are encoded whole, each by one task, without a shuffle. The vocabulary file (below a megabyte, fixed in size) is
broadcast. Defined cases: null and empty texts give an empty list; strings of special tokens are ordinary text; bytes
that aren't UTF-8 are read as replacement characters; repeated rows give repeated rows; other columns are dropped.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern that cuts texts into pieces (fixed by the vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Vocabularies above this size aren't broadcast; none of the public ones comes near it.
LARGEST_VOCABULARY = 64 << 20
KNOWN_PIECES = 1 << 18
_NONE = 1 << 62


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> bytes:
    """A .tiktoken file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        data = f.read(LARGEST_VOCABULARY + 1)
    if len(data) > LARGEST_VOCABULARY:
        raise ValueError(f"{path} is too large for a vocabulary")
    return data


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a piece, which isn't empty."""
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    after = list(range(1, n + 2))  # start of the token behind the one that starts here
    before = list(range(-1, n))
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b

    def put(i: int, value: int) -> None:
        node = size + i
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            least = a if a < b else b
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1

    def pair(i: int) -> int:
        j = after[i]
        if j >= n:
            return _NONE
        r = get(piece[i : after[j]])
        return _NONE if r is None else r << 32 | i

    while tree[1] != _NONE:
        i = tree[1] & 0xFFFFFFFF
        j = after[i]
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        put(j, _NONE)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Text to ids. Keeps the ids of at most KNOWN_PIECES pieces of up to 64 characters."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def piece(self, text: str) -> tuple[int, ...]:
        raw = text.encode("utf-8")
        whole = self.ranks.get(raw)
        ids = (whole,) if whole is not None else tuple(merge(raw, self.ranks))
        if len(text) <= 64:
            if len(self.known) >= KNOWN_PIECES:
                self.known.clear()
            self.known[text] = ids
        return ids

    def __call__(self, text: str) -> list[int]:
        out: list[int] = []
        get, extend = self.known.get, out.extend
        for p in self.pieces(text):
            extend(get(p) or self.piece(p))
        return out


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The worker's encoder of a broadcast vocabulary; a worker keeps one."""
    if shared.value[0] not in _encoders:
        _encoders.clear()
        _encoders[shared.value[0]] = Encoder(shared.value[1], shared.value[2])
    return _encoders[shared.value[0]]


def _shared(df: DataFrame, vocabulary: str, pattern: str):
    data = read_vocabulary(vocabulary)
    return df.sparkSession.sparkContext.broadcast((hash((data, pattern)), data, pattern))


def _texts(column: pa.Array):
    for raw in column.to_pylist():
        yield "" if raw is None else raw.decode("utf-8", "replace")


def encode(documents: DataFrame, *, vocabulary: str = DEFAULT_VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids) of every row."""
    shared = _shared(documents, vocabulary, pattern)

    def run(batches):
        encoder = _encoder(shared)
        for batch in batches:
            counts, flat = [0], []
            for text in _texts(batch.column(1)):
                flat.extend(encoder(text))
                counts.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(counts, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def count_tokens(documents: DataFrame, *, vocabulary: str = DEFAULT_VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, source, n_tokens) of every row."""
    shared = _shared(documents, vocabulary, pattern)

    def run(batches):
        encoder = _encoder(shared)
        for batch in batches:
            n = pa.array([len(encoder(text)) for text in _texts(batch.column(2))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["doc_id", "source", "n_tokens"])

    return documents.select("doc_id", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, source string, n_tokens long")
