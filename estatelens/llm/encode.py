"""Byte-pair encoding of whole texts with a public vocabulary.

Every pre-token is encoded by merging, again and again, the leftmost pair of lowest rank. The
ranks of the pairs of live neighbours are the leaves of a segment tree over byte positions
whose nodes hold the leftmost minimum, so a merge is a look at the root and three point
updates of logarithmic cost: a run of n bytes takes O(n log n) however long it is.

Texts repeat their words, so encodings are kept per worker: first by stretch between blanks,
then by pre-token. A blank that a non-space follows always begins a pre-token of the
vocabulary's pattern and the pattern looks only at what follows, hence a text may be cut there.

Null and empty texts have no ids: an empty list.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern that belongs to the byte_bpe vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT = 150_000  # entries kept per worker and level; emptied when full, which changes no result
_NONE = 1 << 62


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token by segment-tree merging; bytes that the vocabulary lacks raise KeyError."""
    n = len(word)
    if n == 1:
        return [ranks[word]]
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        if (rank := ranks.get(word[i : i + 2])) is not None:
            tree[size + i] = rank << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                return
            tree[k] = low

    while (best := tree[1]) != _NONE:
        i = best & 0xFFFFFFFF
        gone = ends[i]  # the token after i begins there; it joins i
        end = ends[i] = ends[gone]
        if gone < n - 1:
            put(gone, _NONE)
        if end < n:
            before[end] = i
            rank = ranks.get(word[i : ends[end]])
            put(i, _NONE if rank is None else rank << 32 | i)
        elif i < n - 1:
            put(i, _NONE)
        if (left := before[i]) >= 0:
            rank = ranks.get(word[left:end])
            put(left, _NONE if rank is None else rank << 32 | left)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


class _Kept(dict):
    """A dictionary that makes what it lacks, and empties itself when full."""

    def __init__(self, make, most: int = KEPT):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        value = self.make(key)
        if len(key) <= 200:
            self[key] = value
        return value


class Encoder:
    """Encodes texts; ``vocabulary`` is the content of a .tiktoken file (base64 token, rank per line)."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.find = regex.compile(pattern).findall
        self.words = _Kept(lambda word: np.array(merge_bytes(word.encode("utf-8", "surrogatepass"), self.ranks), "<i4").tobytes())
        self.stretches = _Kept(lambda part: b"".join(map(self.words.__getitem__, self.find(part))) if part else b"")

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        parts = [first]
        for part in rest:
            if part and not part[0].isspace():
                parts.append(" " + part)
            else:  # blanks that white space follows stay with what is before them
                parts[-1] += " " + part
        return b"".join(map(self.stretches.__getitem__, parts))


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: Broadcast) -> Encoder:
    content = vocabulary.value
    key = hashlib.sha256(content).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(content)
    return _encoders[key]


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabularies of this machine are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast:
    """Broadcast a vocabulary file; its size is fixed (under 2 MB) and checked."""
    with open(path or vocabulary_path(), "rb") as f:
        content = f.read()
    if len(content) > 16 << 20:
        raise ValueError("a vocabulary of over 16 MB is not broadcast")
    return spark.sparkContext.broadcast(content)


def token_ids(text: Column, vocabulary: Broadcast) -> Column:
    """List of ids per text, without special tokens; empty for null and empty texts."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            parts = [encoder.encode(t) for t in batch.to_pylist()]
            offsets = np.zeros(len(parts) + 1, "int32")
            np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))

    return ids(text)


def token_count(text: Column, vocabulary: Broadcast) -> Column:
    """Number of ids per text; 0 for null and empty texts."""

    @F.arrow_udf("int")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            yield pa.array([len(encoder.encode(t)) // 4 for t in batch.to_pylist()], pa.int32())

    return count.asNondeterministic()(text)  # evaluated once, also where a filter uses it
