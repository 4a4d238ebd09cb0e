"""Byte-level BPE of whole texts with a public rank file, merges found by a segment tree.

A piece of text (as the pattern of the vocabulary cuts them) starts as its bytes. The leaves of a
segment tree hold the rank of each adjacent pair, so the root names the leftmost pair of lowest
rank; a merge changes at most three leaves, each in logarithmic time, until no pair is mergeable.
Pieces of any length thus cost n log n. Pieces seen before in a task are looked up.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary, and the pattern that cuts text before merging (fixed value of the vocabulary).
RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces a task remembers (whole pieces up to 64 bytes only, so at most some 100 MB).
REMEMBERED = 500_000


def read_ranks(path: str = RANK_FILE) -> bytes:
    """The rank file; its size, and so that of what is sent to the executors, is that of a vocabulary."""
    with open(path, "rb") as file:
        return file.read()


class Encoder:
    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.pattern = regex.compile(pattern)
        self.seen: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        n, get = len(piece), self.ranks.get
        if n < 2:
            return [self.ranks[piece]] if n else []
        part = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << (n - 1).bit_length()
        none = 1 << 62
        # a leaf is rank * 2**32 + position: the least is the leftmost of lowest rank
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                tree[size + i] = r << 32 | i
        for i in range(size - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left < right else right

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                left, right = tree[2 * i], tree[2 * i + 1]
                least = left if left < right else right
                if tree[i] == least:
                    return
                tree[i] = least

        while (top := tree[1]) != none:
            i = top & 0xFFFFFFFF
            j = after[i]
            part[i] += part[j]
            part[j] = b""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = get(part[i] + part[k])
                put(i, none if r is None else r << 32 | i)
            else:
                put(i, none)
            put(j, none)
            h = before[i]
            if h >= 0:
                r = get(part[h] + part[i])
                put(h, none if r is None else r << 32 | h)
        return [self.ranks[p] for p in part if p]

    def piece(self, text: str) -> list[int]:
        ids = self.seen.get(text)
        if ids is None:
            ids = self.merge(text.encode("utf-8", "surrogatepass"))
            if len(text) <= 64:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[text] = ids
        return ids

    def pieces(self, text: str) -> Iterator[tuple[int, list[int]]]:
        """Start and ids of each piece."""
        for m in self.pattern.finditer(text):
            yield m.start(), self.piece(m.group())

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        seen, more = self.seen, out.extend
        for piece in self.pattern.findall(text):
            ids = seen.get(piece)
            more(self.piece(piece) if ids is None else ids)
        return out


_encoders: dict[tuple[bytes, str], Encoder] = {}


def encoder(ranks: bytes, pattern: str) -> Encoder:
    """One encoder for a worker process and vocabulary."""
    key = hashlib.sha256(ranks).digest(), pattern
    if key not in _encoders:
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def _encode(batches, ranks, pattern):
    enc = encoder(ranks.value, pattern)
    for batch in batches:
        counts, flat = [0], []
        for text in batch.column("text").to_pylist():
            if text:
                flat.extend(enc.encode(text))
            counts.append(len(flat))
        ids = pa.ListArray.from_arrays(pa.array(np.array(counts, np.int32)), pa.array(np.array(flat, np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", rank_file: str = RANK_FILE, pattern: str = PATTERN) -> DataFrame:
    """``(doc_id, ids)``, one row for each row of ``documents``: the token ids of its text.

    An empty or null text gives an empty list; strings that look like special tokens are ordinary
    text; a null key stays null. Only the two columns are read, there is no shuffle, and order and
    repetition of rows do not matter.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: _encode(it, ranks, pattern), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")
