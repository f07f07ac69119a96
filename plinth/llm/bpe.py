"""BPE encoding and decoding with a byte-level vocabulary.

Each pretoken ("short word") holds its parts and, beside them, a contiguous array of the ranks of adjacent pairs. The
smallest rank is looked for again and again; its boundary is deleted and the two neighbouring ranks are refreshed.
Pretokens of over ``LONG_WORD`` bytes, where scanning would cost the square of the length, use a heap over a linked list
with the same order of merges (lowest rank, leftmost first).

Defined results: a null text encodes to an empty array; a null id array decodes to the empty string; ids that the
vocabulary doesn't have are skipped; bytes that are no UTF-8 decode to U+FFFD, as the tokenizers library does. Rows are
independent of one another, so repeated rows and clashing column names change nothing.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from hashlib import sha256
from itertools import repeat

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plinth.runtime import bound_batches, worker_cache

#: Fixed value: the pretoken pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 256
#: Words that a worker keeps the ids of; beyond it the cache starts anew. It only bounds memory.
CACHED_WORDS = 200_000
NO_RANK = 1 << 40


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    printable = {b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary of the tokenizers library's JSON kind."""

    def __init__(self, data: bytes) -> None:
        spec = json.loads(data)
        ids = spec["model"]["vocab"]
        chars = byte_chars()
        back = {c: b for b, c in chars.items()}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in ids.items()}
        self.byte_ids = [ids[chars[b]] for b in range(256)]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[ids[left] << 32 | ids[right]] = rank
            self.merged.append(ids[left + right])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN).findall
        self.known = _Words(self)

    def merge(self, word: bytes) -> list[int]:
        if len(word) > LONG_WORD:
            return self._merge_long(word)
        get, merged = self.ranks.get, self.merged
        parts = [self.byte_ids[b] for b in word]
        near = [get(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while near:
            least = min(near)
            if least == NO_RANK:
                break
            i = near.index(least)
            parts[i] = merged[least]
            del parts[i + 1], near[i]
            if i:
                near[i - 1] = get(parts[i - 1] << 32 | parts[i], NO_RANK)
            if i < len(near):
                near[i] = get(parts[i] << 32 | parts[i + 1], NO_RANK)
        return parts

    def _merge_long(self, word: bytes) -> list[int]:
        get, merged = self.ranks.get, self.merged
        parts: list[int | None] = [self.byte_ids[b] for b in word]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i, left, right = heapq.heappop(queue)
            j = after[i] if parts[i] == left else n
            if j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = merged[rank], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := get(parts[a] << 32 | parts[b])) is not None:
                    heapq.heappush(queue, (r, a, parts[a], parts[b]))
        return [p for p in parts if p is not None]

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, as native 32-bit integers one after another."""
        if not text:
            return b""
        ids = self.known.__getitem__
        if self.cut is None or not any(map(text.__contains__, self.special)):
            return b"".join(map(ids, self.words(text)))
        out = []
        for piece in self.cut.split(text):
            out += [array("i", [self.special[piece]]).tobytes()] if piece in self.special else map(ids, self.words(piece))
        return b"".join(out)

    def decode(self, ids: list[int] | None) -> str:
        return b"".join(map(self.bytes_of.get, ids or (), repeat(b""))).decode("utf-8", "replace")


class _Words(dict):
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.vocabulary.merge(word.encode())).tobytes()
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = ids
        return ids


class BpeCodec:
    """encode() and decode() as columns. The vocabulary file (a few MB at most, whatever the data) is read by the driver
    and broadcast; ``path`` is a parameter."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        bound_batches(spark)
        with open(path, "rb") as f:
            data = f.read()
        shared, name = spark.sparkContext.broadcast(data), sha256(data).hexdigest()

        def vocabulary() -> Vocabulary:
            return worker_cache(("bpe", name), lambda: Vocabulary(shared.value))

        @F.arrow_udf("array<int>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            v = vocabulary()
            for texts in batches:
                runs = [v.encode(t.as_py()) for t in texts]
                ends = pa.array(_running(runs), pa.int32())
                ids = pa.Array.from_buffers(pa.int32(), ends[-1].as_py(), [None, pa.py_buffer(b"".join(runs))])
                yield pa.ListArray.from_arrays(ends, ids)

        @F.arrow_udf("string")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            v = vocabulary()
            for rows in batches:
                # Row by row: a whole batch as Python integers would take ten times the memory of its arrays.
                ends, ids = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
                yield pa.array((v.decode(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)), pa.string(), size=len(rows))

        self._encode, self._decode = encode, decode

    def encode(self, text: Column) -> Column:
        return self._encode(text.cast("string"))

    def decode(self, ids: Column) -> Column:
        return self._decode(ids)


def _running(runs: list[bytes]) -> array:
    ends = array("i", [0])
    for run in runs:
        ends.append(ends[-1] + len(run) // 4)
    return ends
