"""Cross-tokenizer alignment by a postings cogroup.

Two tokenizers cut the same bytes. Offsets where tokens of both end cut a text into groups; each A token of a group is linked
with each B token of it. A pair's count is the number of documents that hold it linked, and a link is best if its pair's count
is the highest that its A id has in the corpus.

Each document gives its distinct pairs with their multiplicities (postings), and a *block* of documents packs them, sorted by
(A id, B id), into a table in the shared folder, so that a block's documents keep their places whatever is run again. Postings
are then shuffled by side id, that of A: ids are gathered into groups of a bounded number of postings, a task's groups arrive
as a stream that Spark has sorted (and spilled where it must), and of each group counts and maxima are computed at one go. The
group emits its contributions to each document, which are summed by block.

Scale: an id with more postings than a group may hold is split by document over several groups. Its pairs' counts then come
from partial counts, pre-aggregated by block and by task, which are sent to each of its groups beside the postings (the
cogroup's other side). A task holds a group's postings or a block's documents, never those of an id. Which group an id belongs
to is told by a table with a row for each id of A's vocabulary: that bounds what the driver and broadcasts hold.

Defined results: null and empty texts, and texts whose bytes a tokenizer doesn't give back, have no tokens: zeros and an empty
digest. Rows are documents of their own, also where ids or texts repeat or the id is null; ids of any type. Only the id's and
the text's columns are read. An empty table gives no rows. Very long texts are aligned whole; within a group of many tokens
(where no offsets meet for long) only distinct pairs are held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.bpe import PATTERN, Vocabulary
from plinth.llm.exchange import groups, n_buckets
from plinth.runtime import bound_batches, materialise, release, worker_cache

#: Postings and documents of a block at most (but for one document more), and postings of a side group.
BLOCK_POSTINGS, BLOCK_DOCS, GROUP_POSTINGS = 1_000_000, 20_000, 2_000_000
#: Token pairs of one group of a text that are listed before they are counted.
LISTED_PAIRS = 1 << 16
#: Texts are encoded so many characters at a time.
ENCODED_CHARS = 1 << 20


class Side(NamedTuple):
    """encode: texts to lists of ids. pieces: the bytes of each id."""

    encode: object
    pieces: list[bytes]


def byte_level(data: bytes) -> Side:
    """A byte-level BPE vocabulary of the tokenizers library's JSON kind; special tokens' strings are plain text."""
    v = Vocabulary(data)
    pieces = [v.bytes_of.get(i, b"") for i in range(max(v.bytes_of) + 1)]
    ranks = {v.bytes_of[i]: i for i in v.byte_ids + v.merged}
    if v.merged == sorted(v.merged) and max(v.byte_ids) < min(v.merged, default=1 << 62):
        library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return Side(lambda texts: [library.encode_ordinary(t) for t in texts], pieces)
    v.cut = None  # ids that don't follow the merges' order
    return Side(lambda texts: [np.frombuffer(v.encode(t), np.int32).tolist() for t in texts], pieces)


def sentence_pieces(data: bytes) -> Side:
    """A sentencepiece model, which puts a space before each text itself."""
    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    pieces = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(len(model))]
    return Side(lambda texts: model.encode(texts, num_threads=1), pieces)


class Aligner:
    def __init__(self, a: bytes, b: bytes) -> None:
        self.a, self.b = byte_level(a), sentence_pieces(b)
        self.sizes = [np.array([len(x) for x in s.pieces], np.int64) for s in (self.a, self.b)]
        names = [np.array([str(i) for i in range(len(s.pieces))], np.bytes_) for s in (self.a, self.b)]
        self.names = [{mark: np.char.add(n, mark) for mark in marks} for n, marks in zip(names, ((b",", b"|"), (b",", b";")), strict=True)]

    def align(self, text: str, a: list[int], b: list[int]) -> tuple | None:
        """(groups, links, digest, pair codes, multiplicities) of the ids of " " + text by A and of text by B."""
        whole = (" " + text).encode()
        if any(b"".join(map(s.pieces.__getitem__, ids)) != whole for s, ids in ((self.a, a), (self.b, b))):
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends = [np.cumsum(size[ids]) for size, ids in zip(self.sizes, (a, b), strict=True)]
        seen = np.zeros(len(whole) + 1, bool)
        seen[ends[0]] = True
        both = ends[1][seen[ends[1]]]
        of_a, of_b = (np.searchsorted(both, e) for e in ends)
        n_a, n_b = np.bincount(of_a, minlength=len(both)), np.bincount(of_b, minlength=len(both))
        codes, times = self._pairs(a, b, of_a, n_a, n_b)
        return len(both), int((n_a * n_b).sum()), self._digest(a, b, of_a, of_b, n_a, n_b), codes, times

    def _digest(self, a, b, of_a, of_b, n_a, n_b) -> str:
        until_a, until_b = np.cumsum(n_a), np.cumsum(n_b)
        own_a, own_b = np.arange(len(a)), np.arange(len(b))
        out = np.empty(len(a) + len(b), np.result_type(self.names[0][b","], self.names[1][b","]))
        for side, ids, own, of, until, before in ((0, a, own_a, of_a, until_a, until_b - n_b), (1, b, own_b, of_b, until_b, until_a)):
            last, marks = own + 1 == until[of], self.names[side]
            out[own + before[of]] = np.where(last, marks[b"|;"[side : side + 1]][ids], marks[b","][ids])
        return hashlib.sha256(out.tobytes().translate(None, b"\0")[:-1]).hexdigest()

    @staticmethod
    def _pairs(a, b, of_a, n_a, n_b) -> tuple[np.ndarray, np.ndarray]:
        large = n_a * n_b > LISTED_PAIRS
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        each = np.where(large[of_a], 0, n_b[of_a])
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first_b[of_a], each)
        codes, times = np.unique(np.repeat(a, each) << 32 | b[at], return_counts=True)
        if not large.any():
            return codes, times
        found = [(codes, times)]
        for g in np.flatnonzero(large):
            x, n = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
            y, m = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
            found.append(((x[:, None] << 32 | y[None, :]).ravel(), (n[:, None] * m[None, :]).ravel()))
        codes, times = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(codes, kind="stable")
        starts, _ = groups(codes[order])
        return codes[order][starts], np.add.reduceat(times[order], starts)


# -- packed arrays ----------------------------------------------------------------------------------------------------------------


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs, which the first byte tells."""
    kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"u{blob[0]}", offset=1).astype(np.int64)


BLOCK = "block long, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, side binary, side_n binary, a binary, b binary, doc binary, times binary"


class _Block:
    def __init__(self, number: int, kind: pa.DataType) -> None:
        self.number, self.kind, self.ids, self.base, self.pairs, self.postings = number, kind, [], [], [], 0

    def add(self, own_id, base: tuple, codes=None, times=None) -> bool:
        if codes is not None:
            self.pairs.append((codes, np.full(len(codes), len(self.ids)), times))
            self.postings += len(codes)
        self.ids.append(own_id)
        self.base.append(base)
        return self.postings >= BLOCK_POSTINGS or len(self.ids) >= BLOCK_DOCS

    def batch(self, names: list[str]) -> pa.RecordBatch:
        codes, docs, times = (np.concatenate(x) for x in zip(*self.pairs, strict=True)) if self.pairs else [np.empty(0, np.int64)] * 3
        order = np.argsort(codes, kind="stable")
        codes, docs, times = codes[order], docs[order], times[order]
        starts, ends = groups(codes >> 32)
        blobs = map(pack, (codes[starts] >> 32, ends - starts, codes >> 32, codes & 0xFFFFFFFF, docs, times))
        base = [pa.array([list(x)], pa.list_(pa.string() if i == 4 else pa.int64())) for i, x in enumerate(zip(*self.base, strict=True))]
        columns = [pa.array([self.ids], pa.list_(self.kind)), pa.array([self.number], pa.int64()), *base, *(pa.array([x], pa.binary()) for x in blobs)]
        return pa.RecordBatch.from_arrays(columns, names)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        ids, texts, chars = [], [], 0
        for own_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(own_id.as_py())
            texts.append(text.as_py() or "")
            chars += len(texts[-1])
            if chars >= ENCODED_CHARS:
                yield ids, texts
                ids, texts, chars = [], [], 0
        if ids:
            yield ids, texts


def blocks(docs: DataFrame, a: bytes, b: bytes, id_column: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    shared, name = spark.sparkContext.broadcast((a, b)), hashlib.sha256(a + b).hexdigest()
    schema = f"ids array<{docs.schema[id_column].dataType.simpleString()}>, {BLOCK}"
    names = [x.split()[0] for x in schema.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner: Aligner = worker_cache(("align", name), lambda: Aligner(*shared.value))
        kinds: list[pa.DataType] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds[:] = [batch.schema.field(0).type]
                yield batch

        number, block = TaskContext.get().partitionId() << 32, None
        for ids, texts in _chunks(noted()):
            for own_id, t, x, y in zip(ids, texts, aligner.a.encode([" " + t for t in texts]), aligner.b.encode(texts), strict=True):
                block = block or _Block(number, kinds[0])
                found = aligner.align(t, x, y) if t else None
                if found:
                    n_groups, n_links, digest, codes, times = found
                    full = block.add(own_id, (len(x), len(y), n_groups, n_links, digest), codes, times)
                else:
                    full = block.add(own_id, (0, 0, 0, 0, ""))
                if full:
                    yield block.batch(names)
                    number, block = number + 1, None
        if block:
            yield block.batch(names)

    return docs.select(F.col(id_column), F.col(text)).mapInArrow(encode, schema)


# -- which group an id's postings go to -----------------------------------------------------------------------------------------


class Plan(NamedTuple):
    """By A id: its first group and the number of its groups; one for all but hot ids."""

    first: np.ndarray
    parts: np.ndarray
    n: int

    @classmethod
    def of(cls, sizes: np.ndarray, most: int) -> Plan:
        parts = np.maximum(1, -(-sizes // most))
        cold = np.where(parts == 1, sizes, 0)
        first = (np.cumsum(cold) - cold) // most
        begin = int(first.max()) + 1 if len(first) else 1
        hot = np.where(parts > 1, parts, 0)
        first = np.where(parts > 1, begin + np.cumsum(hot) - hot, first)
        return cls(first, parts, begin + int(hot.sum()))


def _sizes(table: DataFrame, n_ids: int) -> np.ndarray:
    """Postings of each A id: a row for each id, n_ids at most, reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            for side, n in zip(batch.column(0), batch.column(1), strict=True):
                total[unpack(side.as_py())] += unpack(n.as_py())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["a", "n"])

    found = table.select("side", "side_n").mapInArrow(count, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_ids, np.int64)
    out[found.column("a").to_numpy()] = found.column("n").to_numpy()
    return out


DEALT = "part int, side_group int, kind int, block long, a binary, b binary, doc binary, times binary"
_DEALT_NAMES = [x.split()[0] for x in DEALT.split(", ")]


def _dealt_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _DEALT_NAMES)


def postings(table: DataFrame, plan: Plan, n_parts: int) -> DataFrame:
    """Rows of DEALT: a block's postings for each side group, kind 1."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b, doc, times = (unpack(row[c]) for c in ("a", "b", "doc", "times"))
                if not len(a):
                    continue
                # A hot id's documents are dealt evenly, whichever blocks they are in.
                to = plan.first[a] + (doc + row["block"] * 7919 + (row["block"] >> 32) * 104_729) % plan.parts[a]
                order = np.argsort(to, kind="stable")
                a, b, doc, times, to = a[order], b[order], doc[order], times[order], to[order]
                starts, ends = groups(to)
                yield _dealt_rows([(int(to[s]) % n_parts, int(to[s]), 1, row["block"], pack(a[s:e]), pack(b[s:e]), pack(doc[s:e]), pack(times[s:e])) for s, e in zip(starts, ends, strict=True)])

    return table.select("block", "a", "b", "doc", "times").mapInArrow(deal, DEALT)


def hot_counts(table: DataFrame, plan: Plan, n_parts: int) -> DataFrame:
    """Rows of DEALT: the counts of the pairs of ids that have several groups, for each of these, kind 0."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                a, b = unpack(a.as_py()), unpack(b.as_py())
                hot = plan.parts[a] > 1
                a, b = a[hot], b[hot]
                starts, ends = groups(a, b)  # a pair has a posting for each document
                yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(ends - starts)], ["a", "b", "n"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = (c.to_numpy() for c in batch.columns)
            order = np.argsort(a, kind="stable")
            a, b, n = a[order], b[order], n[order]
            for s, e in zip(*groups(a), strict=True):
                first, blobs = int(plan.first[a[s]]), (pack(a[s:e]), pack(b[s:e]), None, pack(n[s:e]))
                yield _dealt_rows([(g % n_parts, g, 0, 0, *blobs) for g in range(first, first + int(plan.parts[a[s]]))])

    pairs = table.select("a", "b").mapInArrow(partial, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return pairs.mapInArrow(spread, DEALT)


GAINS = "block long, kind int, doc binary, best binary, total binary"


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Side groups one after another, each as a run of rows: counts, maxima and what each block's documents gain."""
    release()
    rows = (r for batch in batches for one in range(batch.num_rows) for r in batch.slice(one, 1).to_pylist())
    for _, own in groupby(rows, key=lambda r: r["side_group"]):
        known_b, known_n, blobs, cuts, ids = [], [], [], [0], []
        for r in own:
            if r["kind"] == 0:
                known_b.append(unpack(r["b"]))
                known_n.append(unpack(r["times"]))
            else:
                blobs.append((unpack(r["a"]) << 32 | unpack(r["b"]), unpack(r["times"])))
                ids.append((r["block"], unpack(r["doc"]).astype(np.uint32)))
                cuts.append(cuts[-1] + len(blobs[-1][0]))
        if not blobs:
            continue
        codes, times = (np.concatenate(x) for x in zip(*blobs, strict=True))
        blobs.clear()
        if known_b:  # one id's documents, of several groups
            b, n = np.concatenate(known_b), np.concatenate(known_n)
            order = np.argsort(b)
            count = n[order][np.searchsorted(b[order], codes & 0xFFFFFFFF)]
            best = count == n.max()
        else:
            order = np.argsort(codes, kind="stable")
            ordered = codes[order]
            starts, ends = groups(ordered)
            of_pair = ends - starts
            sides, side_ends = groups(ordered[starts] >> 32)
            most = np.repeat(np.maximum.reduceat(of_pair, sides), side_ends - sides)
            count, best = np.empty(len(codes), np.int64), np.empty(len(codes), bool)
            count[order] = np.repeat(of_pair, of_pair)
            best[order] = np.repeat(of_pair == most, of_pair)
        total, gained = times * count, times * best
        out = []
        for (block, doc), s, e in zip(ids, cuts[:-1], cuts[1:], strict=True):
            order = np.argsort(doc, kind="stable")
            starts, _ = groups(doc[order])
            out.append((block, 1, pack(doc[order][starts]), pack(np.add.reduceat(gained[s:e][order], starts)), pack(np.add.reduceat(total[s:e][order], starts))))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)], ["block", "kind", "doc", "best", "total"])


def align_tokenizers(docs: DataFrame, a: bytes, b: bytes, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """a, b: the files of a byte-level vocabulary and of a sentencepiece model. (id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256) for each row of docs."""
    spark: SparkSession = docs.sparkSession
    bound_batches(spark)
    n_parts = n_buckets(docs)
    table = materialise(blocks(docs, a, b, id_column, text), "aligned")
    sizes = _sizes(table, len(byte_level(a).pieces))
    plan = Plan.of(sizes, max(1, min(GROUP_POSTINGS, -(-int(sizes.sum()) // (2 * n_parts)))))
    dealt = postings(table, plan, n_parts)
    if (plan.parts > 1).any():
        dealt = dealt.unionByName(hot_counts(table, plan, n_parts))
    gains = dealt.repartitionById(n_parts, "part").sortWithinPartitions("side_group", "kind", "block").mapInArrow(settle, GAINS)
    base = table.select("block", F.lit(0).alias("kind"), "ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    both = base.unionByName(gains, allowMissingColumns=True).repartition(n_parts, "block").sortWithinPartitions("block", "kind")
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    names = [id_column, *(x.split()[0] for x in schema.split(", ")[1:])]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's documents, then what they gain, group by group."""
        release()
        base: list[pa.Array] = []
        best = total = np.empty(0, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if row.column("kind")[0].as_py() == 0:
                    if base:
                        yield pa.RecordBatch.from_arrays([*base[:5], pa.array(best), pa.array(total), base[5]], names)
                    base = [row.column(c).flatten() for c in ("ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
                    best, total = (np.zeros(len(base[0]), np.int64) for _ in range(2))
                else:
                    at = unpack(row.column("doc")[0].as_py())
                    best[at] += unpack(row.column("best")[0].as_py())
                    total[at] += unpack(row.column("total")[0].as_py())
        if base:
            yield pa.RecordBatch.from_arrays([*base[:5], pa.array(best), pa.array(total), base[5]], names)

    return both.mapInArrow(finish, schema)
