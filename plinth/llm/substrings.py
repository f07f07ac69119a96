"""Substring dedup by level-wise doubling.

Windows that are repeated at one length alone are extended to about twice that length, until the wanted length is reached
or no candidate survives: 4, 7 and 13 words (``levels``), and 26, 52 ... in ``repeated_spans``. Below the wanted length not
all runs are counted but one for each window, chosen from the top down: in a window its run of 7 words with the smallest
hash, in that its smallest run of 4. Equal windows choose equal runs, so none is missed, and a quarter of the runs travels.
At each level only runs that occur in two different texts go on, and only texts that still have one are read again.

Texts of equal words are one class first, by partial aggregation: only the class's first document has windows, and in the
others every window starts in a smaller document. Window hashes of the last level have 64 bits and are compared in full;
below it 32 bits and the bucket stand for them, which can only add candidates.

A word is removed if a window of ``window`` words that covers it also starts in a document with a smaller id; windows are
judged on the input. Defined results: a null text has no words; documents shorter than a window lose nothing; rows
without an id take no part and keep their words; rows that repeat an id are one document, so they don't remove one
another's words; an empty table gives an empty result. Columns named like results, and the
five ``repeats_`` columns that joins use, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import exchange
from plinth.llm.exchange import Packer, deal, groups, unpack
from plinth.llm.jaccard import SCAN, _blobs, _by_record, _documents, _hashes, _texts, first_of_each, open_entries
from plinth.llm.sift import maybe_among, parted, small
from plinth.llm.words import PLACES, WordHashes, fingerprint, mix, runs
from plinth.runtime import bound_batches, discard, materialise

WINDOW = 13
#: Words of the first level at most.
SHORTEST = 4


def levels(window: int) -> list[int]:
    """Lengths of at most twice the one before, from ``SHORTEST`` words or fewer up to the window's."""
    out = [window]
    while len(out) < 2 or out[0] > SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def spans(x: np.ndarray, span: int, best: np.ufunc) -> np.ndarray:
    """The minimum or maximum of each ``span`` numbers in a row, by spans that double."""
    if len(x) < span:
        return x[:0]
    done = 1
    while done < span:
        step = min(done, span - done)
        x, done = best(x[: len(x) - step], x[step:]), done + step
    return x


def ladder(h: np.ndarray, lengths: list[int]) -> list[np.ndarray]:
    """The hashes of all runs of each length, each from two overlapping runs of the length before."""
    out = [runs(h, lengths[0])]
    for short, long in pairwise(lengths):
        r, n = out[-1], max(len(h) - long + 1, 0)
        out.append(mix(r[:n] * PLACES[0] + r[long - short :][:n] * PLACES[1] + np.uint64(long)))
    return out


def chosen(steps: list[np.ndarray], lengths: list[int], inside: np.ndarray, level: int) -> np.ndarray:
    """Places of the runs of lengths[level] that windows choose; inside: which windows there are. A run is chosen if it is as
    small as the least of a window around it; equal runs are chosen alike."""
    mask = inside
    for lower in range(len(lengths) - 2, level - 1, -1):
        if not mask.any():
            return np.empty(0, np.int64)
        span = lengths[lower + 1] - lengths[lower] + 1
        least = np.where(mask, spans(steps[lower], span, np.minimum), np.uint64(0))
        edge = np.zeros(span - 1, np.uint64)
        mask = spans(np.concatenate([edge, least, edge]), span, np.maximum) == steps[lower]
    return np.flatnonzero(mask)


class Words:
    """The words of a batch's texts as one array of hashes."""

    def __init__(self, texts: list[bytes | None], hashes: WordHashes) -> None:
        words = [(text or b"").split() for text in texts]
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.h = hashes.of(list(chain.from_iterable(words)))
        self.owner = np.repeat(np.arange(len(words)), self.sizes)
        self.prints = [fingerprint(self.h[a:b]) for a, b in zip(self.starts, self.ends, strict=True)]

    def inside(self, length: int, wanted: np.ndarray) -> np.ndarray:
        """For each place whether a wanted text has a run of that length there."""
        owner = self.owner[: max(len(self.h) - length + 1, 0)]
        return (np.arange(len(owner)) + length <= self.ends[owner]) & wanted[owner]

    def are(self, records: np.ndarray) -> np.ndarray:
        return np.array([p[1] for p in self.prints], np.int64) == records


def by_text(found: list[bytes]) -> np.ndarray:
    """Sorted 32-bit numbers of each text -> one sorted array, with the text's place in the batch above them."""
    data = [np.frombuffer(x, np.uint32) for x in found]
    text = np.repeat(np.arange(len(data), dtype=np.uint64), [len(x) for x in data])
    return (text << np.uint64(32)) | (np.concatenate(data) if data else np.empty(0, np.uint32))


def among_sorted(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _of_text(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    return (owner.astype(np.uint64) << np.uint64(32)) | values.astype(np.uint32)


def scan(rows: DataFrame, n: int, window: int) -> DataFrame:
    """(id, text, key) -> in one pass, a row for each document and blobs of (hash of a first-level run, fingerprint of the words)."""
    lengths = levels(window)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, packer = _hashes(), Packer(n, settle=_settle_anchors)
        for batch in batches:
            ids, words = batch.column(0), Words(_texts(batch, 1), hashes)
            steps, inside = ladder(words.h, lengths), words.inside(window, ids.is_valid().to_numpy(zero_copy_only=False))
            at = chosen(steps, lengths, inside, 1)
            first = spans(steps[0], lengths[1] - lengths[0] + 1, np.minimum)[at]
            record = np.array([p[1] for p in words.prints], np.int64)[words.owner[at]]
            for blobs in packer.add(first, first.astype(np.uint32), record):
                yield _blobs(blobs).append_column("key", pa.nulls(blobs.num_rows, pa.int64()))
            yield _documents(ids, words.sizes.tolist(), words.prints).append_column("key", batch.column(2))
        for blobs in packer.flush():
            yield _blobs(blobs).append_column("key", pa.nulls(blobs.num_rows, pa.int64()))

    return rows.select("id", "text", "key").mapInArrow(read, SCAN + ", key long")


def extended(rows: DataFrame, n: int, window: int, length: int) -> DataFrame:
    """(id, text, print, found) -> blobs as scan's, of the chosen runs of ``length`` words, those alone whose own chosen run of the
    level below is among found."""
    lengths = levels(window)
    level = lengths.index(length)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, packer = _hashes(), Packer(n, settle=_settle_anchors)
        for batch in batches:
            words, record = Words(_texts(batch, 0), hashes), batch.column(1).to_numpy()
            steps = ladder(words.h, lengths)
            at = chosen(steps, lengths, words.inside(window, words.are(record)), level)
            below = spans(steps[level - 1], length - lengths[level - 1] + 1, np.minimum)[at]
            at = at[among_sorted(_of_text(words.owner[at], below), by_text(batch.column(2).to_pylist()))]
            keys = steps[level][at]
            yield from packer.add(keys, keys.astype(np.uint32), record[words.owner[at]])
        yield from packer.flush()

    return rows.select("text", "print", "found").mapInArrow(emit, exchange.schema(3))


def shared_anchors(blobs: DataFrame, n: int) -> DataFrame:
    """(print, found): for each text the sorted 32-bit anchors that another text has too."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ones: list[pa.RecordBatch] = []
        yield from exchange.set_aside(batches, 2, open_ones)
        anchor, record = open_entries(open_ones)
        packer = Packer(n)
        yield from packer.add(_by_record(record), record, anchor)
        yield from packer.flush()

    return gathered(deal(blobs, n).mapInArrow(meet, exchange.schema(2)), n)


def _settle_anchors(buckets: np.ndarray, anchor: np.ndarray, record: np.ndarray) -> tuple[tuple, tuple]:
    travel, (record, anchor) = first_of_each(buckets, anchor, record)
    return travel, (_by_record(record), record, anchor)


def _settle_windows(buckets: np.ndarray, key: np.ndarray, place: np.ndarray, one: np.ndarray, record: np.ndarray) -> tuple[tuple, tuple]:
    """Within one task: of each window only the smallest document travels. The others have lost it already."""
    order = np.lexsort((one, key))
    buckets, key, place, one, record = (x[order] for x in (buckets, key, place, one, record))
    starts, ends = groups(key)
    lost = one > np.repeat(one[starts], ends - starts)
    stays = ~lost
    return tuple(x[stays] for x in (buckets, key, place, one, record)), (_by_record(record[lost]), record[lost], place[lost])


def gathered(blobs: DataFrame, n: int) -> DataFrame:
    """Blobs of (record, number) -> (print, found): each record's numbers, sorted, as one array of 32-bit numbers."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, value = unpack(batches, np.int64, np.uint32)
        order = np.lexsort((value, record))
        record, value = record[order], value[order]
        starts, ends = groups(record)
        data = pa.array([value[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(record[starts]), data], ["print", "found"])

    return deal(blobs, n).mapInArrow(gather, "print long, found binary")


def windows(rows: DataFrame, n: int, length: int, first: bool, smaller: bool) -> DataFrame:
    """(id, text, print, found) -> blobs of the candidate windows of that length: hash, place, id, print. first: found holds runs
    that the windows choose; else it holds the places where windows of the length below are repeated. smaller: as for repeated()."""
    lengths = levels(length)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, packer = _hashes(), Packer(n, settle=_settle_windows if smaller else None)
        for batch in batches:
            ids, record, words = batch.column(0).to_numpy(), batch.column(2).to_numpy(), Words(_texts(batch, 1), hashes)
            steps, known, wanted = ladder(words.h, lengths), by_text(batch.column(3).to_pylist()), words.are(record)
            if first:
                inside = words.inside(length, wanted)
                least = spans(steps[-2], length - lengths[-2] + 1, np.minimum)
                at = np.flatnonzero(inside & among_sorted(_of_text(words.owner[: len(least)], least), known))
            else:
                known = known[wanted[known >> np.uint64(32)]]
                both = known[among_sorted(known + np.uint64(length - lengths[-2]), known)]
                at = words.starts[both >> np.uint64(32)] + (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
            owner = words.owner[at]
            keys, place = steps[-1][at], (at - words.starts[owner]).astype(np.uint32)
            yield from packer.add(keys, keys, place, ids[owner], record[owner])
        yield from packer.flush()

    return rows.select("id", "text", "print", "found").mapInArrow(emit, exchange.schema(4))


def repeated(blobs: DataFrame, n: int, smaller: bool) -> DataFrame:
    """(print, found): the places where a text's windows occur in another text; smaller: in a document with a smaller id."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ones: list[pa.RecordBatch] = []
        yield from exchange.set_aside(batches, 2, open_ones)
        key, place, one, record = unpack(iter(open_ones), np.uint64, np.uint32, np.int64, np.int64)
        order = np.lexsort((one, key))
        key, place, one, record = key[order], place[order], one[order], record[order]
        starts, ends = groups(key)
        length = ends - starts
        least = np.repeat(one[starts], length) if len(starts) else one
        if smaller:
            chosen = one > least
        else:
            first = np.repeat(record[starts], length) if len(starts) else record
            differs = np.logical_or.reduceat(record != first, starts) if len(starts) else np.empty(0, bool)
            chosen = np.repeat(differs, length)
        packer = Packer(n)
        yield from packer.add(_by_record(record[chosen]), record[chosen], place[chosen])
        yield from packer.flush()

    return gathered(deal(blobs, n).mapInArrow(meet, exchange.schema(2)), n)


def keep_words(window: int) -> object:
    """(text, found, whole) -> kept text and counts. found: where removed windows start; whole: all words of a long enough text go."""

    @F.arrow_udf("struct<kept string, n_words long, n_removed long>")
    def keep(texts: pa.Array, found: pa.Array, whole: pa.Array) -> pa.Array:
        kept, sizes, removed = [], [], []
        for text, data, all_of_it in zip(texts.cast(pa.binary()), found, whole, strict=True):
            words = (text.as_py() or b"").split()
            stay = np.ones(len(words), bool)
            if all_of_it.as_py() and len(words) >= window:
                stay[:] = False
            elif data.is_valid:
                step = np.zeros(len(words) + 1, np.int64)
                at = np.frombuffer(data.as_py(), np.uint32).astype(np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + window, -1)
                stay = np.cumsum(step[:-1]) == 0
            kept.append(b" ".join(words if stay.all() else [w for w, s in zip(words, stay.tolist(), strict=True) if s]).decode())
            sizes.append(len(words))
            removed.append(int(len(words) - stay.sum()))
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], ["kept", "n_words", "n_removed"])

    return keep


def lower_levels(rows: DataFrame, n: int, window: int) -> tuple[DataFrame, DataFrame]:
    """rows: (id, text, key). Returns firsts (id, key, print, found): one document for each class of equal words that shares a run
    of each level below the window with another class; and copies (id, key): documents with the words of a smaller one."""
    if window < 2:
        raise ValueError("a window has 2 words at least")
    seen = materialise(scan(rows, n, window), "anchors")
    documents = seen.where("bucket is null and id is not null").select("id", "key", "print", "high")
    classes = documents.groupBy("print", "high").agg(F.min(F.struct("id", "key")).alias("first"), F.max("id").alias("last"))
    found = shared_anchors(seen.where("bucket is not null").select("bucket", "c0", "c1", "c2"), n)
    firsts = materialise(found.join(classes, "print").select("first.id", "first.key", "print", "found"), "firsts")
    repeats = materialise(classes.where("last > first.id").select("print", "high", F.col("first.id").alias("least")), "repeats")
    copies = documents.join(small(repeats, repeats.count()), ["print", "high"]).where("id > least").select("id", "key").distinct()
    copies = materialise(copies, "copies")
    discard(seen, repeats)
    for length in levels(window)[1:-1]:
        longer = shared_anchors(extended(candidates(rows, firsts), n, window, length), n)
        below, firsts = firsts, materialise(firsts.drop("found").join(longer, "print"), "firsts")
        discard(below)
    return firsts, copies


def candidates(rows: DataFrame, level: DataFrame) -> DataFrame:
    """The texts that a level goes on with."""
    return maybe_among(rows, level, "id").join(level, ["id", "key"])


def texts_of(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """key tells different texts of one id apart."""
    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("key"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, longest: int | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, length, found): for the first document of each class of equal texts, at each level from ``window`` doubling up to
    ``longest`` (by default until no window survives), the starts of its windows that another text repeats, as 32-bit numbers."""
    bound_batches(docs.sparkSession)
    rows, n = texts_of(docs, id_column, text), exchange.n_buckets(docs)
    firsts, _ = lower_levels(rows, n, window)
    length, level, levels = window, firsts, []
    while True:
        found = repeated(windows(candidates(rows, level), n, length, first=length == window, smaller=False), n, smaller=False)
        level = materialise(firsts.drop("found").join(found, "print"), "level")
        if level.isEmpty():
            break
        levels.append(level.select("id", F.lit(length).alias("length"), "found"))
        length *= 2
        if longest and length > longest:
            break
    out = firsts.where("false").select("id", F.lit(0).alias("length"), "found")
    for one in levels:
        out = out.union(one)
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with ``kept`` (the words that stay, joined by single spaces), ``n_words`` and ``n_removed``. Levels above ``window``
    would add nothing: every longer repeat is covered by its windows of that length."""
    docs = docs.drop("kept", "n_words", "n_removed")
    bound_batches(docs.sparkSession)
    rows, n = texts_of(docs, id_column, text), exchange.n_buckets(docs)
    firsts, copies = lower_levels(rows, n, window)
    removed = repeated(windows(candidates(rows, firsts), n, window, first=True, smaller=True), n, smaller=True)
    marks = removed.join(firsts.drop("found"), "print").select("id", "key", "found", F.lit(False).alias("whole"))
    marks = materialise(marks.unionByName(copies.select("id", "key", F.lit(None).cast("binary").alias("found"), F.lit(True).alias("whole"))), "marks")
    discard(firsts, copies)
    marks = marks.select(F.col("id").alias("repeats_id"), F.col("key").alias("repeats_key"), F.col("found").alias("repeats_found"), F.col("whole").alias("repeats_whole"))
    keyed = docs.withColumns({"repeats_id": F.col(id_column).cast("long"), "repeats_key": F.xxhash64(F.col(text).cast("string"))})
    # Texts that surely keep all their words don't travel.
    marked, whole = parted(keyed, marks, "repeats_id")
    joined = marked.join(marks, ["repeats_id", "repeats_key"], "left")
    joined = joined.unionByName(whole.withColumns({"repeats_found": F.lit(None).cast("binary"), "repeats_whole": F.lit(None).cast("boolean")}))
    out = keep_words(window)(F.col(text).cast("string"), F.col("repeats_found"), F.coalesce("repeats_whole", F.lit(False)))
    joined = joined.withColumn("repeats_out", out)
    return joined.withColumns({k: F.col(f"repeats_out.{k}") for k in ("kept", "n_words", "n_removed")}).drop("repeats_id", "repeats_key", "repeats_found", "repeats_whole", "repeats_out")
