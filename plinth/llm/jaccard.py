"""N-gram Jaccard join by T-occurrence search (DivideSkip), giving each document the component of its links.

A document is the set of its distinct five-word shingles; two link when 100 * intersection >= 75 * union. Then each shares
at least T = ceil(0.75 n) of its n shingles with the other, so a document is searched for like this: of the inverted lists of
its shingles the longest, fewer than T, are skipped; the others are merged by a heap, which counts the documents in them; those
that could still reach the overlap that both sizes require are probed for in the skipped lists by binary search, and the ones
that reach it are links. Every link comes from ``Lists.search``; no list or document is dropped for its size. What stands around
it says which inverted lists a document has to be searched in:

1. Documents of equal sets fall into one class, by partial aggregation, before anything else.
2. Shingles are ordered by their hash, and by the usual argument two linked documents share at least q of the first n - T + q of
   them (q grows with n): only these are counted. A list of one class says nothing. A document that shares fewer than q of
   its shingles with others cannot link and leaves.
3. Rounds over those that are left, with longer prefixes: links found so far make components; a list within one component
   says nothing; whoever shares fewer than q shingles with other components leaves for good; the others are searched for in the
   inverted lists of their leaders, a document's leaders being the few of other components that it meets most as the first ones
   of its lists, in an order that each round draws anew. Groups of near copies collapse here with as many searches as documents.
4. Once a round finds hardly any link, whole sets: a document leaves if other components share fewer than T of its shingles. Of
   the distributed lists it reads all but the T - 1 longest and merges them by a heap; whoever could reach the overlap that the
   two sizes require, were it in all lists that weren't read, is a partner, and the document is searched for in the inverted
   lists of its partners. Of two components the smaller one's documents search. One link joins two components, so first
   passes take only the partners of each component that share most, and the last one all partners of what isn't joined yet.

Inverted lists are held by shard: a shard has the lists of the leaders or partners dealt to it, and the documents searched for
in them are dealt to it too, a leader of very many to several shards. Shingles are 64-bit hashes; where documents are only
counted 32 bits and the bucket stand for them, which can only add candidates.

Defined results: null and empty texts, and texts without words, have an empty set and link with nothing: their component is
their own id. Rows without an id get n_shingles and no component. Repeated rows get equal results; different texts of one
id count as one document. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm import exchange
from plinth.llm.components import connected_components
from plinth.llm.exchange import Packer, deal, groups, unpack
from plinth.llm.sift import among, small
from plinth.llm.words import WordHashes, fingerprint, mix, runs
from plinth.runtime import bound_batches, discard, materialise, worker_cache

WIDTH = 5
#: q in percent of n: in the lists of all documents, and in those of the few that are left then.
NARROW, WIDE = 10, 35
#: A round that finds fewer links than one for FEW of the documents left is the last before whole sets are compared.
FEW = 20
#: Partners that a document is searched for in each other component, by pass; the last pass leaves none out.
PASSES = (4, None)
#: Leaders that a document is searched for in a round.
LEADERS = 3
#: What a step of the heap costs beside a probe, as the choice of the lists to skip weighs them.
MERGE_COST = 0.0085
#: Bytes of sets whose inverted lists a shard holds, about.
SHARD_BYTES = 32 << 20


def shingle_set(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """The sorted hashes of a text's shingles. bytes.lower() and bytes.split() know ASCII only, as the definition does."""
    h = hashes.of(text.lower().split()) if text else np.empty(0, np.uint64)
    return np.unique(runs(h, min(WIDTH, len(h)))) if len(h) else h


def required(n: int) -> int:
    """Of n shingles, those that a linked document shares at least."""
    return -(-3 * n // 4)


def spare(n: int, percent: int) -> int:
    """q: the more, the longer the prefix and the fewer the documents that reach it by chance."""
    return max(1, n * percent // 100)


def prefix(tokens: np.ndarray, percent: int) -> np.ndarray:
    n = len(tokens)
    return tokens[: n - required(n) + spare(n, percent)]


class Lists:
    """The inverted lists of some documents: for each shingle the numbers of the documents that have it, rising."""

    def __init__(self, homes: list[int], sets: list[np.ndarray]) -> None:
        self.homes, self.sizes = homes, [len(s) for s in sets]
        tokens = np.concatenate([*sets, np.empty(0, np.uint64)])
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.owners = tokens[order], owners[order]
        self.starts, ends = groups(tokens)
        self.tokens, self.lengths = tokens[self.starts], ends - self.starts
        # (list, owner) as one rising number, so that one call probes several lists.
        self.places = np.repeat(np.arange(len(self.starts)) * len(sets), self.lengths) + self.owners

    def search(self, home: int, own: np.ndarray) -> list[int]:
        """The numbers of the documents of other homes that link with the set ``own``."""
        n, least = len(own), required(len(own))
        at = np.searchsorted(self.tokens, own)
        at = at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == own] if len(self.tokens) else at[:0]
        if len(at) < least:
            return []
        at = at[np.argsort(self.lengths[at], kind="stable")]
        skipped = min(least - 1, int(least / (MERGE_COST * math.log2(1 + self.lengths[at[-1]]) + 1)))
        short, long = at[: len(at) - skipped], at[len(at) - skipped :]
        merged = heapq.merge(*(self.owners[a : a + k].tolist() for a, k in zip(self.starts[short].tolist(), self.lengths[short].tolist(), strict=True)))
        found = []
        for one, hits in groupby(merged):
            size = self.sizes[one]
            wanted = -(-3 * (n + size) // 7)
            if self.homes[one] == home or 4 * min(n, size) < 3 * max(n, size):
                continue
            times = sum(1 for _ in hits)
            if times + skipped < wanted:
                continue
            probes = long * len(self.sizes) + one
            near = np.minimum(np.searchsorted(self.places, probes), len(self.places) - 1)
            if times + int((self.places[near] == probes).sum()) >= wanted:
                found.append(one)
        return found


def needed(percent: int) -> F.Column:
    """spare() of the smallest size that can link: the least number of shared prefix shingles."""
    return F.expr(f"greatest(1, ((3 * n + 3) div 4) * {percent} div 100)")


def _hashes() -> WordHashes:
    return worker_cache("word-hashes", WordHashes)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


SCAN = "id long, n long, high long, print long, hash long, bucket int, c0 binary, c1 binary, c2 binary"
SCANNED = [x.split()[0] for x in SCAN.split(", ")]


def scan(rows: DataFrame, n: int) -> DataFrame:
    """(id, text, hash) -> in one pass, a row for each document and blobs of (prefix shingle, set's fingerprint)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, packer = _hashes(), Packer(n, settle=_count_here)
        for batch in batches:
            ids, sizes, prints = batch.column(0), [], []
            for known, text in zip(ids.is_valid().to_pylist(), _texts(batch, 1), strict=True):
                tokens = shingle_set(text, hashes)
                sizes.append(len(tokens))
                prints.append(fingerprint(tokens) if len(tokens) else (None, None))
                if known and len(tokens):
                    first = prefix(tokens, NARROW)
                    for blobs in packer.add(first, first.astype(np.uint32), np.full(len(first), prints[-1][1], np.int64)):
                        yield _blobs(blobs)
            yield _documents(ids, sizes, prints, batch.column(2))
        for blobs in packer.flush():
            yield _blobs(blobs)

    return rows.mapInArrow(read, SCAN)


def _documents(ids: pa.Array, sizes: list[int], prints: list[tuple], hashes: pa.Array | None = None) -> pa.RecordBatch:
    high, low = (pa.array(x, pa.int64()) for x in (zip(*prints, strict=True) if prints else ((), ())))
    nothing = [pa.nulls(len(ids), k) for k in (pa.int32(), pa.binary(), pa.binary(), pa.binary())]
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(sizes, pa.int64()), high, low, pa.nulls(len(ids), pa.int64()) if hashes is None else hashes, *nothing], SCANNED)


def _blobs(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.nulls(batch.num_rows, pa.int64())] * 5, *batch.columns], SCANNED)


def first_of_each(buckets: np.ndarray, key: np.ndarray, record: np.ndarray) -> tuple[tuple, tuple]:
    """Within one task: of each key its first record travels, marked if the task has another one too. Settled: all (record, key) of
    marked keys, since they are known to be shared. Copies travel once."""
    order = np.lexsort((record, key, buckets))
    buckets, key, record = buckets[order], key[order], record[order]
    starts, _ = groups(buckets, key, record)
    buckets, key, record = buckets[starts], key[starts], record[starts]
    starts, ends = groups(buckets, key)
    marked = ends - starts > 1
    shared = np.repeat(marked, ends - starts)
    return (buckets[starts], key[starts], record[starts], marked), (record[shared], key[shared])


def _count_here(buckets: np.ndarray, key: np.ndarray, record: np.ndarray) -> tuple[tuple, tuple]:
    travel, (record, _) = first_of_each(buckets, key, record)
    record, times = np.unique(record, return_counts=True)
    return travel, (_by_record(record), record, times.astype(np.uint32))


def open_entries(open_ones: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Of (key, record, marked) entries the (key, record) that aren't settled yet and turn out to be shared."""
    key, record, marked = unpack(iter(open_ones), np.uint32, np.int64, np.bool_)
    order = np.lexsort((record, key))
    key, record, marked = key[order], record[order], marked[order]
    starts, ends = groups(key)
    if not len(starts):
        return key, record
    same = np.minimum.reduceat(record, starts) == np.maximum.reduceat(record, starts)
    shared = np.repeat(~same | np.logical_or.reduceat(marked, starts), ends - starts) & ~marked
    starts, _ = groups(key, record)  # a record that met its own copy in another task counts once
    once = np.zeros(len(key), bool)
    once[starts] = True
    return key[shared & once], record[shared & once]


def shared_counts(lists: DataFrame, n: int) -> DataFrame:
    """Blobs of scan() -> (record, shared): at least as many as the listed shingles that it shares with another record."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ones: list[pa.RecordBatch] = []
        yield from exchange.set_aside(batches, 2, open_ones)
        _, record = open_entries(open_ones)
        record, times = np.unique(record, return_counts=True)
        packer = Packer(n)
        yield from packer.add(_by_record(record), record, times.astype(np.uint32))
        yield from packer.flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, times = unpack(batches, np.int64, np.uint32)
        order = np.argsort(record, kind="stable")
        record, times = record[order], times[order].astype(np.int64)
        starts, _ = groups(record)
        shared = np.add.reduceat(times, starts) if len(starts) else times
        yield pa.RecordBatch.from_arrays([pa.array(record[starts]), pa.array(shared)], ["record", "shared"])

    return deal(deal(lists, n).mapInArrow(meet, exchange.schema(2)), n).mapInArrow(total, "record long, shared long")


def _by_record(keys: np.ndarray) -> np.ndarray:
    return mix(keys.view(np.uint64))


def stars(lists: DataFrame, n: int, turn: int) -> DataFrame:
    """Blobs of (shingle, record, component) -> (record, shared, others): of its listed shingles, how many it shares with a record of
    another component, and its leaders: of those that come first in their lists the ones that it meets most, short lists weighing
    more. Components come in another random order each turn, so that a leader that didn't link isn't met again and again."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, record, home = unpack(batches, np.uint32, np.int64, np.int64)
        order = np.lexsort((record, mix(home.view(np.uint64) ^ np.uint64(turn)), token))
        token, record, home = token[order], record[order], home[order]
        starts, ends = groups(token, record)
        token, record, home = token[starts], record[starts], home[starts]
        starts, ends = groups(token)
        length = ends - starts
        first = np.repeat(starts, length)
        # The first record of another component: that of the list's first component, or for its own members the next one's.
        foreign = home != home[first]
        place = np.arange(len(home))
        second = np.minimum.reduceat(np.where(foreign, place, len(home)), starts) if len(home) else place
        shared = np.repeat(second, length) < len(home)
        other = np.where(foreign, record[first], record[np.minimum(np.repeat(second, length), max(len(home) - 1, 0))]) if len(home) else record
        packer = Packer(n)
        yield from packer.add(_by_record(record[shared]), record[shared], other[shared], np.repeat(length, length)[shared].astype(np.uint32))
        yield from packer.flush()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, other, length = unpack(batches, np.int64, np.int64, np.uint32)
        order = np.lexsort((other, record))
        record, other, length = record[order], other[order], length[order]
        starts, ends = groups(record, other)
        weight = np.add.reduceat(1 / length, starts) if len(starts) else length
        times, record, other = ends - starts, record[starts], other[starts]
        order = np.lexsort((other, -weight, record))
        times, record, other = times[order], record[order], other[order]
        starts, ends = groups(record)
        shared = np.add.reduceat(times, starts) if len(starts) else times
        leads = np.arange(len(record)) - np.repeat(starts, ends - starts) < LEADERS
        others = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.minimum(ends - starts, LEADERS))]).astype(np.int32), pa.array(other[leads]))
        yield pa.RecordBatch.from_arrays([pa.array(record[starts]), pa.array(shared), others], ["record", "shared", "others"])

    met = deal(lists, n).mapInArrow(meet, exchange.schema(3))
    return deal(met, n).mapInArrow(choose, "record long, shared long, others array<long>")


def lists_of(sets: DataFrame, n: int) -> DataFrame:
    """(id, component, tokens) -> blobs of (prefix shingle, id, component)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(n)
        for batch in batches:
            for one, home, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                first = prefix(np.frombuffer(data, np.uint64), WIDE)
                yield from packer.add(first, first.astype(np.uint32), np.full(len(first), one, np.int64), np.full(len(first), home, np.int64))
        yield from packer.flush()

    return sets.select("id", "component", "tokens").mapInArrow(emit, exchange.schema(3))


def shared_lists(sets: DataFrame, n: int) -> DataFrame:
    """(id, n, component, tokens) -> (id, shared, chosen): how many of all its shingles another component has, and which lists the
    search has to read: all but the required count less one, the longest of them. Only records that share the required count."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(n)
        for batch in batches:
            for one, size, home, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                tokens = np.frombuffer(data, np.uint64)
                yield from packer.add(tokens, tokens, np.full(size, one, np.int64), np.full(size, home, np.int64), np.full(size, size, np.uint32))
        yield from packer.flush()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, record, home, size = unpack(batches, np.uint64, np.int64, np.int64, np.uint32)
        order = np.lexsort((record, home, token))
        token, record, home, size = token[order], record[order], home[order], size[order]
        starts, ends = groups(token, record)
        token, record, home, size = token[starts], record[starts], home[starts], size[starts]
        starts, ends = groups(token)
        long = ends - starts
        shared = np.repeat(home[starts] != home[ends - 1], long)
        packer = Packer(n)
        yield from packer.add(_by_record(record[shared]), record[shared], token[shared], np.repeat(long, long)[shared].astype(np.uint32), size[shared])
        yield from packer.flush()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, token, long, size = unpack(batches, np.int64, np.uint64, np.uint32, np.uint32)
        order = np.lexsort((token, long, record))
        record, token, size = record[order], token[order], size[order]
        out: list[tuple] = []
        for a, b in zip(*groups(record), strict=True):
            least = required(int(size[a]))
            if b - a >= least:
                out.append((int(record[a]), int(b - a), np.sort(token[a : b - least + 1]).tobytes()))
        columns = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["id", "shared", "chosen"])

    lists = sets.select("id", "n", "component", "tokens").mapInArrow(emit, exchange.schema(4))
    weighed = deal(lists, n).mapInArrow(weigh, exchange.schema(4))
    return deal(weighed, n).mapInArrow(choose, "id long, shared long, chosen binary")


#: What travels with a shingle: whose it is, and which partners can still link.
ENTRY = np.dtype([("token", "u8"), ("id", "i8"), ("home", "i8"), ("members", "i8"), ("n", "u4"), ("most", "u4"), ("reads", "?")])
#: A reader that met another record in one of its lists.
MET = np.dtype([("id", "i8"), ("token", "u8"), ("n", "u4"), ("other", "i8"), ("other_n", "u4"), ("home", "i8")])


def divide_skip(sets: DataFrame, n: int, best: int | None) -> DataFrame:
    """(id, n, component, members, tokens, shared, chosen) -> partners (id, other, more). A record reads its chosen short lists only; those
    that it skips are no more than the required count less one, so whoever links is in one that it reads. Of two components the
    smaller one's records read. Partners must have a size for which the required overlap is within what both share. The lists are
    merged by a heap; whoever could not reach the overlap with all skipped lists is no partner. best: of each component that many
    partners, the ones that share most; more says that others were left out."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(n, held=400_000)
        for batch in batches:
            for one, size, home, members, data, shared, chosen in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                tokens = np.frombuffer(data, np.uint64)
                rows = np.empty(size, ENTRY)
                rows["token"], rows["id"], rows["home"], rows["members"], rows["n"] = tokens, one, home, members, size
                rows["most"] = 7 * shared // 3 - size
                rows["reads"] = np.isin(tokens, np.frombuffer(chosen, np.uint64))
                yield from packer.add(tokens, rows)
        yield from packer.flush()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (rows,) = unpack(batches, ENTRY)
        rows = rows[np.lexsort((rows["id"], rows["token"]))]
        packer = Packer(n, held=300_000)
        for a, b in zip(*groups(rows["token"]), strict=True):
            whole = rows[a:b]
            if (whole["home"] == whole["home"][0]).all():
                continue
            readers = whole[whole["reads"]]
            for at in range(0, len(readers), 256):
                q = readers[at : at + 256, None]
                rank = (q["members"] < whole["members"]) | ((q["members"] == whole["members"]) & (q["home"] < whole["home"]))
                fit = rank & (whole["n"] <= q["most"]) & (q["n"] <= whole["most"]) & (4 * whole["n"].astype(np.int64) >= 3 * q["n"].astype(np.int64)) & (4 * q["n"].astype(np.int64) >= 3 * whole["n"].astype(np.int64))
                i, j = np.nonzero(fit)
                ids = q["id"][i, 0]
                met = np.empty(len(i), MET)
                met["id"], met["token"], met["n"], met["other"], met["other_n"], met["home"] = ids, q["token"][i, 0], q["n"][i, 0], whole["id"][j], whole["n"][j], whole["home"][j]
                yield from packer.add(_by_record(ids), met)
        yield from packer.flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (met,) = unpack(batches, MET)
        met = met[np.lexsort((met["other"], met["home"], met["token"], met["id"]))]
        out: list[tuple] = []
        for a, b in zip(*groups(met["id"]), strict=True):
            own, token = int(met["n"][a]), met["token"][a:b]
            lists = [list(zip(*(met[c][a + x : a + y].tolist() for c in ("home", "other", "other_n")), strict=True)) for x, y in zip(*groups(token), strict=True)]
            found: dict[int, list] = {}
            for (home, one, its), same in groupby(heapq.merge(*lists)):
                times = sum(1 for _ in same)
                if times + required(own) - 1 >= -(-3 * (own + its) // 7):
                    found.setdefault(home, []).append((-times, one))
            for partners in found.values():
                chosen = partners if best is None else heapq.nsmallest(best, partners)
                out += [(int(met["id"][a]), one, len(chosen) < len(partners)) for _, one in chosen]
        columns = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["id", "other", "more"])

    lists = sets.select("id", "n", "component", "members", "tokens", "shared", "chosen").mapInArrow(emit, exchange.schema(1))
    met = deal(lists, n).mapInArrow(read, exchange.schema(1))
    return deal(met, n).mapInArrow(merge, "id long, other long, more boolean")


LINKS = "a long, b long, home long, other long"


def searched_in(sets: DataFrame, state: DataFrame, routes: DataFrame, n_routes: int, size: Size) -> DataFrame:
    """The links between documents of different components as (a, b, home, other), with the components of both, for routes
    (id, other), n_routes at most: each id is searched for in the inverted lists of a shard that holds its other ones."""
    # Whoever is asked for by more than a shard's share lies in several shards.
    asked = routes.groupBy("other").agg(F.ceil(F.count(F.lit(1)) * size.shards / max(size.rows, 1)).cast("int").alias("copies"))
    shard = lambda copy: F.pmod(F.xxhash64("other", copy), F.lit(size.shards)).cast("int").alias("shard")
    searching = routes.join(size.small(asked), "other").select("id", F.lit(True).alias("searches"), shard(F.pmod(F.xxhash64("id"), F.col("copies")).cast("int")))
    holding = asked.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select(F.col("other").alias("id"), F.lit(False).alias("searches"), shard(F.col("copy")))
    dealt = searching.union(holding).distinct()
    rows = held(sets, state, size).join(small(dealt, 2 * n_routes), "id").select("shard", "searches", "id", "component", "tokens")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, homes, own, lists = [], [], [], None
        for batch in batches:
            found: list[tuple[int, int, int, int]] = []
            for searches, one, home, data in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                tokens = np.frombuffer(data, np.uint64)
                if not searches:
                    ids.append(one)
                    homes.append(home)
                    own.append(tokens)
                    continue
                if lists is None:
                    lists = Lists(homes, own)
                    own = []
                found += [(one, ids[i], home, homes[i]) for i in lists.search(home, tokens)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(4)], ["a", "b", "home", "other"])

    # A shard's lists come before those who are searched for in them.
    return materialise(rows.repartitionById(size.shards, "shard").sortWithinPartitions("searches").mapInArrow(search, LINKS), "links")


@dataclass
class Size:
    """What is left, counted: rows bounds the tables of ids that joins may broadcast."""

    rows: int
    shards: int

    def small(self, df: DataFrame) -> DataFrame:
        return small(df, self.rows)


def held(sets: DataFrame, state: DataFrame, size: Size) -> DataFrame:
    """(id, n, component, tokens) of the documents that state still has."""
    return sets.select("id", "tokens").join(size.small(state), "id").select("id", "n", "component", "tokens")


@F.arrow_udf(T.BinaryType())
def _tokens(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of (text, print): the set, null if it isn't the one with that fingerprint (another text of the same id)."""
    hashes = _hashes()
    for texts, prints in batches:
        sets = [shingle_set(t, hashes) for t in texts.cast(pa.binary()).to_pylist()]
        yield pa.array([t.tobytes() if len(t) and fingerprint(t)[1] == p else None for t, p in zip(sets, prints.to_pylist(), strict=True)], pa.binary())


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, component) for each row of docs."""
    own, links = linked_classes(docs, id_column, text)
    # An id of several classes joins them.
    several = own.where("id is not null").groupBy("id").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low < high")
    bridges = own.join(several.select("id"), "id").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    return _named(own, materialise(links.union(bridges), "links")).select("id", "n", "component")


def components_by_text(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, hash, print, component) for each row of docs: the hash of its text, the fingerprint of its set, and the component of its
    own set, whatever other texts the id has."""
    own, links = linked_classes(docs, id_column, text)
    return _named(own, materialise(links, "links")).select("id", "hash", "print", "component")


def _named(own: DataFrame, links: DataFrame) -> DataFrame:
    homes = connected_components(links).withColumnRenamed("node", "first")
    return own.join(homes, "first", "left").withColumn("component", F.when(F.col("id").isNotNull(), F.coalesce("component", "first")))


def text_hash(text: F.Column) -> F.Column:
    return F.xxhash64(text.cast("string"))


def linked_classes(docs: DataFrame, id_column: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, n, print, hash, first) for each row of docs, first being the smallest id of its class or else its own; and the links
    (a, b) between such ids. Within the rounds a class is named by its set's fingerprint, as an id may have several sets."""
    bound_batches(docs.sparkSession)
    n = exchange.n_buckets(docs)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"), text_hash(F.col(text)).alias("hash"))
    seen = materialise(scan(rows, n), "shingles")
    documents = materialise(seen.where("bucket is null").select("id", "n", "high", "print", "hash"), "documents")
    classes = documents.where("id is not null and n > 0").groupBy("print", "high").agg(F.min("id").alias("first"), F.max("n").alias("n"))
    classes = materialise(classes, "classes")
    met = shared_counts(seen.where("bucket is not null").select("bucket", "c0", "c1", "c2"), n)
    met = met.join(classes.withColumnRenamed("print", "record"), "record").where(F.col("shared") >= needed(NARROW))
    met = materialise(met.select(F.col("first").alias("id"), F.col("record").alias("print")), "met")
    discard(seen)
    # Other texts of an id go by their sets.
    texts = among(rows.where("text is not null").select("id", "text"), met, met.count(), "id")
    sets = texts.select("print", _tokens("text", "print").alias("tokens")).where("tokens is not null")
    sets = materialise(sets.select(F.col("print").alias("id"), (F.octet_length("tokens") / 8).cast("long").alias("n"), "tokens"), "sets")
    total = sets.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    if total["ids"] < total["rows"]:  # repeated rows, and texts of one id that differ but have one set
        once = materialise(sets.dropDuplicates(["id"]), "sets")
        discard(sets)
        sets = once
    discard(met)
    size = Size(total["ids"], max(n, -(-8 * total["n"] // SHARD_BYTES)))
    state = sets.select("id", "n", F.col("id").alias("component"))
    all_links, turn = [], 0
    while size.rows:
        turn += 1
        met = stars(lists_of(held(sets, state, size), n), n, turn).withColumnRenamed("record", "id")
        met = met.join(size.small(state), "id").where(F.col("shared") >= needed(WIDE))
        left = materialise(met.select("id", "n", "component", "others"), "left")
        size.rows = left.count()
        # Whoever has left links with no other component.
        routes = left.select("id", F.explode("others").alias("other")).join(size.small(left.select(F.col("id").alias("other"))), "other")
        links = searched_in(sets, left.select("id", "n", "component"), routes, LEADERS * size.rows, size)
        all_links.append(links)
        discard(state)
        state = joined(left, links, size)
        discard(left)
        if links.count() * FEW < size.rows:
            break
    for best in PASSES if size.rows else ():
        links, more = searched(sets, state, n, best, size)
        all_links.append(links)
        if not more:
            break
        before, state = state, joined(state, links, size)
        discard(before)
    discard(sets, state)
    links = reduce(DataFrame.union, [x.select("a", "b") for x in all_links]) if all_links else documents.sparkSession.createDataFrame([], "a long, b long")
    firsts = classes.select("print", "first")
    for end in ("a", "b"):
        links = links.withColumnRenamed(end, "print").join(firsts, "print").drop("print").withColumnRenamed("first", end)
    own = documents.join(classes.select("print", "high", "first"), ["print", "high"], "left").withColumn("first", F.coalesce("first", "id"))
    return own.select("id", "n", "print", "hash", "first"), links.select("a", "b")


def joined(left: DataFrame, links: DataFrame, size: Size) -> DataFrame:
    """(id, n, component), the components that links join being one."""
    homes = connected_components(links.select(F.col("home").alias("a"), F.col("other").alias("b")))
    homes = size.small(homes.select(F.col("node").alias("component"), F.col("component").alias("home")))
    return materialise(left.join(homes, "component", "left").select("id", "n", F.coalesce("home", "component").alias("component")), "state")


def searched(sets: DataFrame, state: DataFrame, n: int, best: int | None, size: Size) -> tuple[DataFrame, bool]:
    """Links between different components among the sets that are left, and whether partners were left out."""
    bare = held(sets, state, size)
    members = state.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    chosen = materialise(shared_lists(bare, n).join(size.small(state), "id").join(size.small(members), "component"), "chosen")
    able = sets.select("id", "tokens").join(chosen, "id")
    partners = materialise(divide_skip(able, n, best), "partners")
    links = searched_in(sets, chosen.select("id", "n", "component"), partners.select("id", "other"), partners.count(), size)
    more = not partners.where("more").isEmpty()
    discard(chosen, partners)
    return links, more
