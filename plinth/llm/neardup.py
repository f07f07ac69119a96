"""Embedding near-dedup by a forest of random-projection trees.

Each tree splits the space again and again by a random direction at the median of a sample; vectors within ``SPILL`` of the
boundary go to both sides. A split that parts less than it copies (a dense cluster near the boundary) is not made. Vectors
are compared within leaves, in double precision, and only if their labels are equal, so a leaf is small enough when each label's
share of it is. A pair is counted in the first leaf that it shares (every vector travels with its list of leaves), so counts need
no table of pairs; of its links a leaf passes on a spanning forest only, which makes the components. So what leaves a leaf is as
long as its members.

The first levels are fitted on a bounded sample of each length of vectors (``SAMPLE`` vectors and ``SAMPLE_BYTES`` at most, by
hash, and directions of ``FOREST_BYTES`` in all at most); all vectors are indexed. A leaf's members of one label that are more
than ``OVERFULL`` are split again, by distributed medians over all of them, level by level until none is left, whatever the size
of the table. Equal vectors of a label are one class first, counted by partial aggregation. Members of one label that are still
more than ``BLOCK`` (a dense cluster) are split into blocks by hash, and each pair of blocks is compared in a task of its own, so
memory is bounded whatever the leaf holds.

Defined results: vectors that are null or zero or hold null or non-finite components, rows with a null label, and vectors of
different lengths link with nothing; rows without an id have no component; rows that repeat an id are counted as other
vectors. An empty table gives an empty result. Only the three named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm.components import connected_components
from plinth.llm.sift import small
from plinth.runtime import bound_batches, discard, materialise

TREES, LEAF, SPILL, SAMPLE, BLOCK, LEAST_SAMPLE = 4, 512, 0.03, 20_000, 2048, 8
OVERFULL = 4 * LEAF
SAMPLE_BYTES, FOREST_BYTES = 32 << 20, 16 << 20
#: Lengths of vectors whose forests one pass over the table fits and applies.
LENGTHS = 16
#: A split is made if it leaves no more than this share on each side.
PARTS = 0.8


def unit(x: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that no square overflows or vanishes."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.finfo(float).tiny)


class Forest:
    """Trees as flat lists of nodes: (direction, boundary, left, right) or a leaf's number."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = 3) -> None:
        self.spill, self.leaves, self.roots, self.nodes = spill, 0, [], []
        rng = np.random.default_rng(seed)
        most = max(1, FOREST_BYTES // (8 * max(sample.shape[1], 1) * trees))
        wanted = max(LEAST_SAMPLE, leaf * len(sample) / max(rows, 1), 2 * len(sample) / most)
        for _ in range(trees):
            self.roots.append(self._grow(sample, wanted, rng))

    def _grow(self, x: np.ndarray, wanted: float, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        for _ in range(3 if len(x) > wanted else 0):
            direction = rng.normal(size=x.shape[1])
            direction /= np.linalg.norm(direction)
            side = x @ direction
            middle = float(np.median(side))
            left, right = x[side <= middle + self.spill], x[side >= middle - self.spill]
            if max(len(left), len(right)) <= PARTS * len(x):
                self.nodes[at] = (direction, middle, self._grow(left, wanted, rng), self._grow(right, wanted, rng))
                return at
        self.nodes[at] = self.leaves
        self.leaves += 1
        return at

    def leaves_of(self, x: np.ndarray) -> list[list[int]]:
        """For each vector the leaves that it lies in, rising."""
        found: list[list[int]] = [[] for _ in range(len(x))]
        stack = [(root, np.arange(len(x))) for root in reversed(self.roots)]
        while stack:
            node, rows = stack.pop()
            node = self.nodes[node]
            if isinstance(node, int):
                for i in rows.tolist():
                    found[i].append(node)
            elif len(rows):
                direction, middle, left, right = node
                side = x[rows] @ direction
                stack.append((right, rows[side >= middle - self.spill]))
                stack.append((left, rows[side <= middle + self.spill]))
        return [sorted(f) for f in found]


def valid(vector: str) -> F.Column:
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0)


def packed(x: np.ndarray) -> list[bytes]:
    """Rows as 32-bit numbers where these are exact (vectors come as such), else as 64-bit ones; the length tells which."""
    small = x.astype(np.float32)
    same = (small == x).all(axis=1)
    return [(a if s else b).tobytes() for a, b, s in zip(small, x, same, strict=True)]


def unpacked(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.array([np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64) for b in blobs], np.float64).reshape(-1, dim)


def place(rows: DataFrame, forests: dict[int, Forest]) -> DataFrame:
    """(id, label, vector, copies) -> one row for each leaf that a vector lies in, with all of its leaves. A length without a forest
    has one leaf."""
    shared = rows.sparkSession.sparkContext.broadcast({d: (f.nodes, f.roots, f.spill) for d, f in forests.items()})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for d, (nodes, roots, spill) in shared.value.items():
            known[d] = Forest.__new__(Forest)
            known[d].nodes, known[d].roots, known[d].spill = nodes, roots, spill
        for batch in batches:
            ids, labels, lists = batch.column(0), batch.column(1), batch.column(2)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                x = values[starts[rows][:, None] + np.arange(d)]
                leaves = known[int(d)].leaves_of(unit(x)) if int(d) in known else [[0]] * len(rows)
                again = np.repeat(np.arange(len(rows)), [len(f) for f in leaves])
                blob = packed(x)
                mine = [np.array(f, np.int64).tobytes() for f in leaves]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([leaf for f in leaves for leaf in f], pa.int64()), ids.take(pa.array(rows[again])), labels.take(pa.array(rows[again])), batch.column(3).take(pa.array(rows[again])), pa.array([int(d)] * len(again), pa.int32()), pa.array([blob[i] for i in again], pa.binary()), pa.array([mine[i] for i in again], pa.binary())],
                    ["leaf", "id", "label", "copies", "dim", "x", "leaves"],
                )

    return rows.select("id", "label", "vector", "copies").mapInArrow(route, "leaf long, id long, label long, copies long, dim int, x binary, leaves binary")


CELL = ["leaf", "label", "dim"]


@F.arrow_udf(T.DoubleType())
def side_of(cells: pa.Array, dims: pa.Array, x: pa.Array) -> pa.Array:
    """Where a vector lies along its cell's random direction."""
    out = np.empty(len(x))
    numbers, sizes = cells.to_numpy(zero_copy_only=False), dims.to_numpy(zero_copy_only=False)
    for cell in np.unique(numbers):
        rows = np.flatnonzero(numbers == cell)
        dim = int(sizes[rows[0]])
        direction = np.random.default_rng(int(cell) & (1 << 63) - 1).normal(size=dim)
        out[rows] = unit(unpacked([x[i].as_py() for i in rows.tolist()], dim)) @ (direction / np.linalg.norm(direction))
    return pa.array(out)


def split_again(placed: DataFrame, spill: float) -> DataFrame:
    """placed, with the members of one label and leaf that are more than OVERFULL parted by random directions at their own medians,
    until no such cell can be parted any more. Medians and counts are aggregated partially, so no cell meets in one task."""
    done, live, again = [], placed, False
    while True:
        cells = live.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > OVERFULL)
        cells = materialise(cells.withColumn("cell", F.xxhash64(*CELL, F.lit("cell"))), "cells")
        n_cells = cells.count()
        if not n_cells:
            done.append(live)
            break
        again = True
        done.append(live.join(small(cells.select(*CELL), n_cells), CELL, "left_anti"))
        sided = live.join(small(cells.select(*CELL, "cell"), n_cells), CELL).withColumn("side", side_of("cell", "dim", "x"))
        sided = materialise(sided, "sides")
        cuts = materialise(sided.groupBy("cell").agg(F.percentile_approx("side", 0.5, 10_000).alias("middle"), F.count(F.lit(1)).alias("n")), "cuts")
        sided = sided.join(small(cuts, n_cells), "cell")
        left, right = F.col("side") <= F.col("middle") + spill, F.col("side") >= F.col("middle") - spill
        parted = sided.groupBy("cell").agg(F.greatest(F.count(F.when(left, 1)), F.count(F.when(right, 1))).alias("most"), F.max("n").alias("n"))
        parted = materialise(parted.select("cell", (F.col("most") <= PARTS * F.col("n")).alias("parts")), "parted")
        sided = sided.join(small(parted, n_cells), "cell")
        done.append(sided.where("not parts").select(placed.columns))
        sides = F.filter(F.array(F.when(left, F.lit(0)), F.when(right, F.lit(1))), lambda v: v.isNotNull())
        live = sided.where("parts").withColumn("part", F.explode(sides)).withColumn("leaf", F.xxhash64("cell", "part"))
        live = materialise(live.select(placed.columns), "leaves")
    if not again:
        return placed
    out = materialise(reduce(DataFrame.unionByName, done), "leaves")
    # The lists of leaves anew, in the order of their numbers.
    lists = out.groupBy("id").agg(F.array_sort(F.collect_set("leaf")).alias("all"))
    out = out.drop("leaves").join(lists, "id").withColumn("leaves", as_blob("all")).drop("all")
    return materialise(out.select(placed.columns), "leaves")


@F.arrow_udf(T.BinaryType())
def as_blob(lists: pa.Array) -> pa.Array:
    return pa.array([np.array(v.as_py(), np.int64).tobytes() for v in lists], pa.binary())


def earlier(a: list[np.ndarray], b: list[np.ndarray], leaf: int) -> np.ndarray:
    """Whether the i-th of a and the j-th of b share a leaf before this one."""
    seen = np.unique(np.concatenate([*a, *b]))
    seen = seen[seen < leaf]
    if not len(seen):
        return np.zeros((len(a), len(b)), bool)
    marks = []
    for side in (a, b):
        m = np.zeros((len(side), len(seen)), np.float32)
        for i, own in enumerate(side):
            m[i, np.searchsorted(seen, own[own < leaf])] = 1
        marks.append(m)
    return marks[0] @ marks[1].T > 0


def compare(least: float, leaf: int, a: dict, b: dict | None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Counts for a's and b's members, weighed by the other's copies, of the pairs first met here; and links that span them."""
    x, y = a["x"], (b or a)["x"]
    near = x @ y.T >= least
    if b is None:
        np.fill_diagonal(near, False)
    links = spanning(near, b is None)
    fresh = near & ~earlier(a["leaves"], (b or a)["leaves"], leaf) if near.any() else near
    return fresh @ (b or a)["copies"], fresh.T @ a["copies"], links


def spanning(near: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Pairs (row, column) that connect what near connects: breadth first, each member reached once."""
    out = []
    unseen = np.ones(near.shape[1], bool)
    done = np.zeros(near.shape[0], bool)
    for start in np.flatnonzero(near.any(axis=1)):
        if done[start]:
            continue
        rows = [int(start)]
        done[start] = True
        if same:
            unseen[start] = False
        while rows:
            i = rows.pop()
            for j in np.flatnonzero(near[i] & unseen).tolist():
                unseen[j] = False
                out.append((i, j))
                if same:
                    done[j] = True
                    rows.append(j)
                else:
                    back = np.flatnonzero(near[:, j] & ~done).tolist()
                    done[back] = True
                    out += [(k, j) for k in back]
                    rows += back
    return out


def near_duplicates(rows: DataFrame, least: float = 0.93, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", trees: int = TREES) -> DataFrame:
    """(id, n_links, component, kept) for each row."""
    bound_batches(rows.sparkSession)
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    fine = F.col("label").isNotNull() & F.col("id").isNotNull() & valid("vector")
    named = rows.where(fine).withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0)))  # -0.0 becomes 0.0
    # Equal vectors are told by 128 bits of hash; their class is named by its smallest id.
    key = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(7), F.reverse("vector")).alias("h2")]
    keyed = named.select("id", "label", *key)
    classes = keyed.groupBy("label", "h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # An id may have several vectors, so a class goes by a hash of what tells it; its smallest id comes back at the end.
    classes = materialise(classes.withColumn("class", F.xxhash64("label", "h1", "h2")), "classes")
    own = classes.select(F.col("first").alias("id"), F.col("label").alias("l"), F.col("h1").alias("o1"), F.col("h2").alias("o2"), "copies", "class")
    firsts = named.withColumns({"h1": key[0], "h2": key[1]}).join(own, "id").where("label = l and h1 = o1 and h2 = o2").dropDuplicates(["id", "label", "h1", "h2"])
    firsts = materialise(firsts.select(F.col("class").alias("id"), "label", "vector", "copies"), "vectors")

    # Only equal labels are compared, so what counts for a leaf's size is the largest label.
    sizes = firsts.groupBy(F.size("vector").alias("d"), "label").agg(F.count(F.lit(1)).alias("n")).groupBy("d").agg(F.max("n").alias("n"), F.sum("n").alias("all"))
    sizes = materialise(sizes, "lengths")
    split = {r["d"]: (r["n"], r["all"]) for r in sizes.where(F.col("n") > LEAF).toLocalIterator()}
    parts = [place(firsts.join(small(sizes.where(F.col("n") <= LEAF).select("d"), sizes.count()), F.size("vector") == F.col("d")), {})] if sizes.count() > len(split) else []
    for at in range(0, len(split), LENGTHS):
        forests, some = {}, dict(list(split.items())[at : at + LENGTHS])
        of_these = firsts.where(F.size("vector").isin(list(some)))
        # Of each length about as many as wanted, by a bound for the hash: nothing is sorted.
        wanted = {d: min(SAMPLE, max(1, SAMPLE_BYTES // (8 * d * len(some)))) for d in some}
        bound = F.coalesce(*[F.when(F.size("vector") == d, F.lit(int(min(1.0, wanted[d] / every) * (1 << 62)))) for d, (_, every) in some.items()])
        sample = of_these.where(F.shiftrightunsigned(F.xxhash64("id", F.lit("sample")), 2) < bound).select("id", "vector").toArrow().sort_by("id")["vector"]
        lengths = np.array([len(v) for v in sample])
        for d, (n, _) in some.items():
            own = sample.take(np.flatnonzero(lengths == d))
            forests[d] = Forest(unit(np.asarray(own.combine_chunks().flatten()).reshape(-1, d)), n, trees)
        parts.append(place(of_these, forests))
    if not parts:
        parts.append(place(firsts, {}))
    placed = split_again(materialise(reduce(DataFrame.union, parts), "leaves"), SPILL)
    held = placed.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).where("n > 1").drop("n")
    held = materialise(held, "held")
    mine = placed.join(small(held, held.count()), CELL).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # Each member meets every block of its leaf: as the smaller or the larger one of the pair.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = mine.withColumn("other", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def meet(table: pa.Table) -> pa.Table:
        leaf, low, high = (table.column(c)[0].as_py() for c in ("leaf", "low", "high"))
        block, ids = table["block"].to_numpy(), table["id"].to_numpy()
        x = unit(unpacked(table["x"].to_pylist(), table["dim"][0].as_py()))
        leaves = [np.frombuffer(v, np.int64) for v in table["leaves"].to_pylist()]
        copies = table["copies"].to_numpy().astype(np.float64)
        sides = []
        for k in ([low] if low == high else [low, high]):
            at = np.flatnonzero(block == k)
            sides.append({"ids": ids[at], "x": x[at], "leaves": [leaves[i] for i in at], "copies": copies[at]})
        a, b = sides[0], sides[1] if len(sides) > 1 else None
        counted, back, links = compare(least, leaf, a, b) if all(len(s["ids"]) for s in sides) else (np.zeros(0), np.zeros(0), [])
        out_id, out_n = [a["ids"][: len(counted)]], [counted]
        if b:
            out_id, out_n = [*out_id, b["ids"][: len(back)]], [*out_n, back]
        tail = (b or a)["ids"]
        out_id.append(np.array([a["ids"][i] for i, _ in links], np.int64))
        out_other = np.array([tail[j] for _, j in links], np.int64)
        n = np.concatenate(out_n).astype(np.int64)
        keep = n > 0
        first = np.concatenate(out_id[:-1])[keep]
        return pa.table({
            "id": pa.array(np.concatenate([first, out_id[-1]]), pa.int64()),
            "n": pa.array(np.concatenate([n[keep], np.zeros(len(links), np.int64)]), pa.int64()),
            "other": pa.array([None] * len(first) + out_other.tolist(), pa.int64()),
        })

    columns = ["leaf", "label", "dim", "low", "high", "block", "id", "x", "leaves", "copies"]
    found = met.select(*columns).groupBy("leaf", "label", "dim", "low", "high").applyInArrow(meet, "id long, n long, other long")
    found = materialise(found, "found")
    links = found.where("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    homes = connected_components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    reps = classes.join(links.withColumnRenamed("id", "class"), "class", "left").join(homes.withColumnRenamed("node", "class"), "class", "left")
    reps = reps.withColumn("group", F.coalesce("component", "class")).drop("component")
    least = reps.groupBy("group").agg(F.min("first").alias("component"))
    reps = reps.join(least, "group").select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "component")
    own = rows.select("id", "label", F.when(fine, F.transform("vector", lambda v: v + F.lit(0.0))).alias("vector"))
    own = own.select("id", F.when(F.col("vector").isNotNull(), F.col("label")).alias("label"), *key)
    out = own.join(reps, ["label", "h1", "h2"], "left").select("id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component"))
    discard(placed, firsts)
    return out.withColumn("kept", F.col("id") == F.col("component"))
