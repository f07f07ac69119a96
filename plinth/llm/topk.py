"""Exact top-k search: tiled matrix products of query blocks and shards, partial selection in each tile, and merging of
the queries' top lists as a tree (tile, then group of tiles, then query).

Vectors are packed into tiles of bounded size. Every block of queries meets every shard: a stated query set against all
rows, in blocks. A task holds one block of queries and ``SHARDS`` tiles at most; what is shuffled besides the tiles is
``k`` rows for each query and group of tiles.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no part; only
vectors of the same length are compared; a query's own id is no candidate, so repeated rows of one id don't find each
other; an id asks one question, with the smallest of its vectors if it has several, while as candidates all its rows count; ties go to the smaller id; fewer candidates than ``k`` give fewer rows; an empty table gives none. Only the id and
vector columns are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.runtime import bound_batches

QUERY_ROWS, SHARD_ROWS, SHARDS = 1024, 4096, 16
TILE = "tile long, dim int, ids binary, vectors binary"


def quantise(x: np.ndarray, scale: float = 256.0) -> np.ndarray:
    return np.floor(scale * x)


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: float64 where sums stay below 2^53, else 64-bit integers."""
    bound = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    return (q @ x.T).astype(np.int64) if bound < 2.0**53 else q.astype(np.int64) @ x.astype(np.int64).T


def vectors_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the batch's whole, finite vectors, by length."""
    ids, lists = batch.column(0), batch.column(1)
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    values = lists.flatten()
    values = (values.cast(pa.float64()).to_numpy(zero_copy_only=False)).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])[:-1]
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[(sizes > 0) & known]):
        rows = np.flatnonzero((sizes == dim) & known)
        x = values[starts[rows][:, None] + np.arange(dim)]
        whole = np.isfinite(x).all(axis=1)
        yield ids.take(pa.array(rows[whole])).to_numpy(zero_copy_only=False).astype(np.int64), x[whole]


def tiles(rows: DataFrame, most: int) -> DataFrame:
    """(id, vector) rows as tiles of up to ``most`` vectors; ids rise in a tile."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        made = TaskContext.get().partitionId() << 33

        def out(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids, x = (np.concatenate(part) for part in zip(*held.pop(dim), strict=True))
            while len(ids) >= max(least, 1):
                order = np.argsort(ids[:most], kind="stable")
                yield pa.RecordBatch.from_pydict({"tile": [made], "dim": pa.array([dim], pa.int32()), "ids": [ids[:most][order].tobytes()], "vectors": [x[:most][order].tobytes()]})
                made, ids, x = made + 1, ids[most:], x[most:]
            if len(ids):
                held[dim] = [(ids, x)]

        for batch in batches:
            for ids, x in vectors_of(batch):
                if len(ids):
                    held.setdefault(x.shape[1], []).append((ids, quantise(x)))
            for dim in [d for d, parts in held.items() if sum(len(i) for i, _ in parts) >= most]:
                yield from out(dim, most)
        for dim in list(held):
            yield from out(dim, 1)

    return rows.mapInArrow(pack, TILE)


def select(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id. Partial selection first."""
    if len(ids) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= kth)
    else:
        among = np.arange(len(ids))
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


def merge_tiles(k: int) -> Callable[[pa.Table], pa.Table]:
    """For one block of queries and a group of shards: the queries' top lists over the group."""

    def merged(table: pa.Table) -> pa.Table:
        rows = table.select(["is_query", "ids", "vectors", "dim"]).to_pylist()
        found: tuple[list, list, list] = ([], [], [])
        for q in (r for r in rows if r["is_query"]):
            mine, a = np.frombuffer(q["ids"], np.int64), np.frombuffer(q["vectors"]).reshape(-1, q["dim"])
            best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(mine)
            for s in (r for r in rows if not r["is_query"]):
                ids = np.frombuffer(s["ids"], np.int64)
                scores = product(a, np.frombuffer(s["vectors"]).reshape(-1, s["dim"]))
                for i, row in enumerate(scores):
                    others = ids != mine[i]
                    theirs, row = (ids, row) if others.all() else (ids[others], row[others])
                    top = select(theirs, row, k)
                    b_ids, b_scores = np.concatenate([best[i][0], theirs[top]]), np.concatenate([best[i][1], row[top]])
                    top = select(b_ids, b_scores, k)
                    best[i] = b_ids[top], b_scores[top]
            for i, (ids, scores) in enumerate(best):
                found[0].append(np.full(len(ids), mine[i]))
                found[1].append(ids)
                found[2].append(scores)
        flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in found]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (x.astype(np.int64) for x in flat), strict=True)))

    return merged


def exact_topk(rows: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best rows by the integer inner product."""
    if k < 1:
        raise ValueError("k is 1 at least")
    pair = [F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector")]
    bound_batches(rows.sparkSession)
    queries = queries.select(*pair).where("id is not null").groupBy("id").agg(F.min("vector").alias("vector"))
    blocks = tiles(queries.repartition(max(1, -(-queries.count() // QUERY_ROWS))), QUERY_ROWS)
    shards = tiles(rows.select(*pair), SHARD_ROWS)
    n_shards = max(1, -(-rows.count() // SHARD_ROWS))
    groups = max(1, -(-n_shards // SHARDS) * 2)
    sides = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    to_group = F.pmod(F.hash("tile"), F.lit(groups))
    asked = blocks.select(F.lit(True).alias("is_query"), "tile", F.col("tile").alias("block"), sides.alias("grp"), "dim", "ids", "vectors")
    # Every shard goes to its group of each block of queries of its length.
    stored = shards.select("tile", to_group.alias("grp"), "dim", "ids", "vectors")
    stored = stored.join(asked.select("block", "grp", "dim"), ["grp", "dim"]).select(F.lit(False).alias("is_query"), "tile", "block", "grp", "dim", "ids", "vectors")
    met = asked.unionByName(stored).groupBy("block", "grp").applyInArrow(merge_tiles(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
