"""Ranking: vector search, fusion of rankings, filters, reranking. All take and return batches of questions (query_id)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import rules
from plinth.functions import text as T
from plinth.runtime import bound_batches, materialise, shuffle_partitions

#: Weights of a batch of questions that go along with the code: some 20 bytes each. Beyond it they are joined.
BROADCAST_WEIGHTS = 500_000
#: Components of dense questions that are broadcast, 4 bytes each as floats.
BROADCAST_COMPONENTS = 4_000_000
#: Rows and cells of a tile, questions that are scored at once, and questions whose matrices a task keeps.
TILE_ROWS, TILE_CELLS, BLOCK_QUESTIONS, HELD_QUESTIONS = 1024, 1 << 21, 256, 1024


def ranked(rows: DataFrame, by: list[Column], name: str = "rank", limit: int | None = None) -> DataFrame:
    """1-based ranks by query. A limit on row_number becomes a partial top-k before the shuffle."""
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*by)))
    return out if limit is None else out.where(F.col(name) <= limit)


def matches(filters: dict[str, Any] | None, as_text: bool = False, columns: list[str] | None = None) -> Column:
    """Conjunction of equalities, null matching null only. as_text: values are strings, as a REST caller sends them, and columns of
    another type match nothing. columns: those that there are; any other key is null in every row."""
    out = F.lit(True)
    for key, expected in (filters or {}).items():
        if as_text and not isinstance(expected, str):
            raise ValueError("filters are strings")
        found = F.col(key) if columns is None or key in columns else F.lit(None)
        out = out & found.eqNullSafe(F.lit(expected))
    return out


def dealt(rows: DataFrame, tiles: int, parts: int) -> DataFrame:
    """(n, share, rows): vectors (id, vector) of n components in about so many arrays."""
    shared = rows.withColumns({"n": F.size("vector"), "share": F.pmod(F.xxhash64("id"), F.lit(tiles))}).where("n is not null")
    return shared.repartition(parts, "share").groupBy("share", "n").agg(F.collect_list(F.struct("id", "vector")).alias("rows"))


def matrix_of(rows: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors of an array of both. A missing component adds nothing."""
    vectors = rows.field("vector")
    return rows.field("id"), pc.fill_null(vectors.flatten(), 0).to_numpy().astype(np.float64).reshape(len(rows), -1)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, id_column: str = "chunk_id", vector: str = "vector", keep: Column | None = None) -> DataFrame:
    """Every question against every vector: (query_id, id, score, rank). queries: query_id, vector. The filter comes first.
    Tiles of vectors meet blocks of questions as matrices, and only each pair's best with their ties are summed component by component
    and ranked. Blocks are broadcast if their weights are counted few, else sent once to each share of the tiles."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors if keep is None else vectors.where(keep)
    stored, asked = rows.select(F.col(id_column).alias("id"), F.col(vector).alias("vector")), queries.select(F.col("query_id").alias("id"), "vector")
    n, (n_asked, weights) = stored.count(), asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    shares = shuffle_partitions(spark)
    tiles = max(1, -(-n // TILE_ROWS), min(shares, n // 64))
    parts = min(tiles, shares)
    blocks = dealt(asked, max(1, -(-n_asked // BLOCK_QUESTIONS)), 1 if weights <= BROADCAST_COMPONENTS else shares).select("n", F.col("rows").alias("asked"))
    held, on = dealt(stored, tiles, parts), ["n"]
    if weights <= BROADCAST_COMPONENTS:
        blocks = F.broadcast(blocks)
    else:
        on = ["n", "part"]
        held = held.withColumn("part", F.pmod("share", F.lit(parts)))
        blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ids, x), (asking, y) = (matrix_of(batch.column(c).slice(i, 1).flatten()) for c in (0, 1))
                with np.errstate(invalid="ignore"):
                    rough = y @ x.T
                rough[np.isnan(rough)] = np.inf  # the greatest, as Spark sorts it
                least = np.partition(rough, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(asking), -np.inf)
                slack = np.where(np.isfinite(least), 1e-8 + 1e-9 * np.abs(least), 0)
                q, c = np.nonzero(rough >= (least - slack)[:, None])
                scores = np.add.accumulate(y[q] * x[c], axis=1)[:, -1] if x.shape[1] else np.zeros(len(q))
                yield pa.RecordBatch.from_arrays([asking.take(pa.array(q)), ids.take(pa.array(c)), pa.array(scores)], ["query_id", id_column, "score"])

    kinds = [asked.schema["id"].dataType.simpleString(), stored.schema["id"].dataType.simpleString()]
    scored = held.join(blocks, on).select("rows", "asked").mapInArrow(best, f"query_id {kinds[0]}, {id_column} {kinds[1]}, score double")
    return ranked(scored.withColumn("score", F.round("score", 9)), [F.desc("score"), F.col(id_column)], limit=k)


def packed(weights: DataFrame, id_column: str) -> DataFrame:
    """(id, bucket, weight) as one row for each vector: (id, buckets, weights)."""
    return weights.groupBy(id_column).agg(F.collect_list("bucket").alias("buckets"), F.collect_list("weight").alias("weights"))


def unpacked(vectors: DataFrame, id_column: str) -> DataFrame:
    each = vectors.select(id_column, F.explode(F.arrays_zip("buckets", "weights")).alias("x"))
    return each.select(id_column, F.col("x.buckets").alias("bucket"), F.col("x.weights").alias("weight"))


def tiled_topk(asked: pa.Table, queries: DataFrame, weights: DataFrame, k: int, id_column: str) -> DataFrame:
    """(query_id, id, score) with the k best positive scores of each tile of vectors and their ties: products of whole tiles with the
    questions' matrix, so that only top lists are shuffled. A join of single weights makes a row for each product instead. Questions
    come in blocks, whose matrices and tiles have only their own buckets. What stays below a task's k-th best so far is left out."""
    ids = pc.unique(asked["query_id"])
    row = pc.index_in(asked["query_id"], value_set=ids).to_numpy().astype(np.int32)
    bucket, weight = asked["bucket"].to_numpy().astype(np.int32), asked["weight"].to_numpy()
    size = int(bucket.max()) + 1 if len(bucket) else 1
    vectors = (weights if "buckets" in weights.columns else packed(weights, id_column)).select(id_column, "buckets", "weights")

    def blocks() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for start in range(0, len(ids), BLOCK_QUESTIONS):
            own = (row >= start) & (row < start + BLOCK_QUESTIONS)
            used = np.unique(bucket[own])
            place = np.full(size, -1, np.int32)
            place[used] = np.arange(len(used))
            matrix = np.zeros((len(used), min(BLOCK_QUESTIONS, len(ids) - start)))
            matrix[place[bucket[own]], row[own] - start] = weight[own]
            yield start, place, matrix

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.full(len(ids), -np.inf)
        held = list(blocks()) if len(ids) <= HELD_QUESTIONS else None
        for batch in batches:
            for start, place, matrix in held or blocks():
                rows = max(1, min(TILE_ROWS, TILE_CELLS // max(1, len(matrix))))
                for at in range(0, batch.num_rows, rows):
                    tile = batch.slice(at, rows)
                    n = tile.column(1).value_lengths().to_numpy(zero_copy_only=False)
                    b, w = (tile.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
                    own, b, w = np.repeat(np.arange(tile.num_rows), n)[b < size], b[b < size], w[b < size]
                    known = place[b] >= 0
                    x = np.zeros((tile.num_rows, len(matrix)))
                    x[own[known], place[b[known]]] = w[known]
                    scores = np.round(x @ matrix, 9).T
                    least = floor[start : start + len(scores)]
                    if tile.num_rows >= k:
                        np.maximum(least, np.partition(scores, -k, axis=1)[:, -k], out=least)
                    q, i = np.nonzero((scores >= least[:, None]) & (scores > 0))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q + start)), tile.column(0).take(pa.array(i)), pa.array(scores[q, i])], ["query_id", id_column, "score"])

    kinds = {f.name: f.dataType.simpleString() for f in (queries.schema["query_id"], weights.schema[id_column])}
    return vectors.mapInArrow(score, f"query_id {kinds['query_id']}, {id_column} {kinds[id_column]}, score double")


def sparse_topk(queries: DataFrame, weights: DataFrame, chunks: DataFrame, k: int, id_column: str = "chunk_id", order: str = "chunk_ord", filtered: bool = True) -> DataFrame:
    """As dense_topk over sparse rows. queries: (query_id, bucket, weight); weights: (id, bucket, weight) or packed(); chunks: (id, order), the rows
    that may be found; filtered: whether they may be fewer than those of weights. Rows without a common bucket score 0; they are
    looked at only for questions with fewer than k better ones. The k best with their ties are cut before order is joined."""
    allowed = weights.join(chunks.select(id_column), id_column, "left_semi") if filtered else weights
    parts = unpacked(allowed, id_column) if "buckets" in allowed.columns else allowed
    parts = parts.join(queries.withColumnRenamed("weight", "asked"), "bucket")
    scored = parts.groupBy("query_id", id_column).agg(F.round(F.sum(F.col("weight") * F.col("asked")), 9).alias("score"))
    few = queries.limit(BROADCAST_WEIGHTS + 1).toArrow()
    if few.num_rows <= BROADCAST_WEIGHTS:
        tied = tiled_topk(few, queries, allowed, k, id_column)
    else:
        tied = scored.withColumn("place", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("place") <= k).drop("place")
    best = materialise(ranked(tied.join(chunks, id_column), [F.desc("score"), F.col(order)], limit=k), "best")
    above = best.groupBy("query_id").agg(F.count_if(F.col("score") > 0).alias("above"))
    needy = queries.select("query_id").distinct().join(above, "query_id", "left").where(F.coalesce("above", F.lit(0)) < k).select("query_id")
    if needy.isEmpty():
        return best
    needy = materialise(needy, "needy")
    own = materialise(scored.join(needy, "query_id"), "own")
    # The first zeros are among as many chunks as the question has scores, and k more.
    most = own.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    zeros = needy.crossJoin(F.broadcast(chunks.orderBy(order).limit(k + most))) if k + most <= BROADCAST_WEIGHTS else needy.crossJoin(chunks)
    zeros = zeros.join(own.select("query_id", id_column), ["query_id", id_column], "left_anti").withColumn("score", F.lit(0.0))
    again = ranked(own.join(chunks, id_column).unionByName(zeros), [F.desc("score"), F.col(order)], limit=k)
    return best.join(needy, "query_id", "left_anti").unionByName(again, allowMissingColumns=True)


def few(rows: DataFrame) -> DataFrame:
    """Top lists, to be joined with a corpus where that is: by broadcast if they are counted few."""
    held = materialise(rows, "few")
    return F.broadcast(held) if held.count() <= BROADCAST_WEIGHTS else held


def rrf(left: DataFrame, right: DataFrame, limit: int, id_column: str = "chunk_id") -> DataFrame:
    """Reciprocal ranks of two rankings (query_id, id, rank), summed: (query_id, id, left_rank, right_rank, score). Who is in one only
    ranks limit + 60 in the other."""
    both = left.select("query_id", id_column, F.col("rank").alias("left_rank")).join(right.select("query_id", id_column, F.col("rank").alias("right_rank")), ["query_id", id_column], "full")
    missing = F.lit(limit + rules.RRF_MISSING)
    score = F.lit(1.0) / (rules.RRF_K + F.coalesce("left_rank", missing)) + F.lit(1.0) / (rules.RRF_K + F.coalesce("right_rank", missing))
    return both.withColumn("score", score)


def is_diet(question: Column) -> Column:
    return T.has_any(T.words(question), rules.DIET_QUERY_TERMS)


def expanded(question: Column) -> Column:
    return F.when(is_diet(question), F.concat(question, F.lit(" " + rules.DIET_EXPANSION))).otherwise(question)


def evidence_text() -> Column:
    """A missing section reads 'None' and a missing title nothing, as in the metadata that they come from."""
    return F.concat_ws(" ", F.col("text"), F.coalesce("title", F.lit("")), F.coalesce("section", F.lit("None")), F.coalesce("source_id", F.lit("")))


def relevant(question: Column) -> Column:
    """For questions about diet the chunk must speak of it; for others the score must be above 0."""
    return F.when(is_diet(question), T.has_any(T.words(evidence_text()), rules.DIET_CONTEXT_TERMS)).otherwise(F.col("score") > 0)


def rerank_score(question: Column, text: Column, score: Column) -> Column:
    asked, said = F.array_distinct(T.tokens(question)), F.array_distinct(T.tokens(text))
    overlap, phrase, own = rules.RERANK_WEIGHTS
    share = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, said)) / F.size(asked)).otherwise(0.0)
    return share * overlap + F.when(F.contains(F.lower(text), F.lower(question)), phrase).otherwise(0.0) + score * own


def rerank(results: DataFrame, backend: str = "lexical") -> DataFrame:
    """New ranks; scores stay. Any other backend leaves the order as it is."""
    if backend != "lexical":
        return results
    scored = results.withColumn("combined", F.round(rerank_score(F.col("question"), F.col("text"), F.col("score")), 12))
    return ranked(scored.withColumnRenamed("rank", "old_rank"), [F.desc("combined"), F.col("old_rank")]).drop("combined", "old_rank")


def source_summaries(chunks: DataFrame, order: str = "chunk_ord") -> DataFrame:
    """(source_id, title, source_path, chunks, pages)."""
    out = chunks.groupBy("source_id").agg(
        F.min_by("title", order).alias("title"), F.min_by("source_path", order).alias("source_path"), F.count(F.lit(1)).alias("chunks"), F.array_sort(F.collect_set("page")).alias("pages")
    )
    return out.orderBy(F.lower("source_id"), "source_id")
