"""Okapi BM25 over tables of postings, and over blocks of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import rules
from plinth.functions import text as T
from plinth.operators.retrieval import BROADCAST_WEIGHTS, tiled_topk
from plinth.runtime import bound_batches, materialise


def repeated_ids(rows: DataFrame, id_column: str) -> DataFrame | None:
    """(again) ids of more than one row, none if there are none: ids alone are counted, and all else by id needs a shuffle only of
    these rows."""
    again = materialise(rows.groupBy(id_column).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(F.col(id_column).alias("again")), "again")
    return None if again.isEmpty() else again


def where_id(rows: DataFrame, id_column: str, again: DataFrame, how: str) -> DataFrame:
    return rows.join(again, F.col(id_column).eqNullSafe(F.col("again")), how)


def term_counts(rows: DataFrame, names: list[str], text: str) -> DataFrame:
    """The named columns with term and tf, a row for each distinct token. Counted batch by batch where the texts are: a table of counts would
    grow with the rows of a task."""
    bound_batches(rows.sparkSession)
    read = rows.select(*names, T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names))
            own = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            coded = lists.flatten().dictionary_encode()
            key, tf = np.unique(own * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_counts=True)
            row, term = np.divmod(key, max(1, len(coded.dictionary)))
            kept = [batch.column(i).take(pa.array(row)) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, coded.dictionary.take(pa.array(term)), pa.array(tf, pa.int64())], [*names, "term", "tf"])

    kinds = ", ".join(f"`{n}` {read.schema[n].dataType.simpleString()}" for n in names)
    return read.mapInArrow(counts, f"{kinds}, term string, tf long")


def occurrences(rows: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """(id, term): a row for each token."""
    each = rows.select(F.col(id_column), F.explode_outer(T.tokens(F.col(text))).alias("term"))
    return each.where("term is not null")


def postings(rows: DataFrame, id_column: str = "chunk_id", text: str = "text") -> DataFrame:
    """(id, term, tf). Rows of ids that repeat are summed."""
    rows = rows.select(F.col(id_column), F.col(text).alias("text"))
    again = repeated_ids(rows, id_column)
    if again is None:
        return term_counts(rows, [id_column], "text")
    summed = term_counts(where_id(rows, id_column, again, "left_semi"), [id_column], "text").groupBy(id_column, "term").agg(F.sum("tf").alias("tf"))
    return term_counts(where_id(rows, id_column, again, "left_anti"), [id_column], "text").unionByName(summed)


def term_stats(found: DataFrame) -> DataFrame:
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def doc_stats(rows: DataFrame, id_column: str = "chunk_id", text: str = "text") -> DataFrame:
    return rows.select(id_column, F.size(T.tokens(F.col(text))).cast("long").alias("dl"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """docs: doc_stats(). One row, of an empty corpus too."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum("dl") / F.count(F.lit(1)), F.lit(0.0)).alias("avgdl"))


def bm25_scores(queries: DataFrame, found: DataFrame, docs: DataFrame, id_column: str = "chunk_id", query: str = "question") -> DataFrame:
    """(query_id, id, score): sums over the query's token occurrences. Only postings of query terms are met; the corpus's two
    numbers come as one row. Joins choose their own strategy from the sizes."""
    asked = occurrences(queries, "query_id", query).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    wanted = asked.select("term").distinct()
    hits = found.join(wanted, "term")
    one = corpus_stats(docs)
    df = term_stats(hits)
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") + rules.BM25_K1 * (1 - rules.BM25_B + rules.BM25_B * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1.0)))
    scored = hits.join(docs, id_column).join(df, "term").crossJoin(F.broadcast(one))
    scored = scored.select("term", id_column, (idf * F.col("tf") * (rules.BM25_K1 + 1) / norm).alias("part"))
    out = asked.join(scored, "term").groupBy("query_id", id_column).agg(F.sum(F.col("qtf") * F.col("part")).alias("score"))
    return out.where("score > 0")


def wanted_counts(tokens: Column, wanted: pa.Array) -> Column:
    """(buckets, tfs) of each list: the numbers of the wanted terms that it holds, and how often."""

    @F.arrow_udf("struct<buckets:array<int>,tfs:array<int>>")
    def counts(lists: pa.Array) -> pa.Array:
        own = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        term = pc.fill_null(pc.index_in(lists.flatten(), value_set=wanted), -1).to_numpy().astype(np.int64)
        key, tf = np.unique(own[term >= 0] * len(wanted) + term[term >= 0], return_counts=True)
        ends = pa.array(np.searchsorted(key, np.arange(len(lists) + 1) * len(wanted)).astype(np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key % max(1, len(wanted)), tf)], ["buckets", "tfs"])

    return counts(tokens)


def bm25_topk(queries: DataFrame, rows: DataFrame, k: int, id_column: str = "chunk_id", text: str = "text", query: str = "question") -> DataFrame:
    """(query_id, id, score): as bm25_scores(), rounded to nine places, of the k best rows of each question with their ties, and of some
    others. Rows keep the counts of the questions' own terms alone, and whole tiles of them are scored at once. Very many
    questions, and ids that repeat, go by joins of postings."""
    asked = occurrences(queries, "query_id", query).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    few = asked.limit(BROADCAST_WEIGHTS + 1).toArrow()
    if few.num_rows > BROADCAST_WEIGHTS or repeated_ids(rows, id_column) is not None:
        return bm25_scores(queries, postings(rows, id_column, text), doc_stats(rows, id_column, text), id_column, query).withColumn("score", F.round("score", 9))
    bound_batches(rows.sparkSession)
    wanted = pc.unique(few["term"])
    tokens = T.tokens(F.coalesce(F.col(text), F.lit("")))
    read = rows.select(id_column, tokens.alias("tokens"))
    found = read.select(id_column, F.size("tokens").cast("long").alias("dl"), wanted_counts(F.col("tokens"), wanted).alias("x"))
    found = materialise(found.select(id_column, "dl", "x.buckets", "x.tfs"), "found")
    one = corpus_stats(found).first()
    df = np.zeros(len(wanted))
    held = found.select(F.explode("buckets").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()  # a row a wanted term
    df[held["term"].to_numpy()] = held["df"].to_numpy()
    idf = np.log((one.n - df + 0.5) / (df + 0.5) + 1)
    term = pc.index_in(few["term"], value_set=wanted).to_numpy()
    table = pa.table({"query_id": few["query_id"], "bucket": pa.array(term), "weight": pa.array(few["qtf"].to_numpy() * idf[term])})
    parts = F.transform("tfs", lambda tf: impact(tf, F.col("dl"), float(one.avgdl)))
    return tiled_topk(table, queries, found.select(id_column, "buckets", parts.alias("weights")), k, id_column)


# -- blocks -------------------------------------------------------------------------------------------------------------------

#: Postings of a block, and about so many chunks whose postings of one term meet in one task while blocks are made.
BLOCK, SHARD_ROWS = 128, 1_000_000
#: Terms that a scan is told to look for, one by one; for more of them it reads all blocks and joins.
TOLD_TERMS = 64
#: Blocks of a batch of questions from which on skipping pays: below it all are read.
SKIP_FROM = 4096
#: Scores differ in their last bits with the order of sums.
SLACK = 1e-6


def postings_with_length(chunks: DataFrame) -> DataFrame:
    """(chunk_id, term, tf, dl) of chunks with text and n_tokens; an index holds a chunk_id once."""
    return term_counts(chunks, ["chunk_id", "n_tokens"], "text").select("chunk_id", "term", "tf", F.col("n_tokens").alias("dl"))


def impact(tf: Column, dl: Column, average: Column | float) -> Column:
    """A posting's share of a score, without its term's idf. It grows with tf and falls with dl."""
    average = F.greatest(average if isinstance(average, Column) else F.lit(average), F.lit(1.0))
    return tf * (rules.BM25_K1 + 1) / (tf + rules.BM25_K1 * (1 - rules.BM25_B + rules.BM25_B * dl / average))


def blocks(found: DataFrame, n_rows: int) -> DataFrame:
    """(term, block, n, most_tf, least_dl, chunk_ids, tfs, dls), sorted by term within each file. Blocks hold postings of like impact, and
    their largest tf with their smallest dl bounds that impact from above whatever the corpus's average length comes to be. A term
    of very many chunks is dealt over shards, so that no task sorts them all."""
    shards = max(1, -(-n_rows // SHARD_ROWS))
    rows = found.withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int"))
    by = Window.partitionBy("term", "shard").orderBy(F.desc(F.col("tf") / (F.col("dl") + 1)), "chunk_id")
    rows = rows.withColumn("block", F.floor((F.row_number().over(by) - 1) / BLOCK) * shards + F.col("shard"))
    held = rows.groupBy("term", "shard", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"), F.collect_list(F.struct("chunk_id", "tf", "dl")).alias("p")
    )
    out = held.select("term", "block", "n", "most_tf", "least_dl", F.col("p.chunk_id").alias("chunk_ids"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"))
    return out.sortWithinPartitions("term", "block")


def block_scores(queries: DataFrame, stored: DataFrame, n: int, average: float, k: int, dead: DataFrame | None = None, dead_terms: DataFrame | None = None, query: str = "question") -> DataFrame:
    """(query_id, chunk_id, score): as bm25_scores(), of the k best chunks of each question with their ties, and of others, whose scores may
    lack parts but stay below. stored: blocks with their segment; n, average: the numbers of the corpus; dead: (segment, chunk_id);
    dead_terms: (term, df) of these.

    The k-th best sum over each term's best blocks is a bound from below. A block is read only if its own bound from above, with the
    best that the question's other terms can add, reaches it: chunks of a block that is left out can't be among the k best.

    Where questions share frequent words, a row for each of their postings and questions would be many times the postings: then each
    posting is read once, and tiles of chunks are scored."""
    asked = occurrences(queries, "query_id", query).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    terms = [r.term for r in asked.select("term").distinct().limit(TOLD_TERMS + 1).collect()]
    if not terms:
        return queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id string, score double")
    hit = stored
    if len(terms) <= TOLD_TERMS:
        wanted = F.lit(False)
        for t in terms:
            wanted = wanted | (F.col("term") == t)
        hit = stored.where(wanted)
    else:
        hit = stored.join(asked.select("term").distinct(), "term", "left_semi")
    heads = hit.groupBy("term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("blocks"), F.max(impact(F.col("most_tf"), F.col("least_dl"), average)).alias("best"))
    if dead_terms is not None:
        less = dead_terms.groupBy("term").agg(F.sum("df").alias("less"))
        heads = heads.join(less, "term", "left").withColumn("df", F.col("df") - F.coalesce("less", F.lit(0)))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighed = asked.join(heads, "term").withColumn("weight", F.col("qtf") * idf)
    weighed = weighed.select("query_id", "term", "weight", "blocks", (F.col("weight") * F.col("best")).alias("most"))
    local = weighed.limit(BATCH_TERMS + 1).toArrow()
    total = sum(local.column("blocks").to_pylist())
    alone = sum(dict(zip(local.column("term").to_pylist(), local.column("blocks").to_pylist(), strict=True)).values())
    if local.num_rows <= BATCH_TERMS and total > max(TILE_FROM, TILE_SHARED * alone):
        return _tiled_block_scores(queries, hit, local, average, k, dead)
    if local.num_rows <= BATCH_TERMS:  # a few numbers for each word of each question
        weighed = F.broadcast(queries.sparkSession.createDataFrame(local)) if local.num_rows else weighed
    joined = hit.join(weighed.drop("blocks"), "term").withColumn("above", F.col("weight") * impact(F.col("most_tf"), F.col("least_dl"), average))

    def parts(rows: DataFrame) -> DataFrame:
        each = rows.select("query_id", "segment", "weight", F.explode(F.arrays_zip("chunk_ids", "tfs", "dls")).alias("p"))
        each = each.select("query_id", "segment", F.col("p.chunk_ids").alias("chunk_id"), (F.col("weight") * impact(F.col("p.tfs"), F.col("p.dls"), average)).alias("part"))
        each = each if dead is None else each.join(dead.select("segment", "chunk_id"), ["segment", "chunk_id"], "left_anti")
        return each.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))

    if local.num_rows > BATCH_TERMS or total >= SKIP_FROM:
        first = joined.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "term").orderBy(F.desc("above"), "segment", "block"))).where(F.col("place") <= SEED_BLOCKS)
        low = parts(first).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("place") == k).select("query_id", F.col("score").alias("least"))
        reach = weighed.groupBy("query_id").agg(F.sum("most").alias("reach")).join(low, "query_id", "left")
        joined = joined.join(reach, "query_id").where(F.col("above") + F.col("reach") - F.col("most") >= F.coalesce("least", F.lit(0.0)) - SLACK)
    return parts(joined).where("score > 0")


def _tiled_block_scores(queries: DataFrame, hit: DataFrame, local: pa.Table, average: float, k: int, dead: DataFrame | None) -> DataFrame:
    terms = pc.unique(local["term"])
    number = pa.array(pc.index_in(local["term"], value_set=terms).to_numpy().astype(np.int32))
    numbers = queries.sparkSession.createDataFrame(pa.table({"term": terms, "bucket": pa.array(np.arange(len(terms), dtype=np.int32))}))
    each = hit.join(F.broadcast(numbers), "term").select("segment", "bucket", F.explode(F.arrays_zip("chunk_ids", "tfs", "dls")).alias("p"))
    each = each.select("segment", F.col("p.chunk_ids").alias("chunk_id"), "bucket", impact(F.col("p.tfs"), F.col("p.dls"), average).alias("weight"))
    each = each if dead is None else each.join(dead.select("segment", "chunk_id"), ["segment", "chunk_id"], "left_anti")
    # One list, so that buckets and weights stay aligned.
    held = each.groupBy("chunk_id").agg(F.collect_list(F.struct("bucket", "weight")).alias("p"))
    held = held.select("chunk_id", F.col("p.bucket").alias("buckets"), F.col("p.weight").alias("weights"))
    bound_batches(queries.sparkSession)
    return tiled_topk(pa.table({"query_id": local["query_id"], "bucket": number, "weight": local["weight"]}), queries, held, k, "chunk_id")


#: Blocks of all words of all questions from which on chunks are scored by tiles, if each block is asked for so often.
TILE_FROM, TILE_SHARED = 32_768, 4
#: Words of a batch of questions whose numbers are broadcast, some 50 bytes each; more of them are joined. Blocks of each word that
#: give the first bound.
BATCH_TERMS, SEED_BLOCKS = 100_000, 2
