"""The queries opN_<name>: each operator over its whole table, with production parameters, and digests of its results."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import align, chat, cobuckets, jaccard, mixing, neardup, quality, substrings, topk, toxicity, urls, warc
from plinth.llm.bpe import BpeCodec
from plinth.runtime import new_path, read_table

#: Fixed values of the op5 query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
QUERY_EVERY = 50


def op1_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    mixed = mixing.poisson_mix(docs)
    return mixed.select("doc_id", "copy", "source", F.round("mix_rate", 9).alias("mix_rate"), "lang", "n_chars", "text")


OP1_SQL = """
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, n, (SELECT count(*) FROM documents) * pow(n, 0.5) / (SELECT sum(pow(n, 0.5)) FROM sizes) / n AS rate FROM sizes),
steps AS (SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
          FROM rates, unnest(range(0, 1 + ceil(rate + 12 * sqrt(rate) + 30)::BIGINT)) AS u(k)),
cdf AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM steps),
numbers AS (SELECT *, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
counts AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text, any_value(c.rate) AS rate, count(*) FILTER (c.below < d.u) AS n
           FROM (SELECT *, row_number() OVER () AS r FROM numbers) d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source
           GROUP BY d.r, d.doc_id, d.source, d.lang, d.n_chars, d.text)
SELECT doc_id, k::INTEGER AS copy, source, round(rate, 9) AS mix_rate, lang, n_chars, text FROM counts, unnest(range(0, n)) AS u(k)
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = BpeCodec(spark, public_tokenizers.path("byte_bpe_50k.json"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", codec.encode(F.col("text")).alias("ids"))
    back = docs.select("doc_id", "ids", codec.decode(F.col("ids")).alias("decoded"))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.exact_topk(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0))


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose id ends its path: bad if toxic or of low quality."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    labels = read_table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad"))
    last = F.regexp_extract(urls.path_of(F.col("url")), "/([0-9]{1,18})(?:\\.[a-z]+)?/?$", 1)
    pages = pages.withColumn("doc_id", F.when(last != "", last.cast("long")))
    labelled = pages.join(labels, "doc_id", "left").drop("doc_id")
    return urls.filter_urls(labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("bad_share"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(warc.resolve(read_table(spark, sf_dir, "pages")), path)
    return warc.read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(read_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def op8_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are the hosts and their languages the paths. Learns from the rows that op9 learns from."""
    labels = read_table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "quality")
    found = quality.score_quality(read_table(spark, sf_dir, "documents"), labels)
    return found.select(F.col("id").alias("doc_id"), "score", "kept", "evidence", "prior")


def toxicity_of(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    return toxicity.classify(docs, labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col("toxic").alias("y")), keep)


def op9_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = toxicity_of(docs, read_table(spark, sf_dir, "labels"), ["doc_id"])
    score = F.col("toxicity.score")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "toxicity.threshold", "toxicity.toxic")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The op11 query's own conversation.
OWN_TURNS = [(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
TURN_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and loss are read back from the formatted pieces; a running digest for each conversation is held."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame(OWN_TURNS, rows.schema)
    return chat.format_conversations(rows.unionByName(own)).mapInArrow(_turn_digests, TURN_DIGESTS)


def _turn_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: list = []
    done: list[tuple] = []

    def close() -> None:
        if now:
            done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))
            now.clear()

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, pa.string() if i in (2, 4) else pa.int64()) for i, c in enumerate(zip(*done, strict=True))]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in TURN_DIGESTS.split(", ")])

    for pieces in batches:
        for conversation, piece, text, loss in zip(*(c.to_pylist() for c in pieces.columns), strict=True):
            if piece == 0:
                close()
                now += [conversation, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, words in chat.read_back(text):
                now[1] += 1
                now[2].update(f"{role}\n{words}\n".encode())
            for span in loss:
                words = chat.unescape(text[span["start"] : span["end"]])
                now[3] += len(words)
                now[4].update(words.encode())
            now[5] += len(text)
        if done:
            yield batch()
    close()
    if done:
        yield batch()


OP11_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, role)),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*(?:/?s>|/?INST\]|/?ROLE\]))', '\1\\\2', 'g')) AS chars,
             length(regexp_replace(role, '([<\[])(\\*(?:/?s>|/?INST\]|/?ROLE\]))', '\1\\\2', 'g')) AS role_chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(chars + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 17 + role_chars END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = []
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(public_tokenizers.path(name), "rb") as f:
            sides.append(f.read())
    return align.align_tokenizers(read_table(spark, sf_dir, "documents"), *sides)


#: Fixed values of the op13 query.
SALE_BUCKETS, SALE_SALT = 600, "s"


def op13_cobucketed_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales start in files that hold one or two buckets, their lines in files by item."""
    root, key = new_path(spark, "cobuckets"), "sale_id"
    sales, lines = (read_table(spark, sf_dir, t) for t in ("sales", "sale_lines"))
    own = F.coalesce(cobuckets.crc_bucket(F.col(key), SALE_BUCKETS, SALE_SALT), F.lit(SALE_BUCKETS + 1))
    by_item = F.coalesce(cobuckets.crc_bucket(F.col("item_id"), SALE_BUCKETS), F.lit(0))
    pair = []
    for name, rows, number in (("sales", sales, F.when(own % 4 == 1, own - 1).otherwise(own)), ("sale_lines", lines, by_item)):
        cobuckets.write_numbered(rows, rows.columns, f"{root}/{name}", number, SALE_BUCKETS + 2, key)
        pair.append(cobuckets.NumberedFiles(spark, f"{root}/{name}", rows.schema, key))
    return cobuckets.rewrite_pair(*pair, SALE_BUCKETS, SALE_SALT)


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM sets),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, len(s) AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM sets
"""


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages), h AS (SELECT page_id, strlen(x) AS payload_bytes, sha1(x) AS d FROM p),
m AS (SELECT d, max(page_id) AS original FROM h GROUP BY d)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h.d, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to FROM h JOIN m USING (d)
"""

#: All pairs; the forest finds them all where a table fits one leaf.
OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON a = vec_id
"""

OP10_SQL = r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM w, unnest(range(1, len(w) - 11)) u(i)),
firsts AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM windows JOIN firsts USING (k), unnest(range(i, i + 13)) u(p) WHERE least < doc_id GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(coalesce(gone, []), p)), lambda p: w[p]), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_poisson_mixing, op2_bpe, op3_jaccard_join, op4_exact_topk, op5_url_templates, op6_warc, op7_embedding_forest, op8_quality_bayes, op9_toxicity_cnn, op10_substring_dedup, op11_chat_format, op12_token_alignment, op13_cobucketed_pair]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_poisson_mixing": OP1_SQL,
        "op3_jaccard_join": OP3_SQL,
        "op4_exact_topk": OP4_SQL,
        "op6_warc": OP6_SQL,
        "op7_embedding_forest": OP7_SQL,
        "op10_substring_dedup": OP10_SQL,
        "op11_chat_format": OP11_SQL,
    }
