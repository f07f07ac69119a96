"""The training-corpus pipeline: toxicity, near duplicates, repeated passages, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import jaccard, mixing, substrings
from plinth.llm.bpe import BpeCodec
from plinth.llm.queries import toxicity_of
from plinth.runtime import materialise, read_table

TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches their language's threshold go."""
    found = toxicity_of(docs, read_table(spark, sf_dir, "labels"), docs.columns)
    return found.where("not toxicity.toxic").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts those with the smallest id stay, and one for each set of that id; rows without an id stay. Another
    text of the same id is judged by its own links."""
    found = jaccard.components_by_text(docs.select("doc_id", "text")).where("id = component")
    stay = found.groupBy("id", "print").agg(F.min("hash").alias("text_hash")).select(F.col("id").alias("doc_id"), "text_hash")
    hashed = docs.where("doc_id is not null").withColumn("text_hash", jaccard.text_hash(F.col("text")))
    kept = hashed.join(stay, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select(docs.columns)
    return kept.union(docs.where("doc_id is null"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that a smaller document has too go; documents stay, as shorter texts."""
    found = substrings.remove_repeats(docs)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    return found.withColumns({"text": text, "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars"))}).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document by its source's rate, in random order."""
    return mixing.poisson_mix(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text again."""
    codec = BpeCodec(spark, public_tokenizers.path(TOKENIZER))
    coded = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"), codec.encode(F.col("text")).alias("ids"))
    same = codec.decode(F.col("ids")) == F.col("text")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_near_duplicates),
    ("substrings", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: No SQL: a trained classifier and random replication stand in the way; tests compare with brute force stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
