"""Embedding, reranking and generating backends: built-in ones, a service behind an injectable transport, and functions of the caller's."""

from __future__ import annotations

import json
import time
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators import answers, embedding
from plinth.operators.retrieval import packed
from plinth.operators.retrieval import rerank as lexical_rerank
from plinth.runtime import discard, materialise
from plinth.settings import Settings
from plinth.sources import tables

Transport = Callable[[str, dict | None, float], dict]
#: A batch of texts -> a vector each. It runs in Python workers, so it must be picklable.
Embedder = Callable[[list[str]], list[list[float]]]
#: Results (query_id, question, a chunk's columns, score, rank) -> the same rows with new ranks.
Reranker = Callable[[DataFrame], DataFrame]
#: (questions, results, settings) -> a row for each question with answer, citations, generation_model and fallback.
Generator = Callable[[DataFrame, DataFrame, Settings], DataFrame]
#: A row of the embedding cache.
VECTORS = {"text_sha256": "string", "buckets": "array<int>", "weights": "array<double>", "model": "string"}


def http(url: str, payload: dict | None, timeout: float) -> dict:
    data = None if payload is None else json.dumps(payload).encode()
    request = urllib.request.Request(url, data=data, headers={"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


#: Calls of a service that a task has open at a time, how often one is tried, and the first pause between tries in seconds.
AT_ONCE, TRIES, PAUSE = 4, 3, 0.25


def in_order(call: Callable, given: Iterable, at_once: int = AT_ONCE) -> Iterator:
    """call(x) for each x, a few at a time; results in the order of what was given, and never more than at_once ahead of the reader."""
    with ThreadPoolExecutor(at_once) as pool:
        waiting: deque = deque()
        for x in given:
            waiting.append(pool.submit(call, x))
            if len(waiting) >= at_once:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def patiently(call: Callable, *given: Any, tries: int = TRIES, pause: float = PAUSE) -> Any:
    """A service may be busy for a moment: tries again after a pause that doubles. The last error is raised."""
    for last in range(tries):
        try:
            return call(*given)
        except Exception:
            if last == tries - 1:
                raise
            time.sleep(pause * 2**last)
    raise AssertionError


def embed_texts(texts: list[str], url: str, model: str, timeout: float, transport: Transport) -> list[list[float]]:
    """A batch at once, or one by one where the service has only the older call. Of unit length."""
    try:
        found = transport(f"{url}/api/embed", {"model": model, "input": texts}, timeout)["embeddings"]
    except Exception:
        found = [transport(f"{url}/api/embeddings", {"model": model, "prompt": t}, timeout)["embedding"] for t in texts]
    norms = [sum(x * x for x in v) ** 0.5 for v in found]
    return [[x / n for x in v] if n else v for v, n in zip(found, norms, strict=True)]


@dataclass
class Backends:
    """embedder, reranker and generator take the place of the named kinds; an embedder needs an embedding_name, which indexes and
    caches are known by."""

    embedding: str = "hash"  # hash, md5 or service
    generation: str = "extractive"  # extractive or service
    embedding_name: str = ""
    fell_back: bool = False
    transport: Transport = field(default=http)
    embedder: Embedder | None = None
    reranker: Reranker | None = None
    generator: Generator | None = None

    def __post_init__(self) -> None:
        if self.embedder and not self.embedding_name:
            raise ValueError("An embedder needs an embedding_name")

    @classmethod
    def of(cls, s: Settings, transport: Transport = http) -> Backends:
        """auto takes the service if it answers within two seconds, else hashing."""
        if s.embedding_backend not in ("auto", "hash", "md5", "ollama"):
            raise ValueError(f"Unknown embedding backend: {s.embedding_backend}")
        kind = {"hash": "hash", "md5": "md5", "ollama": "service"}.get(s.embedding_backend)
        fell_back = False
        if kind is None:
            try:
                transport(f"{s.ollama_url}/api/tags", None, 2.0)
                kind = "service"
            except Exception:
                kind, fell_back = "hash", True
        name = f"ollama:{s.ollama_embedding_model}" if kind == "service" else embedding.model_name("blake2b" if kind == "hash" else kind, s.embedding_dimensions)
        return cls(kind, "service" if s.generation_backend == "ollama" else "extractive", name, fell_back, transport)

    def weights(self, texts: DataFrame, id_column: str, s: Settings) -> DataFrame:
        """(id, text) -> (id, bucket, weight), past the cache: questions don't belong there."""
        if self.embedder or self.embedding == "service":
            return self._served(texts.select(F.col(id_column).alias("text_sha256"), "text"), s).withColumnRenamed("text_sha256", id_column)
        return embedding.hash_embed(texts, id_column, "text", self._profile(), s.embedding_dimensions)

    def _profile(self) -> str:
        return "blake2b" if self.embedding == "hash" else "md5"

    def vectors(self, texts: DataFrame, s: Settings) -> DataFrame:
        """(text_sha256, text), each once -> (text_sha256, buckets, weights)."""
        if self.embedder or self.embedding == "service":
            return packed(self.weights(texts, "text_sha256", s), "text_sha256")
        return embedding.hash_vectors(texts, "text_sha256", "text", self._profile(), s.embedding_dimensions, unique=True)

    def embed(self, rows: DataFrame, spark: SparkSession, s: Settings) -> DataFrame:
        """(chunk_id, text) -> (chunk_id, buckets, weights). Texts that repeat are embedded once, cached ones not at all; the others are
        appended to the cache, a row for each vector, so that a row is there whole or not at all."""
        keyed = rows if "text_sha256" in rows.columns else rows.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
        texts = keyed.select("text_sha256", "text").dropDuplicates(["text_sha256"])
        at = f"{s.cache_path}/vectors"
        if not s.cache_path:
            return keyed.select("chunk_id", "text_sha256").join(self.vectors(texts, s), "text_sha256").drop("text_sha256")
        missing = texts
        if tables.exists(spark, at):
            missing = texts.join(self._cached(spark, at).select("text_sha256"), "text_sha256", "left_anti")
        missing = materialise(missing, "missing")
        if not missing.isEmpty():
            # A text without a term has an empty vector, so that it isn't embedded in each run anew.
            made = missing.select("text_sha256").join(self.vectors(missing, s), "text_sha256", "left")
            made = made.withColumns({"buckets": F.coalesce("buckets", F.array().cast("array<int>")), "weights": F.coalesce("weights", F.array().cast("array<double>"))})
            made.withColumn("model", F.lit(self.embedding_name)).select(*VECTORS).write.mode("append").parquet(at)
        discard(missing)
        return keyed.select("chunk_id", "text_sha256").join(self._cached(spark, at), "text_sha256").drop("text_sha256")

    def _cached(self, spark: SparkSession, at: str) -> DataFrame:
        """Two writers at a time may both have appended a text: the vectors are the same."""
        kinds = ", ".join(f"{k} {v}" for k, v in VECTORS.items())
        return spark.read.schema(kinds).parquet(at).where(F.col("model") == self.embedding_name).drop("model").dropDuplicates(["text_sha256"])

    def _served(self, texts: DataFrame, s: Settings) -> DataFrame:
        size = s.embedding_batch_size
        at_once = 1 if self.embedder else AT_ONCE  # a function of the caller's need not be safe for threads
        embed = self.embedder or partial(embed_texts, url=s.ollama_url, model=s.ollama_embedding_model, timeout=s.request_timeout_seconds, transport=self.transport)

        def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = (batch.slice(at, size) for batch in batches for at in range(0, batch.num_rows, size))
            made = lambda part: (part, patiently(embed, part.column(1).to_pylist()))
            for part, vectors in in_order(made, parts, at_once):
                if part.num_rows:
                    sizes = np.array([len(v) for v in vectors], np.int64)
                    own = np.repeat(np.arange(part.num_rows), sizes)
                    place = np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else own
                    weights = np.array([x for v in vectors for x in v], np.float64)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array(place.astype(np.int32)), pa.array(weights)], ["text_sha256", "bucket", "weight"])

        key = texts.schema["text_sha256"].dataType.simpleString()
        return texts.select("text_sha256", "text").mapInArrow(call, f"text_sha256 {key}, bucket int, weight double")

    def rerank(self, results: DataFrame, s: Settings) -> DataFrame:
        return self.reranker(results) if self.reranker else lexical_rerank(results, s.reranker_backend)

    def generate(self, questions: DataFrame, results: DataFrame, s: Settings) -> DataFrame:
        """Answers with citations; a service that fails falls back to the extractive answer and says so."""
        if self.generator:
            return self.generator(questions, results, s)
        extracted = answers.extractive_answers(questions, results)
        if self.generation != "service":
            return extracted.withColumns({"generation_model": F.lit("extractive"), "fallback": F.lit(False)})
        prompts = answers.user_prompts(questions, results)
        url, model, timeout, heat, transport = s.ollama_url, s.ollama_generation_model, s.request_timeout_seconds, s.temperature, self.transport

        def one(prompt: tuple[str, str]) -> tuple[str | None, str | None]:
            messages = [{"role": r, "content": x} for r, x in zip(("system", "user"), prompt, strict=True)]
            try:
                found = patiently(transport, f"{url}/api/chat", {"model": model, "stream": False, "messages": messages, "options": {"temperature": heat}}, timeout)
                return found["message"]["content"].strip(), None
            except Exception as error:  # this question falls back, the others don't
                return None, str(error)

        def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(in_order(one, zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)))
                said, broken = [x for x, _ in found], [x for _, x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(broken, pa.string())], ["query_id", "said", "broken"])

        served = prompts.select(F.col("query_id").cast("string"), "system_prompt", "user_prompt").mapInArrow(call, "query_id string, said string, broken string")
        joined = extracted.join(served.withColumnRenamed("query_id", "served_id"), F.col("query_id").cast("string") == F.col("served_id"), "left").drop("served_id")
        note = F.concat(F.col("answer"), F.lit("\n\nThe generation backend was unavailable, so this is an extractive answer. Error: "), F.col("broken"))
        out = joined.withColumns({"answer": F.coalesce("said", note), "fallback": F.col("said").isNull()})
        return out.withColumn("generation_model", F.when(F.col("fallback"), F.lit(f"{model} -> extractive")).otherwise(F.lit(model))).drop("said", "broken")
