"""The engine: ingest(path), ask(question), ask_batch(questions), sources(). One lazy plan for each, with tables in between where more
than one branch reads them."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.operators import chunking, cleaning, lexical, manifest, retrieval
from plinth.plans.backends import Backends
from plinth.runtime import materialise
from plinth.settings import PARSER_VERSION, Settings, answer_mode, candidate_limit, question_limit
from plinth.sources import files as sources
from plinth.sources import tables
from plinth.sources.segments import Index

#: What names a file's content in the extraction cache, and what is kept of its pages.
KEYS, CACHED = ["sha256", "size", "mtime_ns", "parser_version"], ["page_number", "title", "text"]
CACHE = "page_number int, title string, text string, sha256 string, size long, mtime_ns long, parser_version string"
#: Times that a change is worked out anew where other writers were faster.
TRIES = 5


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings | None = None, backends: Backends | None = None, parse_pdf: Callable | None = None) -> None:
        self.spark, self.settings = spark, settings or Settings()
        self.backends = backends or Backends.of(self.settings)
        self.parse_pdf = parse_pdf
        s = self.settings
        self.index = Index(spark, s.index_path)
        self.manifest = tables.DeltaTable(spark, s.manifest_path, manifest.MANIFEST, ["path"]) if s.manifest_path else None
        self.cache = tables.DeltaTable(spark, s.extraction_cache_path, CACHE, KEYS) if s.extraction_cache_path else None

    # -- ingest ---------------------------------------------------------------------------------------------------------------

    def ingest(self, path: str | None = None, force: bool = False, resume: bool = True, failed_only: bool = False, max_files: int | None = None) -> dict:
        """Builds or changes the index of a folder's files. With a manifest and an extraction cache unchanged files aren't read again: what
        changed is written as a segment of the index, and nothing if nothing did. Without them everything is done anew and one bad
        file ends it. Returns the counts. If another writer changes the index meanwhile, the change is worked out again."""
        for last in range(TRIES):
            try:
                return self._ingest(path or self.settings.source_path, force or not resume, failed_only, max_files)
            except tables.Conflict:
                if last == TRIES - 1:
                    raise
        raise AssertionError

    def _ingest(self, path: str, force: bool, failed_only: bool, max_files: int | None) -> dict:
        spark, s = self.spark, self.settings
        began, timings = time.time(), {}
        listed = sources.list_files(spark, path, max_files)
        base = self.index.log.current()
        known = self.manifest.read() if self.manifest and self.cache else None
        state = manifest.compared(sources.discover(listed), known, PARSER_VERSION, s.chunk_size_chars, s.chunk_overlap_chars, self.backends.embedding_name, force, failed_only)
        counts = manifest.report(state).first().asDict()
        timings["discovery"] = time.time() - began
        if not counts["discovered"]:
            raise ValueError(f"No files to ingest under {path}")
        if known is not None and base and not counts["changed"] and not counts["deleted"] and not counts["voided"]:
            return self._report(counts, self.index.snapshot().n, True, timings | {"total": time.time() - began})
        state = materialise(state, "files")
        # A few files of an index that fits: a segment. Else, and where other files are in question than those that changed, all anew.
        some = known is not None and base is not None and base["model"] == self.backends.embedding_name and not failed_only and max_files is None and not force and counts["kept"] > 0
        work = state.where("is_changed" if some else "is_own")
        mark = time.time()
        pages, n_cached = self._pages(listed, work, counts["pdfs"] > 0)
        timings["extraction"], mark = time.time() - mark, time.time()
        failed = pages.where("error is not null").select("path", "error").distinct()
        texts = pages.agg(F.count_if((F.col("text") != "") & F.col("error").isNull()).alias("pages"), F.count_if(F.col("text") == "").alias("scanned_pages"), F.count_distinct(F.when(F.col("error").isNotNull(), F.col("path"))).alias("failed")).first().asDict()
        if known is None and texts["failed"]:
            broken = failed.first()
            raise ValueError(f"{broken['path']}: {broken['error']}")
        chunks = self._chunks(pages, state)
        n_chunks = chunks.count()
        timings["chunking"], mark = time.time() - mark, time.time()
        if some:
            voided = state.where("is_changed or is_deleted or is_voided").select(F.regexp_replace("path", "^file:/+", "/").alias("source_path"))
            record = self.index.append(base, self.segment(chunks, n_chunks) if n_chunks else None, voided, self.backends.embedding_name)
        elif n_chunks:
            record = self.index.replace(self.segment(chunks, n_chunks), self.backends.embedding_name)
        else:
            raise ValueError("No text could be extracted from the source files")
        timings["index"], mark = time.time() - mark, time.time()
        if known is not None:
            self._remember(state, known, work, pages, failed, chunks)
        timings["manifest"], timings["total"] = time.time() - mark, time.time() - began
        return self._report(counts | texts | {"from_cache": n_cached + (counts["kept"] if some else 0)}, sum(x["n"] for x in record["segments"]), False, timings)

    def _pages(self, listed: DataFrame, work: DataFrame, pdfs: bool) -> tuple[DataFrame, int]:
        """Pages of files, from the cache where it has them, and how many files it had."""
        wanted = work.select("path", "sha256", "size", "mtime_ns").withColumn("parser_version", F.lit(PARSER_VERSION))
        cached = self.cache.read() if self.cache and self.cache.exists() else None
        hits, misses = tables.cache_split(wanted, cached.groupBy(*KEYS).agg(F.collect_list(F.struct(*CACHED)).alias("held")) if cached is not None else None, KEYS)
        if cached is None:
            return materialise(self._extracted(listed, wanted, pdfs), "pages"), 0
        old = hits.select("path", F.explode("held").alias("p"), *KEYS).select("path", *[F.col(f"p.{c}").alias(c) for c in CACHED], F.lit(None).cast("string").alias("error"), *KEYS)
        old = materialise(old, "hits")
        n = old.agg(F.count_distinct("path")).first()[0]
        misses = materialise(misses, "misses")
        return (old if misses.isEmpty() else old.unionByName(materialise(self._extracted(listed, misses, pdfs), "fresh"))), n

    def _extracted(self, listed: DataFrame, files: DataFrame, pdfs: bool) -> DataFrame:
        rows = listed.join(files.select("path"), "path", "left_semi")
        found = sources.extract(rows, self.parse_pdf, self.settings.pdf_workers) if pdfs else sources.text_pages(rows)
        return found.join(files, "path").select("path", *CACHED, "error", *KEYS)

    def _chunks(self, pages: DataFrame, state: DataFrame) -> DataFrame:
        s = self.settings
        chunks = chunking.chunks(cleaning.segments(self.page_table(pages.where("error is null and text <> ''"))), s)
        # What filters may ask of a chunk's file.
        files = state.where("is_own").select(F.regexp_replace("path", "^file:/+", "/").alias("source_path"), F.col("sha256").alias("source_hash"), F.col("size").alias("source_size"), F.col("mtime_ns").alias("source_mtime_ns"))
        made_by = {"parser_version": F.lit(PARSER_VERSION), "chunk_size_chars": F.lit(s.chunk_size_chars), "chunk_overlap_chars": F.lit(s.chunk_overlap_chars)}
        own = {"source_id": sources.base_name(F.col("source_path")), "text_sha256": F.sha2(F.col("text").cast("binary"), 256), "n_tokens": F.size(T.tokens(F.col("text"))).cast("long")}
        return materialise(chunks.join(files, "source_path", "left").withColumns(made_by).withColumns(own), "chunks")

    def _remember(self, state: DataFrame, known: DataFrame, work: DataFrame, pages: DataFrame, failed: DataFrame, chunks: DataFrame) -> None:
        """Appends what was extracted to the cache, and the rows that changed to the manifest."""
        s = self.settings
        n = pages.where("error is null").groupBy("path").agg(F.count_if(F.col("text") != "").alias("pages"), F.count_if(F.col("text") == "").alias("scanned_pages"))
        m = chunks.groupBy(F.col("source_path").alias("own_path")).agg(F.count(F.lit(1)).alias("chunks"))
        own = work.join(failed.select("path"), "path", "left_anti").join(n, "path", "left").join(m, F.regexp_replace("path", "^file:/+", "/") == F.col("own_path"), "left").fillna(0, ["pages", "scanned_pages", "chunks"])
        rows = manifest.outcome(own, "indexed", PARSER_VERSION, s.chunk_size_chars, s.chunk_overlap_chars, self.backends.embedding_name)
        rows = rows.unionByName(manifest.outcome(work.join(failed, "path"), "failed", PARSER_VERSION)).unionByName(manifest.outcome(state.where("is_new_copy"), "duplicate", PARSER_VERSION))
        deleted = state.where("is_deleted")
        before = known.join(rows.select("path").union(deleted.select("path")), "path", "left_semi")
        with ThreadPoolExecutor(2) as pool:
            put = inheritable_thread_target(self.spark)(lambda table, df: table.append(df))
            both = [pool.submit(put, self.manifest, manifest.upsert(before, rows, deleted, time.time(), PARSER_VERSION)), pool.submit(put, self.cache, self._uncached(pages))]
            for done in both:
                done.result()

    def _uncached(self, pages: DataFrame) -> DataFrame:
        found = pages.where("error is null")
        if self.cache.exists():
            found = found.join(self.cache.read().select(*KEYS).distinct(), KEYS, "left_anti")
        return found.select(*CACHED, *KEYS)

    def _report(self, counts: dict, chunks: int, skipped: bool, timings: dict) -> dict:
        shown = {k: counts[k] for k in ("discovered", "duplicates", "changed", "deleted")}
        return shown | {k: counts.get(k, 0) for k in ("pages", "scanned_pages", "failed", "from_cache")} | {"documents": counts["discovered"] - counts["duplicates"], "chunks": chunks, "skipped": skipped, "embedding_model": self.backends.embedding_name, "timings": timings}

    @staticmethod
    def page_table(texts: DataFrame) -> DataFrame:
        """Pages as chunking wants them: a source is a path here, shown by its base name; the corpus's order is by lower-case path."""
        path = F.regexp_replace("path", "^file:/+", "/")
        return texts.select(
            F.struct(F.lower("path").alias("lower"), F.col("path"), F.col("page_number").alias("no")).alias("page_ord"), F.col("path").alias("source_id"), path.alias("source_path"),
            "title", "page_number", "text", F.lit(None).cast("array<string>").alias("hierarchy"),
        )

    def segment(self, chunks: DataFrame, n_chunks: int) -> dict[str, DataFrame]:
        """The tables of a segment: chunks (with n_tokens), vectors and blocks of postings. Vectors of known texts come from the cache."""
        vectors = self.backends.embed(chunks.select("chunk_id", "text", "text_sha256"), self.spark, self.settings)
        return {"chunks": chunks, "vectors": vectors, "blocks": lexical.blocks(lexical.postings_with_length(chunks), n_chunks)}

    # -- questions ------------------------------------------------------------------------------------------------------------

    def index_exists(self) -> bool:
        return self.index.exists()

    def search(self, questions: DataFrame, top_k: int, filters: dict[str, Any] | None = None, hybrid: bool = True, question: str = "question") -> DataFrame:
        """questions: query_id, question. (query_id, a chunk's columns, score, rank)."""
        held = self.index.snapshot()
        if held.record["model"] != self.backends.embedding_name:
            raise ValueError(f"Questions would be embedded by {self.backends.embedding_name}, the index holds vectors of {held.record['model']}: ingest again, or ask with that model")
        limit = candidate_limit(top_k)
        chunks = held.table("chunks")
        fits = retrieval.matches(filters, columns=chunks.columns)
        asked = self.backends.weights(questions.select("query_id", F.col(question).alias("text")), "query_id", self.settings)
        names = chunks.where(fits).select("chunk_id", "chunk_ord")
        nearest = retrieval.sparse_topk(asked, held.table("vectors"), names, limit if hybrid else top_k, filtered=bool(filters))
        if hybrid:
            scores = lexical.block_scores(questions.select("query_id", question), held.stored("blocks"), held.n, held.average, limit, held.dead, held.dead_terms, question)
            scores = scores.join(chunks.select("chunk_id", "chunk_ord"), "chunk_id").withColumn("score", F.round("score", 9))
            matched = retrieval.ranked(scores, [F.desc("score"), F.col("chunk_ord")], limit=limit)
            # The filter comes after the lexical ranks: what it drops still took a rank.
            fused = retrieval.rrf(nearest, matched, limit).join(names, "chunk_id").withColumn("score", F.round("score", 12))
            nearest = retrieval.ranked(fused, [F.desc("score"), F.col("chunk_ord")], limit=top_k)
        return nearest.select("query_id", "chunk_id", "score", "rank").join(chunks, "chunk_id")

    def ask_batch(self, questions: DataFrame, top_k: int | None = None, filters: dict[str, Any] | None = None) -> DataFrame:
        """questions: query_id, question and perhaps answer_mode. One row each, with answer and citations."""
        s = self.settings
        limit = question_limit(top_k, s)
        if "answer_mode" not in questions.columns:
            questions = questions.withColumn("answer_mode", F.lit(answer_mode(s.answer_mode)))
        questions = questions.withColumn("expanded", retrieval.expanded(F.col("question")))
        found = self.search(questions, candidate_limit(limit), filters, question="expanded").join(questions.select("query_id", "question", "answer_mode"), "query_id")
        kept = found.where(retrieval.relevant(F.col("question")) & (F.col("score") >= s.min_relevance_score))
        kept = retrieval.ranked(kept.withColumnRenamed("rank", "was"), [F.col("was")]).drop("was")
        cut = self.backends.rerank(kept, s).where(F.col("rank") <= limit)
        return self.backends.generate(questions.drop("expanded"), cut, s)

    def ask(self, question: str, top_k: int | None = None, filters: dict[str, Any] | None = None, mode: str | None = None) -> dict:
        mode = answer_mode(mode or self.settings.answer_mode)
        question = question.strip()
        if not question:
            raise ValueError("question is empty")
        one = self.spark.createDataFrame([("q", question, mode)], "query_id string, question string, answer_mode string")
        row = self.ask_batch(one, top_k, filters).first().asDict(recursive=True)
        return row | {"embedding_model": self.backends.embedding_name, "retrieval_mode": "hybrid"}

    def sources(self) -> DataFrame:
        return retrieval.source_summaries(self.index.snapshot().table("chunks"))
