"""Scenarios over small folders of texts."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plinth.plans.backends import Backends
from plinth.plans.engine import Engine
from plinth.settings import Settings, candidate_limit


@pytest.fixture
def make(spark, tmp_path):
    def build(texts, incremental=True, **changes):
        folder = tmp_path / "corpus"
        folder.mkdir(exist_ok=True)
        for name, text in texts.items():
            (folder / name).write_text(text)
        values = {"source_path": str(folder), "index_path": str(tmp_path / "index"), "embedding_backend": "hash", "chunk_size_chars": 300, "chunk_overlap_chars": 40}
        if incremental:
            values |= {"manifest_path": str(tmp_path / "manifest"), "extraction_cache_path": str(tmp_path / "extracted"), "cache_path": str(tmp_path / "embeddings")}
        return Engine(spark, Settings(**(values | changes)))

    return build


STROKE = "Stroke rehabilitation should begin early. Patients with stroke benefit from mobilisation within days."
DIET = "A Mediterranean diet with fruit and vegetables and less salt supports secondary prevention after stroke."


def test_ingest_ask_and_sources(make):
    engine = make({"stroke.txt": STROKE, "garden.md": "Tulips flower in spring when soil is warm.", "skip.doc": "x"}, incremental=False)
    report = engine.ingest()
    assert (report["documents"], report["chunks"], report["failed"]) == (2, 2, 0)
    answer = engine.ask("When should stroke rehabilitation begin?")
    assert answer["citations"][0]["source"] == "stroke.txt" and answer["retrieval_mode"] == "hybrid"
    assert answer["answer"].startswith("I found these relevant points") and "[1]" in answer["answer"]
    assert [(r.source_id, r.chunks, r.pages) for r in engine.sources().collect()] == [("garden.md", 1, [1]), ("stroke.txt", 1, [1])]


def test_second_run_is_skipped_and_changes_are_seen(make, tmp_path):
    engine = make({"a.txt": STROKE, "b.txt": STROKE, "c.txt": DIET})
    first = engine.ingest()
    assert (first["discovered"], first["duplicates"], first["documents"], first["changed"], first["skipped"]) == (3, 1, 2, 2, False)
    second = engine.ingest()
    assert second["skipped"] and second["changed"] == 0 and second["chunks"] == first["chunks"]
    (tmp_path / "corpus" / "c.txt").unlink()
    (tmp_path / "corpus" / "d.txt").write_text("Sleep helps recovery after illness.")
    third = engine.ingest()
    assert (third["changed"], third["deleted"], third["from_cache"], third["skipped"]) == (1, 1, 1, False)
    assert {r.source_id for r in engine.sources().collect()} == {"a.txt", "d.txt"}


def test_diet_questions(make, tmp_path):
    engine = make({"stroke.txt": STROKE, "diet.txt": DIET}, incremental=False)
    engine.ingest()
    patient = engine.ask("What foods should I eat?")
    clinician = engine.ask("What foods should I eat?", mode="clinician")
    assert patient["citations"][0]["source"] == "diet.txt" and "fruits and" in patient["answer"]
    assert clinician["answer"] != patient["answer"]
    (tmp_path / "corpus" / "diet.txt").unlink()
    bare = make({"stroke.txt": STROKE}, incremental=False, index_path=engine.settings.index_path + "2")
    bare.ingest()
    refused = bare.ask("What foods should I eat?")
    assert refused["citations"] == [] and refused["answer"].startswith("I could not find")


def test_filters_threshold_and_errors(make):
    engine = make({"stroke.txt": STROKE, "diet.txt": DIET}, incremental=False)
    with pytest.raises(FileNotFoundError):
        engine.ask("stroke?")
    engine.ingest()
    only = engine.ask("stroke prevention", filters={"source_id": "diet.txt"})
    assert {c["source"] for c in only["citations"]} == {"diet.txt"}
    with pytest.raises(ValueError, match="answer_mode"):
        engine.ask("stroke", mode="research")
    with pytest.raises(ValueError):
        engine.ask("stroke", top_k=-1)
    strict = Engine(engine.spark, engine.settings.but(min_relevance_score=999.0))
    assert strict.ask("stroke")["citations"] == []
    other = Engine(engine.spark, engine.settings.but(embedding_dimensions=64))
    with pytest.raises(ValueError, match="index holds vectors of"):
        other.ask("stroke")
    with pytest.raises(FileNotFoundError):
        engine.ingest("/no/such/folder")


def test_generation_falls_back(make):
    def dead(url, payload, timeout):
        raise OSError("no service")

    engine = make({"stroke.txt": STROKE}, incremental=False, generation_backend="ollama")
    engine.backends = Backends.of(engine.settings, dead)
    engine.ingest()
    row = engine.ask("stroke rehabilitation")
    assert row["fallback"] and "no service" in row["answer"]
    assert Backends.of(engine.settings.but(embedding_backend="auto"), dead).fell_back


def test_settings():
    s = Settings.from_env({"CHUNK_SIZE": "500", "TOP_K": "", "PDF_FOLDER": "x", "RAG_TOP_K": "7", "VECTOR_DB_PATH": "db/"})
    assert (s.chunk_size_chars, s.top_k, s.source_path, s.index_path) == (500, 7, "x", "db/index")
    assert [candidate_limit(k) for k in (1, 5, 20, 80)] == [4, 20, 50, 50]
    with pytest.raises(ValueError):
        Settings(chunk_size_chars=100, chunk_overlap_chars=100)


def test_questions_leave_the_cache_alone_and_texts_are_appended_once(make, spark, tmp_path):
    engine = make({"a.txt": STROKE, "c.txt": DIET})
    engine.ingest()
    cache = lambda: spark.read.parquet(f"{tmp_path}/embeddings/vectors").count()
    assert cache() == 2
    assert engine.ask("  When should stroke rehabilitation begin?  ") == engine.ask("When should stroke rehabilitation begin?") and cache() == 2
    (tmp_path / "corpus" / "d.txt").write_text("Sleep helps recovery after illness.")
    engine.ingest()
    assert cache() == 3


def test_texts_without_a_term_are_embedded_once(make, spark, tmp_path):
    engine = make({"a.txt": STROKE, "b.txt": "?!? ..."})
    engine.ingest()
    held = lambda: sorted(len(r.buckets) > 0 for r in spark.read.parquet(f"{tmp_path}/embeddings/vectors").collect())
    assert held() == [False, True]
    engine.ingest(force=True)
    assert held() == [False, True] and engine.ask("stroke rehabilitation")["citations"][0]["source"] == "a.txt"


def test_filters_by_the_source_file_and_by_unknown_keys(make):
    engine = make({"a.txt": STROKE, "c.txt": DIET}, incremental=False)
    engine.ingest()
    ask = lambda **filters: len(engine.ask("stroke rehabilitation", filters=filters)["citations"])
    assert ask(source_size=len(STROKE), chunk_size_chars=300) == 1
    assert ask(chunk_size_chars=301) == 0 and ask(colour="red") == 0 and ask(colour=None) == ask() == 2


def test_a_folder_without_files_is_an_error(make):
    with pytest.raises(ValueError, match="No files"):
        make({"x.doc": "x"}, incremental=False).ingest()


def test_a_parser_that_hangs_or_dies_costs_its_own_file(spark, tmp_path):
    from plinth.sources import files

    def read(data, first, last):
        import os
        import time

        if data == b"hangs" and first > 64:
            time.sleep(600)
        if data == b"dies":
            os.kill(os.getpid(), 9)
        print("not an answer")
        return [{"page": p, "width": 600.0, "block_no": 0, "type": 0, "bbox": [0.0] * 4, "lines": [{"spans": [{"text": f"Page {p} by {os.getpid()}", "bbox": [0.0] * 4}]}]} for p in range(first, last + 1)]

    def count(data):
        if data == b"bad":
            raise ValueError("no pages")
        return {b"long": 2000, b"empty": 0}.get(data, 100)

    for name in ("bad", "dies", "empty", "hangs", "long", "short"):
        (tmp_path / f"{name}.pdf").write_bytes(name.encode())
    rows = files.pdf_pages(files.list_files(spark, str(tmp_path)), files.PagedParser(count, read), limit=5.0).collect()
    errors = {r.path.rpartition("/")[2]: r.error for r in rows if r.error}
    assert errors == {"bad.pdf": "ValueError: no pages", "dies.pdf": "ChildProcessError: the parser's process ended with code -9", "hangs.pdf": "TimeoutError: no result within 5 seconds"}
    assert sum(r.error is not None for r in rows) == 3
    pages = {name: sorted(r.page_number for r in rows if r.path.endswith(f"/{name}.pdf") and not r.error) for name in ("long", "short", "hangs", "empty")}
    assert pages == {"long": list(range(1, 2001)), "short": list(range(1, 101)), "hangs": [], "empty": []}
    assert len({r.text.rpartition(" ")[2] for r in rows if r.path.endswith("/long.pdf")}) > 1


def test_pages_of_a_parsed_file(spark, tmp_path):
    from plinth.sources import files

    def parse(data):
        block = lambda page, text: {"page": page, "width": 600.0, "block_no": 0, "title": None, **(files.plain_block(0, text) if text else {"type": 1, "bbox": [0.0] * 4, "lines": []})}
        if data == b"broken":
            raise OSError("no file")
        yield from (block(i + 1, t) for i, t in enumerate(["First page here", None, "References", "Later", "Last"]))

    for name, data in (("a.pdf", b"fine"), ("b.pdf", b"broken")):
        (tmp_path / name).write_bytes(data)
    rows = files.pdf_pages(files.list_files(spark, str(tmp_path)), parse).collect()
    assert sorted((r.path[-5:], r.page_number or 0, r.text, r.error) for r in rows) == [("a.pdf", 1, "First page here", None), ("a.pdf", 2, "", None), ("a.pdf", 3, "", None), ("b.pdf", 0, None, "OSError: no file")]


def test_names_from_the_environment():
    s = Settings.from_env({"RAG_GENERATION_BACKEND": "Extractive", "RAG_ANSWER_MODE": "CLINICIAN", "VECTOR_DB_PATH": "old/store.json"})
    assert (s.generation_backend, s.answer_mode, s.index_path) == ("extractive", "clinician", "old/store.json")
    assert Settings.from_env({"VECTOR_DB_PATH": "old/"}).index_path == "old/index"


def lengths(texts):
    return [[float(t.lower().count(w)) for w in ("stroke", "diet", "tulip")] for t in texts]


def test_functions_in_place_of_backends(make, spark):
    engine = make({"stroke.txt": STROKE, "garden.md": "Tulips flower in spring. One tulip is red.", "diet.txt": DIET})

    def last_first(results):
        by = Window.partitionBy("query_id").orderBy(F.desc("rank"))
        return results.withColumn("rank", F.row_number().over(by))

    def names(questions, results, settings):
        found = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "source_id"))).alias("x"))
        return questions.join(found, "query_id", "left").select("query_id", F.array_join("x.source_id", " ").alias("answer"), F.lit("names").alias("generation_model"))

    engine.backends = Backends(embedding_name="lengths", embedder=lengths, reranker=last_first, generator=names)
    assert engine.ingest()["embedding_model"] == "lengths"
    nearest = engine.search(spark.createDataFrame([(1, "stroke")], "query_id long, question string"), 3, hybrid=False)
    assert [(r.source_id, r.score) for r in nearest.orderBy("rank").collect()] == [("stroke.txt", 2.0), ("diet.txt", 1.0), ("garden.md", 0.0)]
    assert engine.ask("stroke")["answer"] == "garden.md diet.txt stroke.txt"  # fused scores are above 0 for all; the last one comes first
    with pytest.raises(ValueError):
        Backends(embedder=lengths)
