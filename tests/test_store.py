"""Versions, deltas, segments, blocks: what the index and the caches are stored by."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from plinth.operators import lexical
from plinth.plans.engine import Engine
from plinth.settings import Settings
from plinth.sources import segments
from plinth.sources.tables import Conflict, DeltaTable, Log

WORDS = ["stroke", "care", "diet", "salt", "walk", "early", "risk", "sleep", "speech", "blood"]


def test_one_of_two_writers_is_first(spark, tmp_path):
    """Eight threads put the same version; one gets it, and its record is whole."""
    log = Log(spark, str(tmp_path / "root"))
    assert log.current() is None
    gate, won, lost = threading.Barrier(8), [], []

    def write(i):
        gate.wait()
        try:
            won.append(log.commit(None, {"who": i, "folders": []})["who"])
        except Conflict:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 7 and log.current()["who"] == won[0] and log.current()["version"] == 1
    assert [x for x in log.store.names("log") if not x.endswith(".crc")] == ["000000000001.json"]
    log.commit(log.current(), {"who": "next", "folders": []})
    assert Log(spark, str(tmp_path / "root")).current()["version"] == 2


def rows_of(spark, values):
    return spark.createDataFrame([(k, v) for k, v in values], "key int, value string")


def test_deltas_of_writers_at_the_same_time(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path / "t"), "key int, value string", ["key"])
    assert table.read().collect() == [] and not table.exists()
    table.append(rows_of(spark, [(1, "a"), (2, "b"), (2, "c")]))
    threads = [threading.Thread(target=table.append, args=(rows_of(spark, [(10 + i, "x"), (1, f"new {i}")]),)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    found = sorted((r.key, r.value[:3]) for r in table.read().collect())
    assert found == [(1, "new"), (2, "b"), (2, "c"), (10, "x"), (11, "x"), (12, "x")]
    table.append(rows_of(spark, []))  # nothing to add: no version
    assert table.log.current()["version"] == 4


def test_deltas_are_merged_and_vacuumed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(DeltaTable, "MOST_PARTS", 3)
    table = DeltaTable(spark, str(tmp_path / "t"), "key int, value string", ["key"])
    for i in range(5):
        table.append(rows_of(spark, [(i % 3, f"v{i}")]))
    assert sorted(map(tuple, table.read().collect())) == [(0, "v3"), (1, "v4"), (2, "v2")]
    parts = table.log.current()["parts"]
    assert len(parts) <= 3
    gone = table.log.vacuum(keep=1, older_than=0)
    assert len(gone) >= 3 and sorted(map(tuple, table.read().collect())) == [(0, "v3"), (1, "v4"), (2, "v2")]
    assert table.log.vacuum(keep=1, older_than=0) == []


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(5)
    folder = tmp_path / "corpus"
    folder.mkdir()
    write = lambda name: (folder / name).write_text(" ".join(rng.choice(WORDS).capitalize() + " " + " ".join(rng.choices(WORDS, k=9)) + "." for _ in range(12)))

    def engine(index="index", **changes):
        values = {"source_path": str(folder), "index_path": str(tmp_path / index), "embedding_backend": "md5", "chunk_size_chars": 300, "chunk_overlap_chars": 40}
        values |= {"manifest_path": str(tmp_path / "manifest"), "extraction_cache_path": str(tmp_path / "extracted"), "cache_path": str(tmp_path / "embeddings")}
        return Engine(spark, Settings(**(values | changes)))

    for i in range(12):
        write(f"{i:02d}.txt")
    return folder, write, engine


ASKED = [(1, "early stroke care"), (2, "salt diet risk"), (3, "sleep and speech walk"), (4, "nothing known"), (5, "")]


def answers(spark, engine, **kw):
    asked = spark.createDataFrame(ASKED, "query_id long, question string")
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score, r.source_id) for r in engine.search(asked, 5, **kw).collect())


def test_changes_are_segments_and_give_the_answers_of_a_full_build(spark, corpus, tmp_path):
    folder, write, make = corpus
    engine = make()
    first = engine.ingest()
    (folder / "05.txt").unlink()
    write("03.txt")
    write("20.txt")
    (folder / "21.txt").write_text((folder / "07.txt").read_text())  # a copy
    second = engine.ingest()
    assert (second["changed"], second["deleted"], second["duplicates"], second["from_cache"], second["documents"]) == (2, 1, 1, 10, 12)
    record = engine.index.log.current()
    assert record["version"] == 2 and len(record["segments"]) == 2 and record["segments"][0]["n"] < record["segments"][0]["rows"] == first["chunks"]
    added = spark.read.parquet(f"{engine.index.log.root}/{record['segments'][1]['folder']}/chunks")
    assert {r.source_id for r in added.select("source_id").distinct().collect()} == {"03.txt", "20.txt"}
    full = make("full", manifest_path=None, extraction_cache_path=None, cache_path=None)
    assert full.ingest()["chunks"] == second["chunks"]
    assert answers(spark, engine) == answers(spark, full)
    only = {"source_id": "03.txt"}
    assert answers(spark, engine, filters=only) == answers(spark, full, filters=only) != []
    snapshot = engine.index.snapshot()
    assert (snapshot.n, snapshot.average) == (full.index.snapshot().n, full.index.snapshot().average)
    # The first of a pair of copies goes: the other one takes its place.
    (folder / "07.txt").unlink()
    (folder / "00a.txt").write_text((folder / "09.txt").read_text())  # and a copy that comes before its original
    third = engine.ingest()
    assert (third["changed"], third["deleted"], third["duplicates"]) == (2, 1, 1)
    full.ingest()
    assert answers(spark, engine) == answers(spark, full)
    assert {r.source_id for r in engine.sources().collect()} == {r.source_id for r in full.sources().collect()}
    assert engine.ingest()["skipped"]


def test_small_segments_are_merged(spark, corpus, monkeypatch):
    monkeypatch.setattr(segments, "MOST_SEGMENTS", 1)
    monkeypatch.setattr(segments, "SMALL_ROWS", 4)
    folder, write, make = corpus
    engine = make()
    engine.ingest()
    for name in ("01.txt", "02.txt"):
        write(name)
        engine.ingest()
        assert len(engine.index.log.current()["segments"]) == 1
    full = make("full", manifest_path=None, extraction_cache_path=None, cache_path=None)
    full.ingest()
    assert answers(spark, engine) == answers(spark, full)


def test_a_writer_that_was_second_works_its_change_out_again(spark, corpus):
    folder, write, make = corpus
    one, two = make(), make()
    one.ingest()
    write("01.txt")
    whole, late = one.index.append, []

    def slow(base, *given):
        if not late:
            late.append(1)
            write("02.txt")
            two.ingest()  # takes both changes in
        return whole(base, *given)

    one.index.append = slow
    report = one.ingest()
    assert report["skipped"] and len(late) == 1 and one.index.log.current()["version"] == 2
    full = make("full", manifest_path=None, extraction_cache_path=None, cache_path=None)
    full.ingest()
    assert answers(spark, one) == answers(spark, full)


def test_two_full_builds_at_the_same_time_leave_two_whole_versions(spark, corpus):
    _, _, make = corpus
    engines = [make("shared", manifest_path=None, extraction_cache_path=None, cache_path=None) for _ in range(2)]
    reports = []
    threads = [threading.Thread(target=lambda e=e: reports.append(e.ingest())) for e in engines]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    record = engines[0].index.log.current()
    assert record["version"] == 2 and len(record["segments"]) == 1 and {r["chunks"] for r in reports} == {record["segments"][0]["rows"]} == {engines[1].sources().agg(F.sum("chunks")).first()[0]}


def test_the_second_ask_lists_no_files_and_a_new_version_is_seen(spark, corpus):
    folder, write, make = corpus
    engine = make()
    engine.ingest()
    found = spark.sparkContext._jvm.org.apache.spark.metrics.source.HiveCatalogMetrics.METRIC_FILES_DISCOVERED()
    engine.ask("early stroke care")
    began, before = found.getCount(), engine.index.snapshot()
    planned = dict(before._planned)
    for name in segments.TABLES:
        before.stored(name).count()
    assert found.getCount() == began
    engine.ask("salt diet risk")
    assert engine.index.snapshot() is before and before._planned == planned
    (folder / "new.txt").write_text("Zebra crossing rules for zebras.")
    make().ingest()  # another engine of this process, or of another
    assert engine.index.snapshot() is not before and engine.ask("zebra crossing")["citations"][0]["source"] == "new.txt"


def test_blocks_give_the_best_of_all_scores(spark, monkeypatch):
    rng = random.Random(1)
    texts = [(f"c{i:04d}", " ".join(rng.choices(WORDS, weights=[2**j for j in range(10)], k=rng.randrange(3, 60)))) for i in range(900)]
    chunks = spark.createDataFrame(texts, "chunk_id string, text string").withColumn("n_tokens", F.size(F.split("text", " ")).cast("long"))
    asked = spark.createDataFrame([(1, "stroke care care"), (2, "blood speech"), (3, "stroke blood"), (4, "unknown"), (5, ""), (6, "blood")], "query_id long, question string")
    monkeypatch.setattr(lexical, "BLOCK", 8)
    monkeypatch.setattr(lexical, "SHARD_ROWS", 400)
    stored = lexical.blocks(lexical.postings_with_length(chunks), 900).withColumn("segment", F.lit("s")).cache()
    assert stored.agg(F.max("n")).first()[0] == 8 and stored.agg(F.sum("n")).first()[0] == lexical.postings(chunks).count()
    dead = chunks.where("chunk_id like '%7'").select(F.lit("s").alias("segment"), "chunk_id")
    gone = lexical.postings(chunks.join(dead, "chunk_id", "left_semi")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    for without in (False, True):
        rows = chunks.where("chunk_id not like '%7'") if without else chunks
        n, tokens = rows.agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
        every = lexical.bm25_scores(asked, lexical.postings(rows), rows.select("chunk_id", F.col("n_tokens").alias("dl")))
        want = {}
        for r in every.collect():
            want.setdefault(r.query_id, []).append((round(r.score, 9), r.chunk_id))
        for skip_from in (1, 10**9):
            monkeypatch.setattr(lexical, "SKIP_FROM", skip_from)
            some = lexical.block_scores(asked, stored, n, tokens / n, 10, *((dead, gone) if without else ()))
            got = {}
            for r in some.collect():
                got.setdefault(r.query_id, []).append((round(r.score, 9), r.chunk_id))
            assert got.keys() == want.keys()
            for q, scores in want.items():
                least = sorted(scores, reverse=True)[9][0]
                assert sorted(x for x in got[q] if x[0] >= least) == sorted(x for x in scores if x[0] >= least)
            if skip_from == 1 and not without:
                assert sum(map(len, got.values())) < sum(map(len, want.values()))  # blocks were left out


def test_an_ask_reads_its_terms_blocks_only(spark, tmp_path):
    words = [f"w{i:05d}" for i in range(20_000)]
    chunks = spark.createDataFrame([(f"c{i}", " ".join(words[i * 20 : i * 20 + 40]), 40) for i in range(999)], "chunk_id string, text string, n_tokens long")
    log = Log(spark, str(tmp_path / "index"))
    log.write("s", {"blocks": lexical.blocks(lexical.postings_with_length(chunks), 999).coalesce(1)}, **segments.PAGES)
    stored = spark.read.parquet(f"{log.root}/s/blocks")
    some = stored.where((F.col("term") == "w10000") | (F.col("term") == "w00003"))
    assert "Or(EqualTo(term,w10000),EqualTo(term,w00003))" in some._jdf.queryExecution().executedPlan().toString()
    plan = some._jdf.queryExecution()
    plan.toRdd().count()
    leaf = plan.executedPlan().collectLeaves().apply(0)
    given = leaf.metrics().apply("numOutputRows").value()
    assert 2 <= given <= 512 < stored.count()  # what the scan gave out before the filter: pages of 64 rows


def test_shared_words_are_scored_by_tiles(spark, monkeypatch):
    """Questions that share their words read each posting once; scores are those of the joins, ties too."""
    rng = random.Random(2)
    texts = [(f"c{i:04d}", " ".join(rng.choices(WORDS, k=rng.randrange(1, 9)))) for i in range(300)]
    chunks = spark.createDataFrame(texts, "chunk_id string, text string").withColumn("n_tokens", F.size(F.split("text", " ")).cast("long"))
    asked = spark.createDataFrame([(q, " ".join(rng.choices(WORDS, k=6))) for q in range(20)], "query_id long, question string")
    stored = lexical.blocks(lexical.postings_with_length(chunks), 300).withColumn("segment", F.lit("s")).cache()
    dead = chunks.where("chunk_id like '%7'").select(F.lit("s").alias("segment"), "chunk_id")
    gone = lexical.postings(chunks.join(dead, "chunk_id", "left_semi")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n, tokens = chunks.where("chunk_id not like '%7'").agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    monkeypatch.setattr(lexical, "TILE_SHARED", 1)
    found, tiled = [], []
    plain = lexical.tiled_topk
    monkeypatch.setattr(lexical, "tiled_topk", lambda *given: tiled.append(1) or plain(*given))
    for tile_from in (10**9, 0):
        monkeypatch.setattr(lexical, "TILE_FROM", tile_from)
        scores = lexical.block_scores(asked, stored, n, tokens / n, 10, dead, gone)
        assert len(tiled) == (tile_from == 0)
        every = {}
        for r in scores.collect():
            every.setdefault(r.query_id, []).append((round(r.score, 9), r.chunk_id))
        found.append({q: [x for x in sorted(v, reverse=True) if x[0] >= sorted(v, reverse=True)[9][0]] for q, v in every.items()})
    assert found[0] == found[1] and len(found[0]) == 20
