"""Runs of an index: the ledger, the service's conflicts, the stream's batches, the command line."""

import json
import threading
import time

import pytest

from plinth import cli
from plinth import service as rest
from plinth.plans.engine import Engine
from plinth.plans.ledger import Busy, Ledger
from plinth.settings import Settings
from plinth.streaming import ingest as streaming

TEXT = "Stroke rehabilitation should begin early. Patients with stroke benefit from mobilisation within days."


def test_one_run_at_a_time_and_stale_ones_are_taken_over(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "index"), lease=2.0)
    assert ledger.status()["running"] is False
    run = ledger.begin()
    with pytest.raises(Busy):
        ledger.begin()
    again = Ledger(spark, str(tmp_path / "index"), lease=2.0)  # after a restart
    assert again.status()["running"]
    for _ in range(3):
        time.sleep(1)
        ledger.beat(run)
    with pytest.raises(Busy):
        again.begin()
    time.sleep(2.5)  # no sign of life
    assert again.status() | {"started_at": 0} == {"running": False, "started_at": 0, "finished_at": None, "last_report": None, "last_error": "The run gave no sign of life any more"}
    other = again.begin()
    assert not ledger.end(run, {"late": True}) and again.status()["running"]
    assert again.end(other, {"chunks": 3}) and ledger.status()["last_report"] == {"chunks": 3}
    with pytest.raises(OSError), ledger.held(ledger.begin()):
        raise OSError("disk")
    assert ledger.status()["last_error"] == "disk" and not ledger.status()["running"]


def test_only_one_of_many_begins(spark, tmp_path):
    gate, begun = threading.Barrier(6), []

    def start():
        ledger = Ledger(spark, str(tmp_path / "index"))
        gate.wait()
        try:
            begun.append(ledger.begin())
        except Busy:
            pass

    threads = [threading.Thread(target=start) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(begun) == 1


@pytest.fixture
def engine(spark, tmp_path):
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "stroke.txt").write_text(TEXT)
    values = {"source_path": str(tmp_path / "corpus"), "index_path": str(tmp_path / "index"), "embedding_backend": "md5", "manifest_path": str(tmp_path / "manifest"), "extraction_cache_path": str(tmp_path / "extracted")}
    return Engine(spark, Settings(**values))


def test_a_foreground_run_is_refused_while_another_runs(engine):
    def nobody(*_):
        raise OSError("no service")

    service, gate, whole = rest.Service(engine, nobody), threading.Event(), engine.ingest

    def slow(**given):
        gate.wait(60)
        return whole(**given)

    engine.ingest = slow
    assert service.handle("POST", "/ingest", b'{"background": true}')[0] == 200
    assert service.handle("POST", "/ingest", b"{}")[0] == 409 and rest.Service(engine, nobody).handle("POST", "/ingest", b"{}")[0] == 409
    gate.set()
    until = time.time() + 120
    while service.status(b"")["running"] and time.time() < until:
        time.sleep(0.2)
    after = rest.Service(engine, nobody)  # a new process sees how it ended
    assert after.status(b"")["last_report"]["documents"] == 1 and after.status(b"")["last_error"] is None
    status, report = after.handle("POST", "/ingest", b"{}")
    assert status == 200 and report["skipped"] and after.status(b"")["last_report"]["skipped"]


def test_batches_are_ingested_once(engine, tmp_path):
    corpus, checkpoint, seen, whole = tmp_path / "corpus", str(tmp_path / "stream"), [], engine.ingest

    def counted(path):
        report = whole(path)
        seen.append((report["changed"], report["deleted"], report["skipped"]))
        return report

    engine.ingest = counted
    streaming.watch(engine, str(corpus), checkpoint).awaitTermination()
    assert seen == [(1, 0, False)]
    (corpus / "diet.txt").write_text("Less salt supports prevention after stroke.")
    (corpus / "stroke.txt").unlink()
    streaming.watch(engine, str(corpus), checkpoint).awaitTermination()
    assert seen[1:] == [(1, 1, False)] and engine.sources().count() == 1
    # The last batch again, as after a failure before Spark noted its end.
    (tmp_path / "stream" / "commits" / "1").unlink()
    (tmp_path / "stream" / "commits" / ".1.crc").unlink(missing_ok=True)
    streaming.watch(engine, str(corpus), checkpoint).awaitTermination()
    assert len(seen) == 2
    (corpus / "diet.txt").unlink()
    (corpus / "salt.txt").write_text("Salt.")
    assert streaming.sync(engine, str(corpus), checkpoint)["skipped"] and seen[2:] == [(1, 1, False), (0, 0, True)]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    corpus = tmp_path / "corpus"
    corpus.mkdir()
    (corpus / "stroke.txt").write_text(TEXT)
    for name in ("MANIFEST_PATH", "EXTRACTION_CACHE_DIR", "EMBEDDING_CACHE_PATH"):
        monkeypatch.setenv(f"RAG_{name}", str(tmp_path / name))
    monkeypatch.setenv("RAG_EMBEDDING_BACKEND", "hash")
    said = lambda *args: (cli.main([*args, "--index-path", str(tmp_path / "index")]), json.loads(capsys.readouterr().out))
    code, report = said("ingest", "--path", str(corpus), "--pdf-workers", "2", "--embed-batch-size", "8")
    assert code == 0 and report["documents"] == 1 and not report["skipped"]
    assert said("ingest", "--path", str(corpus))[1]["skipped"] and not said("ingest", "--path", str(corpus), "--force")[1]["skipped"]
    assert said("ask", "When should stroke rehabilitation begin?", "--top-k", "1", "--filter", "source_id=stroke.txt")[1]["citations"][0]["source"] == "stroke.txt"
    assert [r["source_id"] for r in said("sources")[1]] == ["stroke.txt"]
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
