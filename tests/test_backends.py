"""Calls of services: order, bounded concurrency, tries, and answers when some of them fail."""

import threading
import time

import pytest

from plinth.plans import backends
from plinth.plans.backends import Backends, embed_texts, in_order, patiently
from plinth.plans.engine import Engine
from plinth.settings import Settings


def test_results_come_in_order_and_few_calls_are_open():
    lock, now, most = threading.Lock(), [0], [0]

    def call(x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.05 if x % 3 else 0.15)
        with lock:
            now[0] -= 1
        return x * 2

    began = time.time()
    assert list(in_order(call, range(24), 4)) == [2 * x for x in range(24)]
    assert 2 <= most[0] <= 4 and time.time() - began < 24 * 0.08
    assert list(in_order(call, [], 4)) == []
    with pytest.raises(ZeroDivisionError):
        list(in_order(lambda x: 1 // x, [1, 0, 2], 2))


def test_tries(monkeypatch):
    waits, seen = [], []
    monkeypatch.setattr(backends.time, "sleep", waits.append)

    def busy(x):
        seen.append(x)
        if len(seen) < 3:
            raise OSError("busy")
        return x

    assert patiently(busy, 7) == 7 and waits == [0.25, 0.5]
    with pytest.raises(OSError, match="gone"):
        patiently(lambda: (_ for _ in ()).throw(OSError("gone")))


def test_embeddings_of_a_service():
    def old(url, payload, timeout):
        if url.endswith("/api/embed"):
            raise OSError("404")
        return {"embedding": [3.0, 4.0] if payload["prompt"] == "a" else [0.0, 0.0]}

    new = lambda url, payload, timeout: {"embeddings": [[0.0, 2.0]] * len(payload["input"])}
    assert embed_texts(["a", "b"], "u", "m", 1.0, old) == [[0.6, 0.8], [0.0, 0.0]]
    assert embed_texts(["a", "b"], "u", "m", 1.0, new) == [[0.0, 1.0]] * 2


def test_a_service_that_fails_for_some_questions(spark, tmp_path):
    folder = tmp_path / "corpus"
    folder.mkdir()
    for name, text in (("stroke.txt", "Stroke rehabilitation should begin early."), ("garden.txt", "Tulips flower in spring.")):
        (folder / name).write_text(text)

    def transport(url, payload, timeout):
        if url.endswith("/api/embed"):
            return {"embeddings": [[float("stroke" in t.lower()), float("tulip" in t.lower()), 1.0] for t in payload["input"]]}
        if "tulips" in payload["messages"][1]["content"].split("Question: ")[1].split("\n")[0]:
            raise OSError("no answer")
        return {"message": {"content": " Early [1]. "}}

    settings = Settings(source_path=str(folder), index_path=str(tmp_path / "index"), embedding_backend="ollama", generation_backend="ollama", embedding_batch_size=1)
    engine = Engine(spark, settings, Backends.of(settings, transport))
    assert engine.ingest()["embedding_model"] == "ollama:nomic-embed-text"
    asked = spark.createDataFrame([(1, "When should stroke rehabilitation begin?"), (2, "When do tulips flower?")], "query_id long, question string")
    got = {r.query_id: r for r in engine.ask_batch(asked, 1).collect()}
    assert got[1].answer == "Early [1]." and not got[1].fallback and got[1].citations[0].source == "stroke.txt"
    assert got[2].fallback and "no answer" in got[2].answer and got[2].citations[0].source == "garden.txt"
