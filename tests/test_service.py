"""The REST service: addresses, bodies, errors, background ingestion, a real socket."""

import json
import threading
import time
import urllib.request

import pytest

from plinth import service as rest
from plinth.plans.engine import Engine
from plinth.settings import Settings

TEXT = "Stroke rehabilitation should begin early. Patients with stroke benefit from mobilisation within days."


@pytest.fixture
def service(spark, tmp_path):
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "stroke.txt").write_text(TEXT)
    settings = Settings(source_path=str(tmp_path / "corpus"), index_path=str(tmp_path / "index"), embedding_backend="hash")

    def nobody(*_):
        raise OSError("no service")

    return rest.Service(Engine(spark, settings), nobody)


def post(service, path, **body):
    return service.handle("POST", path, json.dumps(body).encode())


def test_errors(service, tmp_path):
    assert service.handle("GET", "/health")[1] | {"index_path": 0, "corpus_dir": 0} == {"status": "ok", "index_exists": False, "index_path": 0, "corpus_dir": 0, "embedding_backend": "hash", "generation_backend": "extractive", "ollama_available": False}
    assert service.handle("GET", "/sources")[0] == 409 and post(service, "/ask", question="stroke?")[0] == 409
    assert post(service, "/ingest", source_path=str(tmp_path / "none"))[0] == 400
    assert service.handle("GET", "/nowhere")[0] == 404 and service.handle("GET", "/ask")[0] == 405
    assert service.handle("POST", "/ask", b"{")[0] == 422 and service.handle("POST", "/ask", b"[]")[0] == 422
    bad = [{}, {"question": ""}, {"question": "x" * 4001}, {"question": 3}, {"question": "q", "top_k": 0}, {"question": "q", "top_k": 21}, {"question": "q", "top_k": True}, {"question": "q", "filters": {"page": 1}}, {"question": "q", "answer_mode": "poet"}]
    assert [post(service, "/ask", **b)[0] for b in bad] == [422] * len(bad)
    assert post(service, "/ingest", pdf_workers=33)[0] == 422 and post(service, "/ingest", force="yes")[0] == 422
    assert service.handle("GET", "/")[0] == 200 and not service.status(b"")["running"]


def test_ingest_in_the_background_and_ask(service):
    release, whole = threading.Event(), service.engine.ingest

    def slow(**given):
        release.wait(60)
        return whole(**given)

    service.engine.ingest = slow
    assert post(service, "/ingest", background=True) == (200, {"accepted": True, "status": "/ingest/status"})
    assert post(service, "/ingest", background=True)[0] == 409 and service.handle("GET", "/ingest/status")[1]["running"]
    release.set()
    until = time.time() + 120
    while service.status(b"")["running"] and time.time() < until:
        time.sleep(0.1)
    state = service.handle("GET", "/ingest/status")[1]
    assert state["last_error"] is None and state["last_report"]["documents"] == 1 and state["finished_at"] >= state["started_at"]
    status, answer = post(service, "/ask", question="When should stroke rehabilitation begin?", top_k=2, filters={"source_id": "stroke.txt"})
    assert status == 200 and answer["citations"][0]["source"] == "stroke.txt"
    assert post(service, "/ask", question="   ")[0] == 400
    assert [r["source_id"] for r in service.handle("GET", "/sources")[1]] == ["stroke.txt"]
    assert post(service, "/ingest", source_path="/nowhere/at/all", background=True)[0] == 200
    while service.status(b"")["running"] and time.time() < until:
        time.sleep(0.1)
    assert "nowhere" in service.status(b"")["last_error"]


def test_over_a_socket(service):
    with rest.server(service, port=0) as running:
        threading.Thread(target=running.serve_forever, daemon=True).start()
        at = f"http://127.0.0.1:{running.server_address[1]}"
        with urllib.request.urlopen(f"{at}/health", timeout=30) as found:
            assert json.load(found)["status"] == "ok"
        with pytest.raises(urllib.error.HTTPError) as refused:
            urllib.request.urlopen(urllib.request.Request(f"{at}/ask", data=b"{}", method="POST"), timeout=30)
        assert refused.value.code == 422 and "question" in json.load(refused.value)["detail"]
        running.shutdown()
