"""A small REST service over an Engine, on the standard library alone.

``Service.handle`` answers a request without a socket: (method, path, body) -> (status, payload). 400 is an error of the engine, 404
and 405 an unknown address or method, 409 a missing index or an ingestion that already runs, 422 a body that doesn't fit, 500 anything
else. Requests only plan Spark jobs; their work runs on the cluster.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark import inheritable_thread_target

from plinth.plans.backends import Transport, http
from plinth.plans.engine import Engine
from plinth.plans.ledger import Busy, Ledger
from plinth.settings import ANSWER_MODES

#: A larger body is refused unread.
BODY_BYTES = 1 << 20


class Refused(Exception):
    def __init__(self, status: int, detail: str) -> None:
        super().__init__(detail)
        self.status = status


def is_int(x: Any, least: int, most: int) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and least <= x <= most


#: Fields of a body: what their values must be. All but the question may be left out; null means left out where the default is null.
ASK: dict[str, Callable[[Any], bool]] = {
    "question": lambda x: isinstance(x, str) and 1 <= len(x) <= 4000,
    "top_k": lambda x: x is None or is_int(x, 1, 20),
    "filters": lambda x: x is None or (isinstance(x, dict) and all(isinstance(v, str) for v in x.values())),
    "answer_mode": lambda x: x is None or x in ANSWER_MODES,
}
INGEST: dict[str, Callable[[Any], bool]] = {
    "source_path": lambda x: x is None or isinstance(x, str),
    "force": lambda x: isinstance(x, bool),
    "resume": lambda x: isinstance(x, bool),
    "failed_only": lambda x: isinstance(x, bool),
    "ocr_scanned": lambda x: isinstance(x, bool),
    "pdf_workers": lambda x: x is None or is_int(x, 1, 32),
    "background": lambda x: isinstance(x, bool),
}


def checked(body: bytes, fields: dict[str, Callable[[Any], bool]], needed: tuple[str, ...] = ()) -> dict[str, Any]:
    try:
        found = json.loads(body or b"{}")
    except ValueError:
        raise Refused(422, "The body is not JSON") from None
    if not isinstance(found, dict):
        raise Refused(422, "The body is not an object")
    wrong = [k for k, fits in fields.items() if (k in found or k in needed) and not fits(found.get(k))]
    if wrong:
        raise Refused(422, f"Fields that are missing or don't fit: {', '.join(wrong)}")
    return {k: v for k, v in found.items() if k in fields}


class Service:
    def __init__(self, engine: Engine, probe: Transport = http) -> None:
        self.engine, self.probe = engine, probe
        self.worker, self.ledger = ThreadPoolExecutor(1), Ledger(engine.spark, engine.settings.index_path)
        self.routes = {("GET", "/"): self.root, ("GET", "/health"): self.health, ("POST", "/ingest"): self.ingest, ("GET", "/ingest/status"): self.status, ("POST", "/ask"): self.ask, ("GET", "/sources"): self.sources}

    def handle(self, method: str, path: str, body: bytes = b"") -> tuple[int, Any]:
        path = path.partition("?")[0]
        path = path.rstrip("/") or "/"
        route = self.routes.get((method, path))
        try:
            if route is None:
                raise Refused(405 if any(p == path for _, p in self.routes) else 404, f"No {method} {path} here")
            return 200, route(body)
        except Refused as refused:
            return refused.status, {"detail": str(refused)}
        except FileNotFoundError as missing:
            return 400 if path == "/ingest" else 409, {"detail": str(missing)}
        except (RuntimeError, ValueError) as wrong:
            return 400, {"detail": str(wrong)}
        except Exception as broken:  # the service goes on
            return 500, {"detail": f"{type(broken).__name__}: {broken}"}

    def root(self, body: bytes) -> dict:
        return {"service": "plinth", "addresses": sorted(f"{m} {p}" for m, p in self.routes)}

    def health(self, body: bytes) -> dict:
        s = self.engine.settings
        try:
            self.probe(f"{s.ollama_url}/api/tags", None, 2.0)
            reachable = True
        except Exception:
            reachable = False
        return {"status": "ok", "index_exists": self.engine.index_exists(), "index_path": s.index_path, "corpus_dir": s.source_path, "embedding_backend": s.embedding_backend, "generation_backend": s.generation_backend, "ollama_available": reachable}

    def ingest(self, body: bytes) -> dict:
        """One ingestion of an index at a time, in the background or not, by this process or another; its outcome is under /ingest/status."""
        asked = checked(body, INGEST)
        given = {"path": asked.get("source_path"), "force": asked.get("force", False), "resume": asked.get("resume", True), "failed_only": asked.get("failed_only", False)}
        try:
            run = self.ledger.begin()
        except Busy as busy:
            raise Refused(409, str(busy)) from None
        if not asked.get("background", False):
            return self._ingest(run, given)
        self.worker.submit(inheritable_thread_target(self.engine.spark)(self._ingest), run, given)
        return {"accepted": True, "status": "/ingest/status"}

    def _ingest(self, run: str, given: dict) -> dict:
        with self.ledger.held(run) as out:
            out["report"] = self.engine.ingest(**given)
        return out["report"]

    def status(self, body: bytes) -> dict:
        return self.ledger.status()

    def ask(self, body: bytes) -> dict:
        asked = checked(body, ASK, ("question",))
        return self.engine.ask(asked["question"], asked.get("top_k"), asked.get("filters"), asked.get("answer_mode"))

    def sources(self, body: bytes) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.engine.sources().collect()]


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """Not started yet: serve_forever() does it. Port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > BODY_BYTES:
                self.close_connection = True
                status, found = 413, {"detail": "The body is too large"}
            else:
                status, found = service.handle(self.command, self.path, self.rfile.read(size))
            data = json.dumps(found, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = answer

        def log_message(self, format: str, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(engine: Engine, host: str, port: int, ingest_first: bool = False) -> None:
    """Until interrupted. ingest_first: without an index, build it in the background."""
    service = Service(engine)
    if ingest_first and not engine.index_exists():
        service.handle("POST", "/ingest", b'{"background": true}')
    server(service, host, port).serve_forever()
