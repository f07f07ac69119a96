"""Which ingestion of an index is running, and how the last one ended: kept in the shared store, so that it outlives the process."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import SparkSession

from plinth.sources.tables import Conflict, Log

#: Seconds after its last sign of life in which a run counts as alive.
LEASE = 60.0
NOTHING: dict[str, Any] = {"running": False, "started_at": None, "finished_at": None, "last_report": None, "last_error": None}


class Busy(RuntimeError):
    """Another run holds the lease."""


class Ledger:
    """Runs as versions of a log. Who writes the next version has begun; a run that gives no sign of life for a lease's time may be taken
    over, and its own end is then ignored. The index doesn't hang on it: a run that was taken for dead still commits by versions."""

    def __init__(self, spark: SparkSession, index_path: str, lease: float = LEASE) -> None:
        self.log, self.lease = Log(spark, f"{index_path.rstrip('/')}.runs"), lease

    def _alive(self, record: dict | None) -> bool:
        if not record or not record["running"]:
            return False
        beat = f"beats/{record['run']}"
        return self.log.store.exists(beat) and self.log.store.age(beat) < self.lease

    def begin(self) -> str:
        """The name of a new run."""
        last, run = self.log.current(), uuid.uuid4().hex
        if self._alive(last):
            raise Busy("An ingestion is running")
        self.log.store.touch(f"beats/{run}")
        try:
            self.log.commit(last, NOTHING | {"run": run, "running": True, "started_at": time.time()})
        except Conflict:
            self.log.store.delete(f"beats/{run}")
            raise Busy("An ingestion has just begun") from None
        return run

    def beat(self, run: str) -> None:
        self.log.store.touch(f"beats/{run}")

    def end(self, run: str, report: dict | None = None, error: str | None = None) -> bool:
        """False if another has taken over."""
        last = self.log.current()
        if last is None or last["run"] != run or not last["running"]:
            return False
        try:
            self.log.commit(last, {k: last[k] for k in ("run", "started_at")} | {"running": False, "finished_at": time.time(), "last_report": report, "last_error": error})
        except Conflict:
            return False
        self.log.store.delete(f"beats/{run}")
        return True

    @contextmanager
    def held(self, run: str) -> Iterator[dict]:
        """Signs of life while the block runs; its result goes under "report" of the dict that it gets. What it raises is kept and raised."""
        done, out = threading.Event(), {}

        def beats() -> None:
            while not done.wait(self.lease / 4):
                self.beat(run)

        thread = threading.Thread(target=beats, daemon=True)
        thread.start()
        error = None
        try:
            yield out
        except Exception as broken:
            error = str(broken)
            raise
        finally:
            done.set()
            thread.join()
            self.end(run, out.get("report"), error)

    def status(self) -> dict:
        """A run that died without an end shows as such."""
        last = self.log.current()
        if last is None:
            return dict(NOTHING)
        shown = {k: last.get(k) for k in NOTHING}
        if last["running"] and not self._alive(last):
            shown |= {"running": False, "last_error": "The run gave no sign of life any more"}
        return shown
