"""An index as segments: what one ingestion added, with rows of older segments marked as dead.

A segment is a folder with the tables chunks, vectors and blocks (of postings). A change of some files writes a segment for
these alone and a table of the rows of older segments that it voids, with their counts by term; nothing else is read or
written. A version's record holds each segment's live rows and tokens, so the corpus numbers of BM25 are sums of the record.
Small segments are merged when there are many, as in a log-structured tree: the large ones are left alone.
"""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators import lexical
from plinth.settings import INDEX_SCHEMA_VERSION
from plinth.sources.tables import Conflict, Log, new_folder

TABLES = ("chunks", "vectors", "blocks")
DEAD = {"rows": "segment string, chunk_id string", "terms": "term string, df long"}
#: Segments that an index has at most after a merger, and rows below which a segment always counts as small.
MOST_SEGMENTS, SMALL_ROWS = 8, 10_000
#: Pages of a few blocks, so that a reader of some terms skips the others.
PAGES = {"parquet.page.row.count.limit": "64"}


class Snapshot:
    """One version. Its tables are planned once, with their files' listing, and shared by all who read the version."""

    def __init__(self, spark: SparkSession, root: str, record: dict) -> None:
        self.spark, self.root, self.record = spark, root, record
        self._planned: dict[str, DataFrame] = {}
        self._lock = threading.Lock()

    @property
    def n(self) -> int:
        return sum(s["n"] for s in self.record["segments"])

    @property
    def average(self) -> float:
        return sum(s["tokens"] for s in self.record["segments"]) / self.n if self.n else 0.0

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        with self._lock:
            if name not in self._planned:
                self._planned[name] = make()
            return self._planned[name]

    def stored(self, name: str) -> DataFrame:
        """Rows of all segments, dead ones too."""
        parts = lambda: [self.spark.read.parquet(f"{self.root}/{s['folder']}/{name}").withColumn("segment", F.lit(s["folder"])) for s in self.record["segments"]]
        return self._once(name, lambda: reduce(DataFrame.unionByName, parts()))

    def _dead(self, name: str) -> DataFrame | None:
        at = [f"{self.root}/{x}/{name}" for x in self.record["dead"]]
        return self._once(f"dead {name}", lambda: self.spark.read.schema(DEAD[name]).parquet(*at)) if at else None

    @cached_property
    def dead(self) -> DataFrame | None:
        return self._dead("rows")

    @cached_property
    def dead_terms(self) -> DataFrame | None:
        return self._dead("terms")

    def live(self, name: str) -> DataFrame:
        """chunks or vectors without dead rows; with their segment."""
        rows = self.stored(name)
        return rows if self.dead is None else rows.join(self.dead, ["segment", "chunk_id"], "left_anti")

    def table(self, name: str) -> DataFrame:
        return self.live(name).drop("segment")


class Index:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.log = spark, Log(spark, root)
        self._snapshot: Snapshot | None = None
        self._lock = threading.Lock()

    def exists(self) -> bool:
        return self.log.current() is not None

    def snapshot(self) -> Snapshot:
        """The newest version. A missing index and one of another schema are errors."""
        record = self.log.current()
        if record is None:
            raise FileNotFoundError(f"There is no index under {self.log.root}: ingest first")
        if record["schema_version"] != INDEX_SCHEMA_VERSION:
            raise ValueError(f"The index under {self.log.root} has schema {record['schema_version']}; this version reads {INDEX_SCHEMA_VERSION}")
        with self._lock:
            if self._snapshot is None or self._snapshot.record != record:
                self._snapshot = Snapshot(self.spark, self.log.root, record)
            return self._snapshot

    def replace(self, tables: dict[str, DataFrame], model: str) -> dict:
        """A whole new index. Of writers at the same time the last one's stays."""
        segment = self._segment(tables)
        while True:
            try:
                return self._commit(self.log.current(), [segment], [], model)
            except Conflict:
                continue

    def append(self, base: dict, tables: dict[str, DataFrame] | None, voided: DataFrame, model: str) -> dict:
        """base: the record that the change was worked out from. tables: of new chunks; voided: source_path of files whose older chunks are
        dead. Raises Conflict if the index has changed since: what is dead has to be found anew then."""
        old = Snapshot(self.spark, self.log.root, base)
        dying = old.live("chunks").join(voided.select("source_path").distinct(), "source_path", "left_semi")
        dead = new_folder("dead")
        terms = lexical.postings(dying.select(F.concat_ws("/", "segment", "chunk_id").alias("chunk_id"), "text")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        self.log.write(dead, {"rows": dying.select("segment", "chunk_id", "n_tokens"), "terms": terms})
        counted = self.spark.read.parquet(f"{self.log.root}/{dead}/rows").groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"))
        gone = {r.segment: r for r in counted.collect()}  # a row a segment
        kept = [s | {"n": s["n"] - gone[s["folder"]].n, "tokens": s["tokens"] - gone[s["folder"]].tokens} if s["folder"] in gone else s for s in base["segments"]]
        if not tables and not any(s["n"] for s in kept):
            raise ValueError("No text could be extracted from the source files")
        record = self._commit(base, kept + ([self._segment(tables)] if tables else []), base["dead"] + [dead] * bool(gone), model)
        return self._merge(record)

    def _segment(self, tables: dict[str, DataFrame]) -> dict:
        folder = new_folder("segment")
        order = {t: tables[t] for t in TABLES}
        one = self.log.write(folder, order, {"n": F.count(F.lit(1)), "tokens": F.coalesce(F.sum("n_tokens"), F.lit(0))}, **PAGES)
        return {"folder": folder, "rows": one["n"], "n": one["n"], "tokens": one["tokens"]}

    def _commit(self, base: dict | None, segments: list[dict], dead: list[str], model: str) -> dict:
        folders = [s["folder"] for s in segments] + dead
        return self.log.commit(base, {"schema_version": INDEX_SCHEMA_VERSION, "model": model, "segments": segments, "dead": dead, "folders": folders})

    def _merge(self, record: dict) -> dict:
        """Merges small segments, and those that are mostly dead, into one. Another writer's commit makes it void: it is tried again after
        the next change."""
        by_size = sorted(record["segments"], key=lambda s: s["n"])
        small, rows = [], 0
        if len(by_size) > MOST_SEGMENTS:
            for s in by_size:
                if len(small) > 1 and s["n"] > max(2 * rows, SMALL_ROWS):
                    break
                small.append(s)
                rows += s["n"]
        small += [s for s in by_size if s not in small and s["n"] < s["rows"] / 2]
        if not small:
            return record
        chosen = {s["folder"] for s in small}
        old = Snapshot(self.spark, self.log.root, record)
        is_chosen = F.col("segment").isin(list(chosen))
        tables = {t: old.live(t).where(is_chosen).drop("segment") for t in ("chunks", "vectors")}
        tables["blocks"] = lexical.blocks(lexical.postings_with_length(tables["chunks"]), rows)
        kept, dead = [s for s in record["segments"] if s["folder"] not in chosen], []
        merged = [self._segment(tables)] if any(s["n"] for s in small) else []
        if kept and old.dead is not None:
            dying = old.stored("chunks").join(old.dead.where(~is_chosen), ["segment", "chunk_id"], "left_semi")
            terms = lexical.postings(dying.select(F.concat_ws("/", "segment", "chunk_id").alias("chunk_id"), "text")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            dead = [new_folder("dead")]
            self.log.write(dead[0], {"rows": dying.select("segment", "chunk_id", "n_tokens"), "terms": terms})
        with contextlib.suppress(Conflict):
            return self._commit(record, kept + merged, dead, record["model"])
        return record
