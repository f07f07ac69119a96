"""A file stream as a trigger of ingestion. The manifest stays the source of truth: the stream only tells that files came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plinth.plans.engine import Engine
from plinth.sources.tables import Conflict, Log


def watch(engine: Engine, path: str, checkpoint: str, continuous: bool = False) -> StreamingQuery:
    """Runs ingest() once for all files that came since the last run, or for each batch of them if continuous. A batch that Spark gives out
    again after a failure is known by its number, which is put into a log beside the checkpoint when its ingestion is over; if the
    failure came before that, the manifest shows that nothing has changed."""
    spark, done = engine.spark, Log(engine.spark, f"{checkpoint.rstrip('/')}.batches")
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path).select("path")

    def arrived(batch: DataFrame, number: int) -> None:
        last = done.current()
        if (last and last["batch"] >= number) or batch.isEmpty():
            return
        engine.ingest(path)
        try:
            done.commit(last, {"batch": number, "folders": []})
        except Conflict:  # another run of the same stream was faster with the same batch
            if done.current()["batch"] < number:
                raise

    writer = files.writeStream.foreachBatch(arrived).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="10 seconds") if continuous else writer.trigger(availableNow=True)).start()


def sync(engine: Engine, path: str, checkpoint: str) -> dict:
    """One pass of watch() to its end, and what ingest() says then: files that only went make no batch, so it looks for itself."""
    watch(engine, path, checkpoint).awaitTermination()
    return engine.ingest(path)
