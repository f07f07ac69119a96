"""Session helpers that every part of the library shares."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_CACHE = "_plinth_worker_cache"


def ship_package() -> None:
    """Let Python workers run this package's functions where it isn't installed: they are pickled by value."""
    cloudpickle.register_pickle_by_value(sys.modules["plinth"])


def worker_cache(key: Any, build: Callable[[], Any]) -> Any:
    """A value that is built once in each Python worker process and kept between its tasks, until another one is asked for: workers
    outlive operators, and their memory is small."""
    store = sys.modules.setdefault(_CACHE, types.ModuleType(_CACHE)).__dict__
    if store.get("key") != key:
        store.clear()
        store["value"] = build()
        store["key"] = key
    return store["value"]


def release() -> None:
    """Give the memory of worker_cache, and what allocators keep of freed memory, back to the system."""
    sys.modules.setdefault(_CACHE, types.ModuleType(_CACHE)).__dict__.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it; one of our own only in a local session without it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        at = f"file://{tempfile.mkdtemp(prefix='plinth-shared-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plinth/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it again. It outlives lost executors."""
    spark = df.sparkSession
    at = new_path(spark, name)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._plinth_path = at
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more."""
    for df in tables:
        at = getattr(df, "_plinth_path", None)
        if at:
            jvm = df.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a batch that goes to a Python worker. Texts may be long, and a batch is held several times over.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on no batch of this session for Python is larger than BATCH_BYTES; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(rows: DataFrame) -> int:
    """Of the files that rows are read from."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaf.stats().sizeInBytes())) for leaf in map(leaves.apply, range(leaves.size())) if leaf.getClass().getSimpleName() == "LogicalRelation")
