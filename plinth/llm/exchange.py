"""Shuffling large arrays of numbers as packed blobs.

Millions of (key, value) pairs travel as a few binary rows for each bucket of keys, so that the row-at-a-time cost of a
shuffle is paid for each blob instead of each pair, and numpy sorts and groups them. Spark still deals the rows out,
spills and retries them. The number of buckets is spark.sql.shuffle.partitions, or more where the input's files are too
large for it; a task holds one bucket. Packers pre-aggregate before pairs travel where the caller says how.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from plinth.runtime import input_bytes, release, shuffle_partitions

#: Pairs that a packer holds before it passes them on.
HELD = 500_000


#: Bytes of input files for each bucket at most: a bucket's pairs take a few times as many bytes in its task.
BUCKET_BYTES = 128 << 20


def n_buckets(rows: DataFrame) -> int:
    """spark.sql.shuffle.partitions, or more if the files that rows are read from are too large for so few buckets."""
    return max(shuffle_partitions(rows.sparkSession), -(-input_bytes(rows) // BUCKET_BYTES))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """By the upper 32 bits; the lower 32 are left to tell the keys of a bucket apart."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.uint16 if n <= 1 << 16 else np.uint32)


def schema(columns: int) -> str:
    return "bucket int, " + ", ".join(f"c{i} binary" for i in range(columns))


class Packer:
    """Gathers aligned arrays and deals them out by bucket. settle: pre-aggregates what was gathered before it travels. It takes the
    buckets and columns and returns those that travel, and (keys, columns) that are settled already: these go straight to the
    bucket of the next exchange, so that a key that very many rows have sends a few entries for each packer."""

    def __init__(self, n: int, settle: Callable[..., tuple] | None = None, held: int = HELD) -> None:
        self.n, self.settle, self.most = n, settle, held
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, keys: np.ndarray, *columns: np.ndarray) -> list[pa.RecordBatch]:
        """keys decide the bucket; they don't travel unless they are among the columns."""
        if len(keys):
            self.parts.append((bucket_of(keys, self.n), *columns))
            self.held += len(keys)
        return self.flush() if self.held >= self.most else []

    def flush(self) -> list[pa.RecordBatch]:
        if not self.held:
            return []
        buckets, *columns = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        out = []
        if self.settle:
            (buckets, *columns), (keys, *settled) = self.settle(buckets, *columns)
            if len(keys):
                out.append(_batch(bucket_of(keys, self.n), settled, len(columns)))
        return [_batch(buckets, columns, len(columns)), *out]


def _batch(buckets: np.ndarray, columns: list[np.ndarray], width: int) -> pa.RecordBatch:
    """A row for each bucket. Settled blobs have fewer columns than others: the last ones are null."""
    order = np.argsort(buckets, kind="stable")
    buckets = buckets[order]
    starts, ends = groups(buckets)
    blobs = [pa.array([c[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()) for c in (x[order] for x in columns)]
    blobs += [pa.nulls(len(starts), pa.binary())] * (width - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(buckets[starts].astype(np.int32)), *blobs], ["bucket"] + [f"c{i}" for i in range(width)])


def set_aside(batches: Iterator[pa.RecordBatch], width: int, open_ones: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes settled blobs (of ``width`` columns) on as they are, and puts the others into open_ones."""
    for batch in batches:
        is_open = batch.column(batch.num_columns - 1).is_valid()
        open_ones.append(batch.filter(is_open))
        done = batch.filter(pc.invert(is_open))
        if done.num_rows:
            yield pa.RecordBatch.from_arrays(done.columns[: width + 1], ["bucket"] + [f"c{i}" for i in range(width)])


def unpack(batches: Iterator[pa.RecordBatch], *kinds: type) -> list[np.ndarray]:
    """All blobs of a task, column by column; the bucket is column 0 of each batch."""
    release()
    found: list[list[bytes]] = [[] for _ in kinds]
    for batch in batches:
        for i in range(len(kinds)):
            found[i] += batch.column(i + 1).to_pylist()  # copies, so that the batch's own memory goes
    out = []
    for blobs, kind in zip(found, kinds, strict=True):
        out.append(np.frombuffer(b"".join(blobs), kind))
        blobs.clear()
    return out


def deal(blobs: DataFrame, n: int) -> DataFrame:
    """One partition for each bucket."""
    return blobs.repartitionById(n, "bucket")


def groups(*sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of equal keys."""
    n = len(sorted_keys[0])
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], n)
