"""Joins with few rows: broadcast behind a counted bound, and beyond it bits of a fixed size that rule rows out before the rest travels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of two or three numbers that are broadcast at most (some 20 MB).
BROADCAST_ROWS = 500_000
#: Bits of the filter by which rows are ruled out: 8 MB as rows of 64 bits.
FILTER_BITS = 1 << 25


def small(df: DataFrame, rows: int) -> DataFrame:
    """A table of few columns, broadcast if ``rows``, its counted rows or a bound of them, allow it; else joins with it are dealt by key."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def parted(rows: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose id is among ids, and a few others; rows whose id surely isn't). Only bits of ids' hashes, of a bounded number, are
    broadcast."""
    bit = F.pmod(F.xxhash64(column, F.lit("bits")), F.lit(FILTER_BITS))
    word, own = F.shiftright(bit, 6).alias("sift_word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("sift_own")
    words = ids.select(word, own).groupBy("sift_word").agg(F.expr("bit_or(shiftleft(1L, sift_own))").alias("sift_bits"))
    told = rows.withColumns({"sift_word": word, "sift_own": own}).join(F.broadcast(words), "sift_word", "left")
    maybe = F.coalesce(F.expr("getbit(sift_bits, sift_own) = 1"), F.lit(False))
    return told.where(maybe).select(rows.columns), told.where(~maybe).select(rows.columns)


def maybe_among(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return parted(rows, ids, column)[0]


def among(rows: DataFrame, ids: DataFrame, n_ids: int, column: str) -> DataFrame:
    """rows joined to ids. Where ids are too many to be broadcast, the bits rule out most other rows before the shuffle."""
    if n_ids <= BROADCAST_ROWS:
        return rows.join(F.broadcast(ids), column)
    return maybe_among(rows, ids, column).join(ids, column)
