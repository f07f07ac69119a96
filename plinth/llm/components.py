"""Connected components of a table of links, by large-star and small-star steps.

Every step aggregates partially by node before it shuffles and joins back with plain joins, which adaptive execution can
split at a hot node. Each round is written to the shared folder, so a lost executor costs one round at most; nothing is
gathered by the driver but two numbers a round. The number of rounds grows with the logarithm of the longest path. Links that
are counted to be at most ``FEW_LINKS`` are merged by one task instead, which spares them the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.runtime import discard, materialise


#: 2 MB of numbers.
FEW_LINKS = 100_000


def connected_components(links: DataFrame) -> DataFrame:
    """links: (a, b) longs, either way round, repeated or not, as a table that is cheap to read twice. Returns (node, component) for
    every node that has a link to another; component is the smallest node that is reachable."""
    if links.count() <= FEW_LINKS:
        return links.select("a", "b").coalesce(1).mapInArrow(_merge, "node long, component long")
    edges = materialise(_down(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "links")
    before = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _down(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = materialise(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        small = materialise(_down(small), "links")
        discard(edges, large)
        edges, after = small, _mark(small)
        if after == before:
            break
        before = after
    children = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return children.union(children.select(F.col("component").alias("node"), "component").distinct())


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node to the smaller."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if a != b:
                x, y = top(a), top(b)
                above[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(above), pa.int64()), pa.array([top(x) for x in list(above)], pa.int64())], ["node", "component"])
