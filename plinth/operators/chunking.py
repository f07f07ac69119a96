"""From sections to overlapping chunks of whole sentences."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from plinth.functions import rules
from plinth.functions import text as T
from plinth.settings import CHUNKING_STRATEGY, Settings


def windows_of(text: str, size: int, overlap: int) -> Iterator[str]:
    """Slices of one over-long sentence. A slice ends at its last space if that lies beyond 0.6 of it."""
    at = 0
    while True:
        stop = at + size
        if stop < len(text):
            space = text.rfind(" ", at, stop)
            stop = space if space - at > int(size * 0.6) else stop
        piece = text[at:stop].strip()
        if piece:
            yield piece
        if stop >= len(text):
            return
        at = max(stop - overlap, at + 1)


def pack(sentences: list[str], size: int, overlap: int) -> list[str]:
    """Chunks of consecutive sentences up to ``size``; each begins with the longest run of the chunk before that fits ``overlap``.

    Sentences that fit are numbered in order; the open chunk is a range of them, and prefix sums of their lengths tell the
    length of any range, so no text is joined before it is given out."""
    fitting = [s for s in sentences if len(s) <= size]
    ends = [0, *accumulate(len(s) + 1 for s in fitting)]
    length = lambda a, b: ends[b] - ends[a] - 1  # noqa: E731  of the range joined by spaces; -1 if empty
    out: list[str] = []
    start = stop = 0

    def close() -> int:
        """Gives the open chunk out; returns where its tail starts."""
        if start < stop:
            out.append(" ".join(fitting[start:stop]))
        return max(start, bisect_left(ends, ends[stop] - 1 - overlap, 0, stop + 1)) if overlap > 0 else stop

    for s in sentences:
        if len(s) > size:
            start = close()
            out += windows_of(s, size, overlap)
            continue
        if length(start, stop + 1) > size:
            start = close()
            while length(start, stop + 1) > size:
                start += 1
        stop += 1
    close()
    return out


@F.arrow_udf(S.ArrayType(S.StringType()))
def _packed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for rows, sizes, overlaps in batches:
        yield pa.array([pack(r.as_py() or [], s.as_py(), o.as_py()) for r, s, o in zip(rows, sizes, overlaps, strict=True)], pa.list_(pa.string()))


def packed(text: Column, size: Column, overlap: int) -> Column:
    """The pieces of a text. Packing carries a state from sentence to sentence, which no built-in expression does in linear time."""
    return _packed(T.sentences(text), size.cast("int"), F.lit(overlap))


def split_text(text: Column, size: int, overlap: int) -> Column:
    """Without sections: for texts whose lines are cleaned."""
    return packed(text, F.lit(size), overlap)


def chunks(segments: DataFrame, settings: Settings) -> DataFrame:
    """chunk_id, chunk_ord (order in the corpus: source, then index), text and the chunk's metadata columns."""
    prefix = F.when(F.col("section") != "", F.concat(F.lit("Section: "), "section", F.lit("\n\n"))).otherwise(F.lit(""))
    limit = F.greatest(F.lit(rules.BODY_FLOOR), settings.chunk_size_chars - F.length("prefix"))
    rows = segments.withColumn("prefix", prefix).withColumn("limit", limit)
    rows = rows.select("*", packed(F.col("text"), F.col("limit"), settings.chunk_overlap_chars).alias("pieces"))
    # Outer, and filtered behind: else each text would be packed a second time to see that it has pieces.
    rows = rows.select("*", F.posexplode_outer("pieces").alias("piece_no", "piece")).where("piece is not null")
    order = Window.partitionBy("source_id").orderBy("seg_id", "piece_no")
    rows = rows.withColumn("chunk_index", F.row_number().over(order)).withColumn("chunk_text", F.concat("prefix", "piece"))
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("source_path", "page_start", "page_end", "section")]
    raw = F.concat_ws(":", *shown, F.col("chunk_index").cast("string"), F.substring("chunk_text", 1, 120))
    page_range = F.when(~F.col("page_start").eqNullSafe(F.col("page_end")), F.concat(F.coalesce(F.col("page_start").cast("string"), F.lit("None")), F.lit("-"), F.coalesce(F.col("page_end").cast("string"), F.lit("None"))))
    return rows.select(
        F.substring(F.sha2(raw, 256), 1, 24).alias("chunk_id"), F.struct("source_ord", "chunk_index").alias("chunk_ord"), F.col("chunk_text").alias("text"),
        "source_id", "source_path", "title", F.col("page_start").alias("page"), "page_start", "page_end", page_range.alias("page_range"), "section", "chunk_index",
        F.lit(CHUNKING_STRATEGY).alias("chunking_strategy"),
    )
