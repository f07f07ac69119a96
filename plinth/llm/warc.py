"""WARC: revisit resolution and deduplicated archives.

Only headers (page, digest) are shuffled, by payload digest: of the records with one payload of at least ``min_bytes`` that
with the largest page id is the original. The digests that occur more than once are told to the rows: by broadcast if they
are counted few; else those with many copies by broadcast and the others by a join, for which a filter of fixed size rules
out most rows that occur once. The records that aren't the original become revisit records, whose blocks hold fresh headers
and no payload. Archives are written and read through Spark's own file sources, so that they can lie in any store that Spark
reaches: the text sink with CRLF CRLF between records (which is how WARC ends a record), and the binaryFile source, whose
files are unpacked and parsed record by record. ``rows_per_file`` and ``file_bytes`` bound an archive's size: large responses
lie in archives of their own, with fewer records each.

Defined results: a null payload is the empty one; a null url leaves out WARC-Target-URI; control characters and spaces of
a url are percent-encoded in headers; rows without a page id rank below all others, and if none of equal records has one
they are all responses, as are rows that equal the original in id and payload; an empty table gives no record. Only the
three named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.sift import parted
from plinth.runtime import bound_batches, materialise

#: RFC 4648 alphabet, end of line, profile of revisit records.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digests that are broadcast at most: some 100 bytes each.
BROADCAST_DIGESTS = 200_000
#: A digest with more than this share of all copies is hot; there are at most 10,000 of them.
HOT_SHARE = 1e-4
#: Bytes of payloads that a reader's task gathers before it hands them on.
READ_BYTES = 4 << 20
RECORDS = "record_type string, page_id long, refers_to long, target_uri string, payload_digest string, payload_bytes long, payload string"


def sha1_base32(payload: Column) -> Column:
    """Of 160 bits: 8 runs of 20 bits, each 4 letters."""
    hexes = F.sha1(payload)
    runs = [F.conv(F.substring(hexes, 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(r, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for r in runs for j in range(4)])


def resolve(pages: DataFrame, min_bytes: int = 0, id_column: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, bytes, refers_to, copy): refers_to is null for responses; copy tells rows apart that share page and
    payload, and is null for all others and for the one that revisits refer to."""
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", sha1_base32(F.encode("payload", "UTF-8"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    pairs = rows.groupBy("digest", "bytes", "page_id").agg(F.count(F.lit(1)).alias("n"))
    groups = pairs.groupBy("digest", "bytes").agg(F.max("page_id").alias("original"), F.sum("n").alias("n"), (F.max("n") > 1).alias("again"))
    told_of = F.struct(F.when((F.col("bytes") >= min_bytes) & (F.col("n") > 1), F.col("original")).alias("original"), "again").alias("told")
    known = materialise(groups.where("n > 1").select("digest", "n", told_of).where("told.original is not null or told.again"), "originals")
    found = told(rows, known)
    original = F.col("told.original")
    found = found.withColumns({"refers_to": F.when(~F.col("page_id").eqNullSafe(original), original), "again": F.coalesce("told.again", F.lit(False)), "is_original": F.col("page_id").eqNullSafe(original)}).drop("told")
    lone = found.where("not again").drop("again", "is_original").withColumn("copy", F.lit(None).cast("long"))
    if known.where("told.again").isEmpty():
        return lone
    # Rows that share page and payload would share a record's name, too. They are numbered in a table, so that a number stays a row's.
    twice = materialise(found.where("again").drop("again").withColumn("copy", F.monotonically_increasing_id()), "copies")
    first = twice.where("is_original").groupBy("digest").agg(F.min("copy").alias("first"))
    twice = twice.join(first, "digest", "left").withColumn("copy", F.when(~F.col("copy").eqNullSafe(F.col("first")), F.col("copy")))
    return lone.unionByName(twice.drop("is_original", "first"))


def told(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with what is told of their digest, null where nothing is. Payloads travel only where a join by digest can't be avoided."""
    size = known.agg(F.count(F.lit(1)).alias("digests"), F.sum("n").alias("copies")).first()
    if size["digests"] <= BROADCAST_DIGESTS:
        return rows.join(F.broadcast(known.select("digest", "told")), "digest", "left")
    least = HOT_SHARE * size["copies"]
    out = rows.join(F.broadcast(known.where(F.col("n") > least).select("digest", "told")), "digest", "left")
    cool = known.where(F.col("n") <= least).select("digest", F.col("told").alias("cool"))
    maybe, alone = parted(out.where("told is null"), cool, "digest")
    joined = maybe.drop("told").join(cool, "digest", "left").withColumnRenamed("cool", "told")
    return out.where("told is not null").unionByName(alone).unionByName(joined)


def record(date: str) -> Column:
    """A record of resolve()'s row, without the CRLF CRLF that ends it."""
    name = lambda page, copy: F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), F.col("digest"), copy, F.lit(">"))
    number = F.coalesce(F.concat(F.lit(":"), F.col("copy").cast("string")), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    url = F.regexp_replace(F.regexp_replace("url", "%(?![0-9A-Fa-f]{2})", "%25"), "[\\x00-\\x20\\x7f\\x85\\u2028\\u2029]", "%20")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"), number)),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to"), F.lit("")))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", rows_per_file: int = 2000, file_bytes: int = 64 << 20) -> None:
    """A folder below path for each size of responses: so many a file that their payloads have at most file_bytes, or a single one."""
    below = None
    for n in sorted({rows_per_file, min(64, rows_per_file), 1}, reverse=True):
        limit = file_bytes // n
        part = F.lit(True) if n == 1 else F.col("bytes") <= limit
        part = part | F.col("refers_to").isNotNull() if below is None else (F.col("bytes") > below) & part & F.col("refers_to").isNull()
        writer = resolved.where(part).select(record(date).alias("value")).write
        writer.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", n).text(f"{path}/of-{n}")
        below = limit


def fields_of(stream: BinaryIO) -> dict[bytes, bytes]:
    """Header fields up to the empty line."""
    found = {}
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.partition(b": ")
        found[name] = value
    return found


def page_of(name: bytes | None) -> int | None:
    at = name.strip(b"<>").removeprefix(b"urn:x-page:").split(b":")[0] if name else b""
    return int(at) if at else None


def parse(stream: BinaryIO) -> Iterator[tuple]:
    """Records of one unpacked archive, one at a time; payload digest and length are taken from the payload itself where the record
    holds it."""
    while stream.readline():  # the version
        fields = fields_of(stream)
        stream.readline()  # the block's status line
        http = fields_of(stream)
        kind = fields[b"WARC-Type"].decode()
        size = int(http[b"Content-Length"])
        if kind == "response":
            payload = stream.read(size)
            digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
        else:
            payload, digest = None, fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
        uri = fields.get(b"WARC-Target-URI")
        yield kind, page_of(fields[b"WARC-Record-ID"]), page_of(fields.get(b"WARC-Refers-To")), uri and uri.decode(), digest, size, payload
        stream.read(4)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives of a folder. payloads: whether their texts are wanted."""
    bound_batches(spark)
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        columns[-1] = [p.decode() if payloads and p is not None else None for p in columns[-1]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = pa.BufferReader(content.as_buffer())
                rows, size = [], 0
                for row in parse(gzip.GzipFile(fileobj=data) if content.as_buffer()[:2].to_pybytes() == b"\x1f\x8b" else io.BufferedReader(data)):
                    rows.append(row if payloads else (*row[:-1], None))
                    size += 100 + (row[5] if payloads and row[6] is not None else 0)
                    if size >= READ_BYTES:
                        yield table(rows)
                        rows, size = [], 0
                yield table(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(read, RECORDS)
