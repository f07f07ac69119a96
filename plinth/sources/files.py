"""Files: listing, fingerprints, text pages and laid-out pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions import rules
from plinth.functions import text as T
from plinth.operators import layout
from plinth.operators.manifest import mark_duplicates
from plinth.runtime import bound_batches, materialise, shuffle_partitions
from plinth.sources.isolated import Child

FILES = "path string, sha256 string, size long, mtime_ns long, duplicate_of string"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def list_files(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Supported files below a folder, or one file; with their bytes. A missing path and a single file of another type are errors;
    other types in a folder are passed over. most: the first so many in lower-case path order."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(where):
        raise FileNotFoundError(f"Source path does not exist: {path}")
    if store.getFileStatus(where).isFile() and not path.lower().endswith(rules.SUPPORTED_EXTENSIONS):
        raise ValueError(f"Unsupported file type: {path}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(extension(F.col("path")).isin(*rules.SUPPORTED_EXTENSIONS))
    return files if most is None else files.orderBy(F.lower("path"), "path").limit(most)


def discover(files: DataFrame) -> DataFrame:
    """Fingerprints and duplicates."""
    found = files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    return mark_duplicates(found)


def decoded(content: Column) -> Column:
    """UTF-8; bytes that are none are dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def text_pages(files: DataFrame) -> DataFrame:
    """A page for each text or Markdown file that isn't blank: path, page_number, title, text, error."""
    rows = files.where(extension(F.col("path")) != ".pdf").select("path", F.lit(1).alias("page_number"), stem(F.col("path")).alias("title"), T.strip(decoded(F.col("content"))).alias("text"))
    return rows.where("text <> ''").withColumn("error", F.lit(None).cast("string"))


@dataclass(frozen=True)
class PagedParser:
    """A parser that reads some pages of a file: count(bytes) gives their number, read(bytes, first, last) the blocks of pages first to
    last (from 1), as dicts with the keys of layout.BLOCKS but doc, and title."""

    count: Callable[[bytes], int]
    read: Callable[[bytes, int, int], Iterator[dict]]


SPAN = pa.struct([("text", pa.string()), ("bbox", pa.list_(pa.float64()))])
PARSED = pa.schema([
    ("doc", pa.string()), ("page", pa.int32()), ("width", pa.float64()), ("block_no", pa.int32()), ("type", pa.int32()), ("bbox", pa.list_(pa.float64())),
    ("lines", pa.list_(pa.struct([("spans", pa.list_(SPAN))]))), ("title", pa.string()), ("error", pa.string()),
])
RANGES = pa.schema([("path", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("content", pa.binary()), ("error", pa.string())])
RANGE_PAGES, LIMIT_SECONDS = 64, 300.0


def pdf_blocks(files: DataFrame, parse: Callable[[bytes], Iterator[dict]] | PagedParser | None = None, tasks: int = 1, pages: int = RANGE_PAGES, limit: float = LIMIT_SECONDS) -> DataFrame:
    """Blocks of laid-out pages, and an error row for each part of a file that can't be read.

    parse: a PagedParser, whose files are dealt in ranges of so many pages to ``tasks`` tasks at least, or bytes -> dicts, which takes
    a file whole. By default PyMuPDF, if the workers have it. A parser runs in a child process of its task and has ``limit`` seconds
    for each part: one that hangs or crashes costs its own file."""
    bound_batches(files.sparkSession)
    parser = parse or PYMUPDF
    pdfs = files.where(extension(F.col("path")) == ".pdf").select("path", "content")
    if isinstance(parser, PagedParser):
        count, read = parser.count, cloudpickle.dumps(parser.read)
        counted = cloudpickle.dumps(lambda data: [count(data)])
        ranges = pdfs.mapInArrow(lambda batches: page_ranges(batches, counted, pages, limit), "path string, first int, last int, content binary, error string")
        # A number of its own: small parts aren't put together again, since it is the parser that takes the time.
        ranges = ranges.repartition(max(tasks, shuffle_partitions(files.sparkSession)), "path", "first")
    else:
        read = cloudpickle.dumps(lambda data, first, last: parser(data))
        ranges = pdfs.selectExpr("path", "1 AS first", "CAST(NULL AS INT) AS last", "content", "CAST(NULL AS STRING) AS error")
    return ranges.mapInArrow(lambda batches: parsed(batches, read, limit), layout.BLOCKS + ", title string, error string")


def page_ranges(batches: Iterator[pa.RecordBatch], count: bytes, pages: int, limit: float) -> Iterator[pa.RecordBatch]:
    """A row with the file's bytes for each range of its pages; a file without pages has one."""
    with Child(count, limit) as child:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    n, error = child.call(content.as_py())[0], None
                except (RuntimeError, OSError) as broken:
                    n, error = 0, said(broken)
                for first in range(1, max(n, 1) + 1, pages):
                    part = [[path], [first], [min(first + pages - 1, n)], [None if error else content.as_py()], [error]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(part, RANGES, strict=True)], schema=RANGES)


def parsed(batches: Iterator[pa.RecordBatch], read: bytes, limit: float) -> Iterator[pa.RecordBatch]:
    with Child(read, limit) as child:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns if not pa.types.is_binary(c.type)]
            for path, first, last, error, content in zip(*columns, batch.column(3), strict=True):
                try:
                    rows = [{"doc": path, "error": error}] if error else [{"doc": path, "error": None, **b} for b in child.call(content.as_py(), first, last)]
                except (RuntimeError, OSError) as broken:  # one bad file doesn't end the run: it is reported
                    rows = [{"doc": path, "error": said(broken)}]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in PARSED], schema=PARSED)


def said(broken: Exception) -> str:
    return str(broken) if type(broken) is RuntimeError else f"{type(broken).__name__}: {broken}"


def count_pymupdf(data: bytes) -> int:
    import fitz  # optional

    with fitz.open(stream=data, filetype="pdf") as doc:
        return doc.page_count


def read_pymupdf(data: bytes, first: int, last: int) -> Iterator[dict]:
    import fitz  # optional

    with fitz.open(stream=data, filetype="pdf") as doc:
        title = (doc.metadata or {}).get("title") or None
        for number in range(first, last + 1):
            page = doc[number - 1]
            try:
                found = [block_of(b) for b in page.get_text("dict").get("blocks", [])]
            except Exception:  # one page that can't be taken apart is read as plain text, line by line
                found = [plain_block(i, line) for i, line in enumerate(page.get_text("text", sort=True).splitlines())]
            # A page without blocks is a page, too.
            for i, b in enumerate(found or [{"type": 1, "bbox": [0.0] * 4, "lines": []}]):
                yield {"page": number, "width": page.rect.width, "block_no": i, "title": title, **b}


PYMUPDF = PagedParser(count_pymupdf, read_pymupdf)


def block_of(b: dict) -> dict:
    lines = [{"spans": [{"text": s["text"], "bbox": list(s["bbox"])} for s in line.get("spans", [])]} for line in b.get("lines", [])]
    return {"type": b.get("type"), "bbox": list(b["bbox"]), "lines": lines}


def plain_block(i: int, line: str) -> dict:
    at = [0.0, float(i), 0.0, float(i)]
    return {"type": 0, "bbox": at, "lines": [{"spans": [{"text": line, "bbox": at}]}]}


def pdf_pages(files: DataFrame, parse: Callable[[bytes], Iterator[dict]] | PagedParser | None = None, tasks: int = 1, pages: int = RANGE_PAGES, limit: float = LIMIT_SECONDS) -> DataFrame:
    """path, page_number, title, text, error. Pages without text have an empty one: they count as scanned. A file of which any part
    can't be read has one row, its error."""
    blocks = materialise(pdf_blocks(files, parse, tasks, pages, limit), "blocks")  # every file is parsed once
    errors = blocks.where("error is not null").groupBy("doc").agg(F.min("error").alias("error"))
    fine = blocks.drop("error").join(errors.select("doc"), "doc", "left_anti")
    titles = fine.groupBy("doc").agg(F.max("title").alias("title"))
    assembled = layout.assemble_pages(fine.drop("title")).join(titles, "doc")
    found = assembled.select(F.col("doc").alias("path"), F.col("page").alias("page_number"), F.coalesce("title", stem(F.col("doc"))).alias("title"), "text", F.lit(None).cast("string").alias("error"))
    broken = errors.select(F.col("doc").alias("path"), F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("text"), "error")
    return found.unionByName(broken)


def extract(files: DataFrame, parse: Callable[[bytes], Iterator[dict]] | PagedParser | None = None, tasks: int = 1) -> DataFrame:
    return text_pages(files).unionByName(pdf_pages(files, parse, tasks))
