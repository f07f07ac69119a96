"""What is known about files: duplicates, changes, deletions, and the manifest's next version.

files: path, sha256, size, mtime_ns. manifest: MANIFEST, keyed by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANIFEST = (
    "path string, sha256 string, size long, mtime_ns long, status string, duplicate_of string, pages int, chunks int, scanned_pages int, "
    "error string, parser_version string, chunk_size_chars int, chunk_overlap_chars int, embedding_model string, updated_at double"
)
ERROR_CHARS = 2000


def mark_duplicates(files: DataFrame) -> DataFrame:
    """duplicate_of: the first path, in lower-case order, of the same content."""
    by_content = files.groupBy("sha256").agg(F.min_by("path", F.struct(F.lower("path"), "path")).alias("owner"))
    joined = files.join(by_content, "sha256")
    return joined.withColumn("duplicate_of", F.when(F.col("owner") != F.col("path"), F.col("owner"))).drop("owner")


def changed_files(files: DataFrame, manifest: DataFrame, parser_version: str, chunk_size: int, chunk_overlap: int, model: str, force: bool = False, failed_only: bool = False) -> DataFrame:
    """The files to work on. Duplicates never are. A file that comes back after it was deleted is."""
    own = files.where("duplicate_of is null")
    if force:
        return own
    known = manifest.select("path", F.struct("status", "sha256", "size", "mtime_ns", "parser_version", "chunk_size_chars", "chunk_overlap_chars", "embedding_model").alias("was"))
    joined = own.join(known, "path", "left")
    now: dict[str, Column] = {
        "sha256": F.col("sha256"), "size": F.col("size"), "mtime_ns": F.col("mtime_ns"), "parser_version": F.lit(parser_version),
        "chunk_size_chars": F.lit(chunk_size), "chunk_overlap_chars": F.lit(chunk_overlap), "embedding_model": F.lit(model),
    }
    differs = F.lit(False)
    for name, value in now.items():
        differs = differs | ~F.col(f"was.{name}").eqNullSafe(value)
    new, failed = F.col("was").isNull(), F.col("was.status") == "failed"
    wanted = failed if failed_only else new | failed | (F.col("was.status") == "deleted") | differs
    return joined.where(F.coalesce(wanted, F.lit(False))).drop("was")


def deleted_paths(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.where("status <> 'deleted'").select("path").join(files, "path", "left_anti")


def upsert(manifest: DataFrame, outcomes: DataFrame, deleted: DataFrame, now: float, parser_version: str) -> DataFrame:
    """The next version. outcomes: files with status (indexed, duplicate, failed) and what belongs to it. An indexed file's row is replaced;
    a duplicate's and a failed one's keep the counts and parameters that they had."""
    taken = [c.split()[0] for c in MANIFEST.split(", ") if not c.startswith(("path ", "updated_at "))]
    new = outcomes.select("path", F.struct(*taken).alias("new"))
    old = manifest.select("path", F.struct(*taken, "updated_at").alias("old"))
    gone = deleted.select("path", F.lit(True).alias("gone"))
    rows = old.join(new, "path", "full").join(gone, "path", "left")
    status, fresh, both = F.col("new.status"), F.col("old").isNull(), F.col("new").isNotNull()
    always = {"sha256", "size", "mtime_ns", "status"}
    out = [F.col("path")]
    for name in taken:
        replaces = both & (fresh | (status == "indexed") | F.lit(name in always) | ((status == "duplicate") & F.lit(name == "duplicate_of")) | ((status == "failed") & F.lit(name == "error")))
        value = F.when(replaces, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))
        if name == "status":
            value = F.when(F.col("gone") & ~both, "deleted").otherwise(value)
        if name == "error":
            value = F.substring(value, 1, ERROR_CHARS)
        out.append(value.alias(name))
    return rows.select(*out, F.when(both | F.col("gone"), F.lit(now)).otherwise(F.col("old.updated_at")).alias("updated_at"))


def outcome(files: DataFrame, status: str, parser_version: str, chunk_size: int = 0, chunk_overlap: int = 0, model: str = "") -> DataFrame:
    """files as rows for upsert(); pages, chunks, scanned_pages and error are taken from it where it has them."""
    own = {c: F.col(c) if c in files.columns else F.lit(0).cast("int") for c in ("pages", "chunks", "scanned_pages")}
    duplicate_of = F.col("duplicate_of") if status == "duplicate" else F.lit(None).cast("string")
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    return files.select(
        "path", "sha256", "size", "mtime_ns", F.lit(status).alias("status"), duplicate_of.alias("duplicate_of"), *[v.cast("int").alias(k) for k, v in own.items()], error.alias("error"),
        F.lit(parser_version).alias("parser_version"), F.lit(chunk_size).alias("chunk_size_chars"), F.lit(chunk_overlap).alias("chunk_overlap_chars"), F.lit(model).alias("embedding_model"),
    )


def compared(files: DataFrame, manifest: DataFrame | None, parser_version: str, chunk_size: int, chunk_overlap: int, model: str, force: bool = False, failed_only: bool = False) -> DataFrame:
    """Every file and every path of the manifest once, with what has to be done about it: is_own (no copy of another), is_changed (to work
    on), is_deleted, is_voided (indexed before, and now a copy of another), is_new_copy (a copy that the manifest doesn't know as
    such) and is_kept (indexed, as it was). Without a manifest every file is new."""
    known = manifest if manifest is not None else files.sparkSession.createDataFrame([], MANIFEST)
    was = known.select("path", F.struct(*[c.split()[0] for c in MANIFEST.split(", ") if not c.startswith("path ")]).alias("was"))
    rows = files.withColumn("is_file", F.lit(True)).join(was, "path", "full").withColumn("is_file", F.coalesce("is_file", F.lit(False)))
    own = F.col("is_file") & F.col("duplicate_of").isNull()
    copy = F.col("is_file") & F.col("duplicate_of").isNotNull()
    status = F.col("was.status")
    now = {"sha256": F.col("sha256"), "size": F.col("size"), "mtime_ns": F.col("mtime_ns"), "parser_version": F.lit(parser_version), "chunk_size_chars": F.lit(chunk_size), "chunk_overlap_chars": F.lit(chunk_overlap), "embedding_model": F.lit(model)}
    differs = F.lit(False)
    for name, value in now.items():
        differs = differs | ~F.col(f"was.{name}").eqNullSafe(value)
    failed = F.coalesce(status == "failed", F.lit(False))
    wanted = F.lit(True) if force else failed if failed_only else F.col("was").isNull() | failed | F.coalesce(status == "deleted", F.lit(False)) | differs
    known_copy = (status == "duplicate") & F.col("was.duplicate_of").eqNullSafe(F.col("duplicate_of")) & F.col("was.sha256").eqNullSafe(F.col("sha256")) & F.col("was.size").eqNullSafe(F.col("size")) & F.col("was.mtime_ns").eqNullSafe(F.col("mtime_ns"))
    indexed = F.coalesce(status == "indexed", F.lit(False))
    flags = {
        "is_own": own, "is_changed": own & wanted, "is_deleted": ~F.col("is_file") & F.coalesce(status != "deleted", F.lit(False)), "is_voided": copy & indexed,
        "is_new_copy": copy & ~F.coalesce(known_copy, F.lit(False)), "is_kept": own & ~wanted & indexed,
    }
    return rows.select("path", "sha256", "size", "mtime_ns", "duplicate_of", "is_file", *[v.alias(k) for k, v in flags.items()])


def report(state: DataFrame) -> DataFrame:
    """One row of counts of compared()."""
    counts = {"discovered": "is_file", "duplicates": "duplicate_of is not null", "changed": "is_changed", "deleted": "is_deleted", "voided": "is_voided", "kept": "is_kept", "pdfs": "is_file and lower(path) like '%.pdf'"}
    return state.agg(*[F.count_if(F.expr(test)).alias(name) for name, test in counts.items()])
