"""A pair of tables that share a key, kept as co-bucketed files: bucket b of either table is one Parquet file.

The tables first stand in numbered files of any other rule (``write_numbered``). ``rewrite_pair`` brings both to the shared
buckets: semi and anti joins tell rows whose key the left table has from orphans, which get a bucket of their own, as rows
without a key do; ``repartitionById`` sends each row directly to its bucket's partition; ``sortWithinPartitions`` orders it
there by all columns; each nonempty partition becomes one file. A starting file that holds just a final file's rows stays as
it is, under whatever number. New files are appended, and those that they replace are deleted once these are committed.

Scale: what grows with the input is only shuffled, by key or by bucket. A hot key's rows are split by adaptive execution in
the joins and meet only in its bucket's file, which one task sorts (with spilling) and streams out, as one file a bucket
demands; the file's digest is a running one. The driver and broadcasts see a row for each file at most, ``n + 2`` a table.

Defined results: rows that repeat are all kept, also where both tables repeat a key (``n_joined`` then counts products). Rows
without a key share bucket n + 1 in both tables, and the right table's rows whose key the left one lacks bucket n. Nulls sort
first, strings by their UTF-8 bytes. An empty table has no files. Columns of any name and orderable type are kept. A key that
one of the tables lacks is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plinth.runtime import materialise


def crc_bucket(key: Column, n: int, salt: str = "") -> Column:
    """Unsigned crc32 of the salt and the key as text, mod n; null for null."""
    return (F.crc32(F.concat(F.lit(salt), key.cast("string"))) % n).cast("int")


def unused(name: str, taken: list[str]) -> str:
    lower = {c.lower() for c in taken}
    while name in lower:
        name += "_"
    return name


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def write_numbered(df: DataFrame, columns: list[str], path: str, number: Column, n: int, key: str) -> None:
    """Append rows to a folder as files of the given numbers (0 to n - 1): one for each number that has rows, sorted by the key, then by
    the other columns. A file's number is its partition's, which its name tells."""
    own = unused("file_number", df.columns)
    order = [named(c).asc_nulls_first() for c in [key] + [c for c in columns if c != key]]
    rows = df.withColumn(own, number).repartitionById(n, own).sortWithinPartitions(*order).select(*map(named, columns))
    # One file for a partition, and no marker beside the data files.
    files = NumberedFiles(df.sparkSession, path, StructType([df.schema[c] for c in columns]), key)
    before = set(files.names())
    rows.write.mode("append").options(**{"maxRecordsPerFile": "0", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}).parquet(path)
    first = [f for f in files.names() if f not in before and f.startswith("part-00000-")]
    files.delete([f for f in first if df.sparkSession.read.schema(files.schema).parquet(f"{path}/{f}").isEmpty()])  # Spark writes partition 0 in any case


class NumberedFiles:
    """A table in a folder of numbered files."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str) -> None:
        if key not in schema.names:
            raise ValueError(f"{path} has no column {key}")
        self.spark, self.path, self.schema, self.columns, self.key = spark, path, schema, schema.names, key
        self.file, self.place, self.bucket = (unused(f"own_{x}", schema.names) for x in ("file", "place", "bucket"))
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        if not self._fs.exists(self._path(self.path)):
            return []
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)))
        return sorted(x for x in found if x.startswith("part-"))

    def delete(self, names: list[str]) -> None:
        for name in names:
            self._fs.delete(self._path(self.path, name), False)

    def rows(self, *columns: str) -> DataFrame:
        """Columns, and each row's file and its place there."""
        if not self.names():
            empty = self.spark.createDataFrame([], self.schema)
            return empty.select(*map(named, columns), F.lit("").alias(self.file), F.lit(0).cast("long").alias(self.place))
        read = self.spark.read.schema(self.schema).parquet(self.path)
        meta = read.metadataColumn("_metadata")
        return read.select(*map(named, columns), meta["file_name"].alias(self.file), meta["row_index"].alias(self.place))

    def bucketed(self, rows: DataFrame, n: int, salt: str, known: DataFrame | None) -> DataFrame:
        """rows with their buckets. known: the keys that aren't orphans, all if it is None."""
        key = named(self.key)
        without = rows.where(key.isNull()).withColumn(self.bucket, F.lit(n + 1))
        some = rows.where(key.isNotNull())
        if known is None:
            return some.withColumn(self.bucket, crc_bucket(key, n, salt)).unionByName(without)
        found = some.join(known, self.key, "left_semi").withColumn(self.bucket, crc_bucket(key, n, salt))
        orphans = some.join(known, self.key, "left_anti").withColumn(self.bucket, F.lit(n))
        return found.unionByName(orphans).unionByName(without)

    def rewrite(self, n: int, salt: str, known: DataFrame | None) -> DataFrame:
        """Rewrites the files. A row for each bucket that has rows: bucket, stays (the name of a file that stayed, else null),
        lineage (start:rows of each starting file)."""
        narrow = self.bucketed(self.rows(self.key).drop(self.place), n, salt, known)
        flows = narrow.groupBy(F.col(self.file).alias("file"), F.col(self.bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        flows = materialise(flows, "flows")  # at most as many rows as starting files times buckets
        alone = flows.groupBy("file").agg(F.count(F.lit(1)).alias("k"), F.first("bucket").alias("bucket")).where("k = 1").select("bucket", F.col("file").alias("stays"))
        single = flows.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k = 1").select("bucket")
        stay = {r.bucket: r.stays for r in alone.join(single, "bucket").collect()}  # a row a file at most
        before, kept = self.names(), set(stay.values())
        if len(kept) < len(before):
            rows = self.bucketed(self.rows(*self.columns), n, salt, known)
            write_numbered(rows.where(~F.col(self.file).isin(list(kept))) if kept else rows, self.columns, self.path, F.col(self.bucket), n + 2, self.key)
        self.delete([f for f in before if f not in kept])
        steps = F.sort_array(F.collect_list(F.struct(F.regexp_extract("file", r"^part-(\d+)", 1).cast("int").alias("start"), "n")))
        lineage = F.array_join(F.transform(steps, lambda s: F.concat_ws(":", s["start"].cast("string"), s["n"].cast("string"))), ",")
        stays = self.spark.createDataFrame(list(stay.items()), "bucket int, stays string")
        return flows.groupBy("bucket").agg(lineage.alias("lineage")).join(F.broadcast(stays), "bucket", "left")

    def digests(self, buckets: DataFrame, n: int) -> DataFrame:
        """(bucket, file, n_rows, ids_sha256) of the files as they are now, read in their order. buckets: of rewrite()."""
        stays = F.broadcast(buckets.where("stays is not null").select(F.col("stays").alias("file"), F.col("bucket").alias("of_stay")))
        rows = self.rows(self.key).select(F.col(self.file).alias("file"), F.col(self.place).alias("place"), named(self.key).cast("string").alias("key")).join(stays, "file", "left")
        number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("int")
        dealt = rows.select(F.coalesce("of_stay", number).alias("bucket"), "file", "place", "key").repartitionById(n + 2, "bucket").sortWithinPartitions("bucket", "file", "place")
        return dealt.mapInArrow(_digest, "bucket int, file string, n_rows long, ids_sha256 string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come file by file and in their order; one running digest is held."""
    now, bucket, n, sha = None, 0, 0, hashlib.sha256()

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([now]), pa.array([n]), pa.array([sha.hexdigest()])], ["bucket", "file", "n_rows", "ids_sha256"])

    for batch in batches:
        files, keys = batch.column(1).dictionary_encode(), batch.column(3).to_pylist()
        of = files.indices.to_numpy()
        cuts = [0, *(int(i) + 1 for i in (of[1:] != of[:-1]).nonzero()[0]), len(of)] if len(of) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            file = files.dictionary[int(of[a])].as_py()
            if file != now:
                if now is not None:
                    yield done()
                now, bucket, n, sha = file, batch.column(0)[a].as_py(), 0, hashlib.sha256()
            sha.update(("," * (n > 0) + ",".join(k or "" for k in keys[a:b])).encode())
            n += b - a
    if now is not None:
        yield done()


def rewrite_pair(left: NumberedFiles, right: NumberedFiles, n: int, salt: str = "") -> DataFrame:
    """Both tables become co-bucketed files in their folders. A row for each final file: table_name (its folder's), path, columns,
    ids_sha256, lineage_sha256, bucket, n_rows, n_joined, rewritten."""
    keys = left.rows(left.key).select(named(left.key)).where(named(left.key).isNotNull()).distinct()
    # The right table first: its joins read the left one's starting files.
    buckets = {right: right.rewrite(n, salt, keys), left: left.rewrite(n, salt, None)}
    counts = [t.rows(t.key).select(named(t.key).alias("key")).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias(f"n_{i}")) for i, t in enumerate((left, right))]
    joined = counts[0].join(counts[1], "key").groupBy(crc_bucket(F.col("key"), n, salt).alias("bucket")).agg(F.sum(F.col("n_0") * F.col("n_1")).alias("n_joined"))
    out = []
    for t in (left, right):
        found = t.digests(buckets[t], n).join(buckets[t], "bucket").join(joined, "bucket", "left")
        out.append(found.select(
            F.lit(t.path.rpartition("/")[2]).alias("table_name"), F.concat(F.lit(t.path + "/"), F.col("file")).alias("path"), F.lit(",".join(t.columns)).alias("columns"), "ids_sha256",
            F.sha2("lineage", 256).alias("lineage_sha256"), F.col("bucket").cast("long").alias("bucket"), "n_rows", F.coalesce("n_joined", F.lit(0)).cast("long").alias("n_joined"), F.col("stays").isNull().alias("rewritten"),
        ))
    return out[0].unionByName(out[1])
