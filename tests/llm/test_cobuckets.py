"""Co-bucketed table pairs: the query against a brute-force version over files that pyarrow reads, and edges."""

import hashlib
import zlib
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plinth.llm import cobuckets as co
from plinth.llm import queries as q
from plinth.runtime import new_path

SF = "/root/testdata/sf0.001"


def crc(x):
    return zlib.crc32(str(x).encode())


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def ordered(rows, at):
    """By the key, then by the other columns; nulls first, strings by their bytes."""
    cell = lambda x: (x is not None, x.encode() if isinstance(x, str) else x)
    return sorted(rows, key=lambda r: [cell(r[at]), *(cell(x) for i, x in enumerate(r) if i != at)])


def expected(rows, at, start_of, bucket_of):
    starts, finals = {}, {}
    for r in rows:
        starts.setdefault(start_of(r), []).append(r)
        finals.setdefault(bucket_of(r), []).append(r)
    out = {}
    for b, own in finals.items():
        lineage = Counter(start_of(r) for r in own)
        stays = len(lineage) == 1 and len(starts[next(iter(lineage))]) == len(own)
        ids = ",".join("" if r[at] is None else str(r[at]) for r in ordered(own, at))
        out[b] = (ordered(own, at), sha(ids), sha(",".join(f"{s}:{n}" for s, n in sorted(lineage.items()))), not stays, next(iter(lineage)) if stays else b)
    return out


def local(path):
    return Path(path.removeprefix("file://"))


def verify(got, name, rows, columns, at, want, joined):
    own = {r.bucket: r for r in got if r.table_name == name}
    assert own.keys() == want.keys()
    for b, (content, ids, lineage, rewritten, number) in want.items():
        r = own[b]
        assert (r.columns, r.ids_sha256, r.lineage_sha256, r.n_rows, r.n_joined, r.rewritten) == (",".join(columns), ids, lineage, len(content), joined.get(b, 0), rewritten)
        held = pq.read_table(local(r.path))
        assert held.column_names == list(columns) and list(zip(*held.to_pydict().values(), strict=True)) == content
        assert f"part-{number:05d}-" in r.path
    if own:
        assert {p.name for p in local(next(iter(own.values())).path).parent.iterdir() if not p.name.startswith(".")} == {local(r.path).name for r in own.values()}


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """The smallest tables with a null key, repeated sales and lines, nulls in other columns, and starting files that hold one bucket."""
    at = tmp_path_factory.mktemp("shop")
    sales, lines = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("sales", "sale_lines"))
    sales = sales.union(sales.limit(3)).union(sales.limit(2).withColumn("sale_id", F.lit(None).cast("long")))
    lonely = lines.limit(2).withColumns({"item_id": F.lit(100_003).cast("long"), "sale_id": F.lit(77_000_001).cast("long")})
    sales.write.parquet(f"{at}/sales.parquet")
    lines.union(lines.limit(3)).union(lonely).write.parquet(f"{at}/sale_lines.parquet")
    return at


def test_query_against_brute_force(spark, shop):
    sf = str(shop)
    got = q.op13_cobucketed_pair(spark, sf).collect()
    tables = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("sales", "sale_lines")}
    data = {t: [tuple(r) for r in df.collect()] for t, df in tables.items()}
    sales, lines = (Counter(r[0] for r in data[t]) for t in ("sales", "sale_lines"))
    of = lambda k: 601 if k is None else crc(f"s{k}") % 600
    joined = Counter()
    for k, n in lines.items():
        if k is not None and k in sales:
            joined[of(k)] += n * sales[k]
    first = lambda r: of(r[0]) - (of(r[0]) % 4 == 1)
    verify(got, "sales", data["sales"], tables["sales"].columns, 0, expected(data["sales"], 0, first, lambda r: of(r[0])), joined)
    item = tables["sale_lines"].columns.index("item_id")
    orphan = lambda r: of(r[0]) if r[0] is None or r[0] in sales else 600
    verify(got, "sale_lines", data["sale_lines"], tables["sale_lines"].columns, 0, expected(data["sale_lines"], 0, lambda r: 0 if r[item] is None else crc(r[item]) % 600, orphan), joined)
    assert any(not r.rewritten for r in got)


def pair(spark, left, right, n=4):
    root, out = new_path(spark, "pair"), []
    for name, df in (("a", left), ("b", right)):
        co.write_numbered(df, df.columns, f"{root}/{name}", F.lit(0), n + 2, "k")
        out.append(co.NumberedFiles(spark, f"{root}/{name}", df.schema, "k"))
    return co.rewrite_pair(*out, n).collect()


def test_edges(spark):
    schema = "bucket string, k int, file string, own_file int, `a.b` string"
    left = spark.createDataFrame([("x", 1, "é", None, "q"), ("x", 1, "z", 2, None), (None, None, None, None, None)], schema)
    right = spark.createDataFrame([("y", 1, "f", 1, "r" * 100_000)] * 2 + [(None, 9, None, None, ""), (None, None, "", 0, None)], schema)
    got = {(r.table_name, r.bucket): r for r in pair(spark, left, right)}
    b = crc(1) % 4
    assert got.keys() == {("a", b), ("a", 5), ("b", b), ("b", 4), ("b", 5)}
    assert got["a", b].n_joined == got["b", b].n_joined == 4 and got["b", 4].n_joined == got["b", 5].n_joined == 0
    assert got["b", 4].ids_sha256 == sha("9") and got["a", 5].ids_sha256 == sha("") and got["a", b].ids_sha256 == sha("1,1")
    held = pq.read_table(local(got["a", b].path))
    assert held.column_names == ["bucket", "k", "file", "own_file", "a.b"] and held.column("file").to_pylist() == ["z", "é"]
    alone = pair(spark, left.where("k = 1"), right.limit(0))  # one bucket in one file: it stays; the other table has none
    assert [(r.table_name, r.bucket, r.rewritten) for r in alone] == [("a", b, False)] and "part-00000" in alone[0].path
    assert pair(spark, left.limit(0), left.limit(0)) == []
    orphans = pair(spark, left.limit(0), right)
    assert sorted((r.bucket, r.n_rows) for r in orphans) == [(4, 3), (5, 1)]
    with pytest.raises(ValueError):
        co.NumberedFiles(spark, "/tmp/none", right.drop("k").schema, "k")
