"""The queries and the pipeline over the smallest tables, against SQL, libraries, brute force and held-out rows."""

import hashlib
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plinth.llm import queries as q
from plinth.llm import urls
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_others import poisson
from tests.llm.test_substrings import brute as brute_windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*[table.column(n).to_pylist() for n in names], strict=True)))


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    assert rows(q.queries()[name](spark, SF).toArrow()) == rows(duck.sql(q.oracle_sql()[name]).to_arrow_table())


def test_bpe_digests(spark, duck):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = set()
    for i, text in duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        ids = library.encode(text, add_special_tokens=False).ids
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in q.op2_bpe(spark, SF).collect()} == want


def test_url_rules_over_all_pages(spark, duck):
    def host_path(url):
        _, mark, rest = (url or "").partition("://")
        if not mark:
            return "", ""
        end = min([rest.index(c) for c in "?#" if c in rest], default=len(rest))
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        return rest[:cut].lower(), rest[cut:end]

    got = {r.page_id: r for r in q.op5_url_templates(spark, SF).collect()}
    for page, url in duck.sql("SELECT page_id, url FROM pages").fetchall():
        host, path = host_path(url)
        fits = [(len(text), text, says) for says, text in q.URL_RULES if (host == text.split("/")[0] or host.endswith("." + text.split("/")[0])) and path.startswith(text[text.index("/") :])]
        best = max(fits, default=(0, None, None))
        assert (got[page].host, got[page].path, got[page].rule) == (host, path, best[1])
        assert got[page].verdict == (best[2] or ("block" if got[page].bad_share >= 0.5 else "allow"))
    assert len(got) == duck.sql("SELECT count(*) FROM pages").fetchall()[0][0] and urls.DEPTH > 1


def test_toxicity_and_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = {i: (g, t) for i, g, t in duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{sf}/labels.parquet'").fetchall()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    found = [r for r in q.op9_toxicity_cnn(spark, sf).collect() if r.doc_id in labels]
    assert all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.5) for r in found)
    own = [r for r in found if r.held_out]
    assert sum(r.predicted == labels[r.doc_id][1] for r in own) >= 0.96 * len(own)
    kept = [r for r in q.op8_quality_bayes(spark, sf).collect() if r.doc_id in labels and held(r.doc_id)]
    assert sum(r.kept == bool(labels[r.doc_id][0]) for r in kept) >= 0.97 * len(kept)


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("n_words", F.lit(1))  # a clashing name
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == columns
    clean = clean.cache()
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()}
    assert len(gone - toxic) <= 0.1 * docs.count()
    texts = sorted((r.doc_id, r.text) for r in clean.collect())
    single = stages["jaccard"](spark, clean, SF).cache()
    assert single.columns == columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, _, home in brute_components(texts) if i == home)
    texts = [(r.doc_id, r.text) for r in single.collect()]
    bare = stages["substrings"](spark, single, SF).cache()
    want = {i: (kept if gone else None) for i, _, gone, kept in brute_windows(texts)}
    old = dict(texts)
    assert bare.columns == columns
    assert {r.doc_id: r.text for r in bare.collect()} == {i: old[i] if kept is None else kept for i, kept in want.items()}
    mixed = stages["mixing"](spark, bare, SF).cache()
    sizes = Counter(r.source for r in bare.collect())
    whole = sum(n**0.5 for n in sizes.values())
    rate = {s: sum(sizes.values()) * n**0.5 / whole / n for s, n in sizes.items()}
    uniform = lambda i: int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) / 2**52
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and all(times[r.doc_id] == poisson(rate[r.source], uniform(r.doc_id)) for r in bare.collect())
    coded = stages["bpe"](spark, mixed, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    final = {r.doc_id: r.text for r in mixed.collect()}
    assert len(coded) == mixed.count() and all(r.round_trip and r.ids == library.encode(final[r.doc_id], add_special_tokens=False).ids for r in coded)


def test_near_duplicates_of_clashing_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (5, b), (6, b), (7, None)], "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == [(1, a), (5, b), (7, "")]


def test_pipeline_of_an_empty_table_and_nulls(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    for name, table in (("empty", docs.limit(0)), ("nulls", spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "a b", None, "s", 3)] * 2, docs.schema))):
        rows, left = table, []
        for stage, function in corpus_pipeline.STAGES:
            rows = function(spark, rows, str(tmp_path)).cache()
            left.append((stage, sorted((r.doc_id or 0 for r in rows.collect()))))
        kept = [] if name == "empty" else [0, 0, 1, 2]  # rows without an id stay, the other repeated ones go
        assert left[0][1] == sorted(kept + [1, 2] * bool(kept)) and left[1][1] == left[2][1] == kept
        assert set(left[3][1]) <= set(kept) and left[4][1] == left[3][1] and all(r.round_trip for r in rows.collect())
