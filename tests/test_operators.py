"""Text, chunking, embedding, layout and retrieval operators against plain folds and stated results."""

import random
from hashlib import blake2b

import pytest
from pyspark.sql import functions as F

from plinth.functions import text as T
from plinth.operators import answers, chunking, cleaning, embedding, layout, lexical, manifest, retrieval
from plinth.settings import Settings


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], " string, ".join(values) + " string")
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, tokens",
    [("Stroke RISK", ["stroke", "risk"]), ("SPAN-100 x_y+z 3.14", ["span-100", "x_y+z", "3.14"]), ("Café ٣٤ a b", ["caf", "٣٤", "a", "b"]), ("", [])],
)
def test_tokens(spark, text, tokens):
    assert one(spark, T.tokens(F.col("t")), t=text) == tokens


def test_excerpts(spark):
    text = "Short one. Stroke care matters most here! Another line about nothing? Stroke again."
    assert one(spark, T.best_excerpt(F.col("t"), F.col("q")), t=text, q="stroke care") == "Short one. Stroke care matters most here! Stroke again."
    assert one(spark, T.best_excerpt(F.col("t"), F.col("q"), 25), t=text, q="stroke care") == "Stroke care matters..."
    assert one(spark, T.citation_excerpt(F.col("t")), t="a" * 400) == "a" * 319 + "..."
    assert one(spark, T.citation_excerpt(F.col("t")), t="word " * 100) == ("word " * 63).strip() + "..."
    assert one(spark, T.best_excerpt(F.col("t"), F.col("q")), t="", q="x") == ""


def fold(sentences, size, overlap):
    """The same packing, sentence by sentence with joined strings."""
    out, now = [], []

    def tail():
        kept = []
        for s in reversed(now):
            if overlap <= 0 or len(" ".join([s, *kept])) > overlap:
                break
            kept.insert(0, s)
        return kept

    for s in sentences:
        if len(s) > size:
            out += [" ".join(now)] if now else []
            now = tail()
            out += list(chunking.windows_of(s, size, overlap))
        elif len(" ".join([*now, s])) <= size:
            now.append(s)
        else:
            out += [" ".join(now)] if now else []
            now = tail()
            while now and len(" ".join([*now, s])) > size:
                now.pop(0)
            now.append(s)
    return out + ([" ".join(now)] if now else [])


def test_packing_against_a_fold():
    rng = random.Random(3)
    for _ in range(3000):
        sentences = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 40))).strip() or "x" for _ in range(rng.randint(0, 12))]
        size = rng.randint(5, 60)
        overlap = rng.randint(0, size - 1)
        assert chunking.pack(sentences, size, overlap) == fold(sentences, size, overlap)


def test_long_sentences():
    pieces = list(chunking.windows_of("alpha beta gamma delta " * 120, 180, 30))
    assert len(pieces) > 1 and all(len(p) <= 180 for p in pieces)
    assert list(chunking.windows_of("x" * 25, 10, 3)) == ["x" * 10, "x" * 10, "x" * 10, "x" * 4]


def pages(spark, *rows):
    full = [(i, s, f"/c/{s}", s, n, t, h) for i, (s, n, t, h) in enumerate(rows)]
    return spark.createDataFrame(full, "page_ord int, source_id string, source_path string, title string, page_number int, text string, hierarchy array<string>")


def test_section_across_pages_and_references(spark):
    df = pages(spark, ("s", 10, "RECOMMENDATIONS\nStart early.", None), ("s", 11, "Walk daily.\nREFERENCES\n1. Smith.", None))
    rows = chunking.chunks(cleaning.segments(df), Settings(chunk_size_chars=400, chunk_overlap_chars=60)).collect()
    assert [(r.text, r.page_range, r.section, r.page, r.chunk_index) for r in rows] == [("Section: Recommendations\n\nStart early. Walk daily.", "10-11", "Recommendations", 10, 1)]
    assert len(rows[0].chunk_id) == 24


def test_hierarchy_names_what_stands_before_any_heading(spark):
    df = pages(spark, ("s", 1, "first line here.", None), ("s", 2, "second line here.\nMETHODS\nthird line here.", ["Book", "Chapter"]))
    got = [(r.section, r.text) for r in cleaning.segments(df).orderBy("seg_id").collect()]
    assert got == [("Chapter", "first line here. second line here."), ("Methods", "third line here.")]


def test_blake2b_vectors(spark):
    df = spark.createDataFrame([("a", "Stroke care stroke"), ("b", ""), ("c", None)], "chunk_id string, text string")
    got = {(r.chunk_id, r.bucket): r.weight for r in embedding.hash_embed(df, dimensions=128).collect()}
    want = {}
    for term in ["stroke", "care", "stroke", "stroke_care", "care_stroke"]:
        digest = blake2b(term.encode(), digest_size=8).digest()
        key = ("a", int.from_bytes(digest[:4], "big") % 128)
        want[key] = want.get(key, 0) + (1 if digest[4] % 2 == 0 else -1)
    norm = sum(v * v for v in want.values()) ** 0.5
    assert got == pytest.approx({k: v / norm for k, v in want.items() if v})


def test_bm25_counts_query_tokens_twice_and_knows_no_strangers(spark):
    rows = spark.createDataFrame([("c1", "stroke prevention"), ("c2", "garden plants"), ("c3", "stroke")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "prevention"), (2, "prevention prevention"), (3, "zebra")], "query_id int, question string")
    got = {(r.query_id, r.chunk_id): r.score for r in lexical.bm25_scores(asked, lexical.postings(rows), lexical.doc_stats(rows)).collect()}
    assert set(got) == {(1, "c1"), (2, "c1")} and got[2, "c1"] == pytest.approx(2 * got[1, "c1"])
    assert lexical.corpus_stats(lexical.doc_stats(rows.limit(0))).first().asDict() == {"n": 0, "total_tokens": 0, "avgdl": 0.0}


def test_fusion_of_one_sided_hits(spark):
    left = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, chunk_id string, rank int")
    right = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, chunk_id string, rank int")
    got = {r.chunk_id: r.score for r in retrieval.rrf(left, right, 50).collect()}
    assert got == pytest.approx({"a": 1 / 61 + 1 / 170, "b": 1 / 62 + 1 / 61, "c": 1 / 170 + 1 / 62})


@pytest.mark.parametrize("most", [0, 500_000])
def test_vectors_without_a_common_bucket_still_rank(spark, monkeypatch, most):
    monkeypatch.setattr(retrieval, "BROADCAST_WEIGHTS", most)
    weights = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0), ("c", 1, -1.0)], "chunk_id string, bucket int, weight double")
    asked = spark.createDataFrame([(1, 1, 1.0)], "query_id int, bucket int, weight double")
    chunks = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 0)], "chunk_id string, chunk_ord int")
    got = [(r.chunk_id, r.score) for r in retrieval.sparse_topk(asked, weights, chunks, 4).orderBy("rank").collect()]
    assert got == [("a", 1.0), ("d", 0.0), ("b", 0.0), ("c", -1.0)]


def test_both_ways_of_scoring_agree(spark, monkeypatch):
    rng = random.Random(8)
    weights = spark.createDataFrame([(f"c{i}", b, rng.choice([-0.5, 0.25, 0.5])) for i in range(60) for b in rng.sample(range(12), 5)], "chunk_id string, bucket int, weight double")
    asked = spark.createDataFrame([(q, b, rng.choice([0.5, -0.25])) for q in range(5) for b in rng.sample(range(14), 4)], "query_id int, bucket int, weight double")
    chunks = spark.createDataFrame([(f"c{i}", i) for i in range(60)], "chunk_id string, chunk_ord int")
    monkeypatch.setattr(retrieval, "TILE_ROWS", 7)
    got = []
    for most in (0, 500_000):
        monkeypatch.setattr(retrieval, "BROADCAST_WEIGHTS", most)
        got.append(sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in retrieval.sparse_topk(asked, weights, chunks, 8).collect()))
    assert got[0] == got[1] and len(got[0]) == 40


def test_filters_are_typed(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, page int")
    assert df.where(retrieval.matches({"page": 1})).count() == 1
    assert df.where(retrieval.matches({"page": None})).count() == 1
    assert df.where(retrieval.matches(None)).count() == 2
    with pytest.raises(ValueError):
        retrieval.matches({"page": 1}, as_text=True)


def test_changes(spark):
    files = spark.createDataFrame([(p, s, 1, 1, None) for p, s in (("new", "n"), ("same", "s"), ("edited", "e2"), ("failed", "f"), ("back", "b"))], "path string, sha256 string, size long, mtime_ns long, duplicate_of string")
    old = [(p, s, 1, 1, st) for p, s, st in (("same", "s", "indexed"), ("edited", "e", "indexed"), ("failed", "f", "failed"), ("back", "b", "deleted"), ("gone", "g", "indexed"))]
    known = spark.createDataFrame(old, "path string, sha256 string, size long, mtime_ns long, status string").selectExpr("*", "'v' parser_version", "10 chunk_size_chars", "2 chunk_overlap_chars", "'m' embedding_model")
    names = lambda *a, **k: {r.path for r in manifest.changed_files(files, known, *a, **k).collect()}
    assert names("v", 10, 2, "m") == {"new", "edited", "failed", "back"}
    assert names("v", 10, 2, "m", failed_only=True) == {"failed"}
    assert names("v", 10, 2, "m", force=True) == names("v2", 10, 2, "m") == {"new", "same", "edited", "failed", "back"}
    assert [r.path for r in manifest.deleted_paths(files, known).collect()] == ["gone"]


def test_layout_of_empty_input(spark):
    assert layout.assemble_pages(spark.createDataFrame([], layout.BLOCKS)).collect() == []


def test_prompts(spark):
    hits = spark.createDataFrame([("q", "Why?", "clinician", 1, "Because.", "Title", None, "s.pdf", "c", 3, 0.5)], "query_id string, question string, answer_mode string, rank int, text string, title string, section string, source_id string, chunk_id string, page int, score double")
    row = answers.user_prompts(hits.select("query_id", "question", "answer_mode"), hits).first()
    assert row.user_prompt.endswith("Question: Why?\n\nRetrieved passages:\n\n[1] Title, page 3\nBecause.") and "Answer mode: clinician." in row.system_prompt


def test_dense_ranks_by_broadcast_and_by_shares(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)] + [(99, [1.0])], "chunk_id long, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 2.0]), (3, [1.0, 1.0, 1.0])], "query_id long, vector array<double>")
    by = {1: lambda i: i % 7, 2: lambda i: 0.5 * (i % 7) + 2 * (i % 5)}
    want = [(q, i, float(f(i)), place) for q, f in by.items() for place, i in enumerate(sorted(range(60), key=lambda i: (-f(i), i))[:4], 1)]
    for most in (retrieval.BROADCAST_WEIGHTS, 0):
        monkeypatch.setattr(retrieval, "BROADCAST_WEIGHTS", most)
        got = retrieval.dense_topk(queries, vectors, 4).select("query_id", "chunk_id", "score", "rank").collect()
        assert sorted(map(tuple, got), key=lambda r: (r[0], r[3])) == want


def test_pages_with_headers_pictures_and_references(spark):
    """Beside the query over all documents: cases by hand."""
    block = lambda doc, page, no, *spans, x=10.0, y=None: (doc, page, 600.0, no, 0 if spans else 1, [x, y or 10.0 * no, 0.0, 0.0], [([(t, [x + 30 * i, 0.0]) for i, t in enumerate(spans)],)] if spans else [])
    rows = [block("rep", p, 0, "Journal  of X") for p in (1, 2, 3)] + [block("rep", p, 1, f"Body {p}") for p in (1, 2, 3, 4, 5)]
    rows += [block("rep", 4, 2, "References:"), block("rep", 4, 3, "1. Gone"), block("rep", 2, 2, "Page 2"), block("rep", 2, 3, "Drug", "Dose", "n = 12")]
    rows += [block("scan", 1, 0, "Text"), block("scan", 2, 0), block("scan", 3, 0, "References"), block("scan", 3, 1, "Gone"), block("scan", 4, 0, "References"), block("scan", 5, 0)]
    rows += [block("two", 1, 0, "left one", y=50.0), block("two", 1, 1, "right", x=320.0, y=1.0), block("two", 1, 2, "left two", y=90.0), block("two", 1, 3, x=320.0)]
    got = {(r.doc, r.page): (r.text, r.columns, r.has_table) for r in layout.assemble_pages(spark.createDataFrame(rows, layout.BLOCKS)).collect()}
    plain = lambda text: (text, 1, False)
    assert got == {
        ("rep", 1): plain("Body 1"), ("rep", 2): ("Body 2\nDrug | Dose | n = 12", 1, True), ("rep", 3): plain("Body 3"), ("rep", 4): plain("Body 4"),
        ("scan", 1): plain("Text"), ("scan", 2): plain(""), ("scan", 3): plain(""), ("two", 1): ("left one\nleft two\nright", 2, False),
    }


def test_counts_by_text_need_no_exchange(spark):
    """A table of counts by id and term, or of sums by id and bucket, grows with a task's rows."""
    rows = spark.createDataFrame([(1, "Stroke stroke care"), (2, ""), (3, None)], "id long, text string")
    for found in (lexical.postings(rows, "id"), embedding.hash_embed(rows, "id", profile="md5"), embedding.hash_embed(rows, "id")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Aggregate" not in plan
    assert sorted(lexical.postings(rows, "id").collect()) == [(1, "care", 1), (1, "stroke", 2)]
    assert {r.id for r in embedding.hash_vectors(rows, "id").collect()} == {1}


def test_ids_that_repeat_are_summed(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "b c"), (2, "a b"), (None, "x"), (None, "x y"), (4, None), (4, "z")], "id long, text string")
    got = {(r.id, r.term): r.tf for r in lexical.postings(rows, "id").collect()}
    assert got == {(1, "a"): 1, (1, "b"): 2, (1, "c"): 1, (2, "a"): 1, (2, "b"): 1, (None, "x"): 2, (None, "y"): 1, (4, "z"): 1}
    got = {}
    for r in embedding.hash_embed(rows, "id", profile="md5", dimensions=1 << 20).collect():
        got.setdefault(r.id, []).append(round(abs(r.weight), 6))
    # Id 1 holds a, b twice, c, a_b and b_c; no pair crosses two texts.
    assert sorted(got[1]) == [round(x / 8**0.5, 6) for x in (1, 1, 1, 1, 2)] and len(got[None]) == 3 and got[4] == [1.0]


def test_bm25_by_tiles(spark, monkeypatch):
    """The tiled way gives the k best of the joined one, in blocks of questions too."""
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choices("abcdefghij", k=rng.randrange(12)))) for i in range(60)]
    rows = spark.createDataFrame([*texts, (60, None)], "chunk_id long, text string")
    asked = spark.createDataFrame([(q, " ".join(rng.choices("abcdefghijk", k=3))) for q in range(7)], "query_id long, question string")
    ranks = lambda scores: sorted(map(tuple, retrieval.ranked(scores, [F.desc("score"), F.col("chunk_id")], limit=4).collect()))
    joined = ranks(lexical.bm25_scores(asked, lexical.postings(rows), lexical.doc_stats(rows)).withColumn("score", F.round("score", 9)))
    assert ranks(lexical.bm25_topk(asked, rows, 4)) == joined
    for name, value in (("BLOCK_QUESTIONS", 2), ("HELD_QUESTIONS", 1), ("TILE_ROWS", 8)):
        monkeypatch.setattr(retrieval, name, value)
    assert ranks(lexical.bm25_topk(asked, rows, 4)) == joined


@pytest.mark.parametrize("most", [10**6, 0])
def test_dense_topk_by_tiles(spark, monkeypatch, most):
    """Equal vectors tie by id; the pairs' products never become rows."""
    rng = random.Random(5)
    kinds = "\t\x0b\x1c\x1f \x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000"
    rows = [(i, rng.choice(kinds)) for i in range(300)] + [(300, None), (301, [1.0, 2.0])]
    monkeypatch.setattr(retrieval, "BROADCAST_COMPONENTS", most)
    monkeypatch.setattr(retrieval, "BLOCK_QUESTIONS", 3)
    vectors = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    found = retrieval.dense_topk(vectors.where("chunk_id % 40 = 0 or chunk_id = 301").withColumnRenamed("chunk_id", "query_id"), vectors, 5)
    want = set()
    for q, x in rows:
        if x and (q % 40 == 0 or q == 301):
            scored = sorted((-round(sum(a * b for a, b in zip(x, y, strict=True)), 9), i) for i, y in rows if y and len(y) == len(x))
            want |= {(q, i, -s, k) for k, (s, i) in enumerate(scored[:5], 1)}
    assert {(r.query_id, r.chunk_id, r.score, r.rank) for r in found.collect()} == want
    assert "zip_with" not in found._jdf.queryExecution().executedPlan().toString()


def test_top_lists_go_to_the_corpus(spark, monkeypatch):
    """A corpus of texts isn't shuffled to meet a few results; more of them than counted few are joined as Spark sees fit."""
    corpus, found = spark.range(50).withColumnRenamed("id", "chunk_id"), spark.createDataFrame([(3, 1), (7, 2)], "chunk_id long, rank int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, kind in ((10, "BroadcastHashJoin"), (1, "SortMergeJoin")):
            monkeypatch.setattr(retrieval, "BROADCAST_WEIGHTS", most)
            joined = corpus.join(retrieval.few(found), "chunk_id")
            assert kind in joined._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(tuple, joined.collect())) == [(3, 1), (7, 2)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_headings_are_worked_out_once(spark):
    """Not once for each use of a part, nor again in a filter."""
    from plinth import catalogue
    from plinth.functions import rules

    plan = plan_of(catalogue.headings(spark, "/root/testdata/sf0.001"))
    assert plan.count(rules.NUMBERED_HEADING) == 1 and plan.count(rules.LEADING_NUMBER) == 2  # the former begins with the latter
    got = [one(spark, T.heading(F.col("t")), t=t) for t in (" :Methods::\x1f", "1.2  Study design", "No heading here.", "---:", "SEE (BELOW)", "x" * 111, "A B", "::")]
    assert got == ["Methods", "Study design", None, None, "See (Below)", None, "A B", None]


def test_white_space_and_guards_of_noise(spark):
    kinds = "\t\x0b\x1c\x1f \x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000"
    assert one(spark, T.strip(F.col("t")), t=f"{kinds}a{kinds}b{kinds}") == f"a{kinds}b"
    assert one(spark, T.collapse(F.col("t")), t=f"{kinds}a{kinds}b c  d{kinds}") == "a b c d"
    assert one(spark, T.sentences(F.col("t")), t=" One.  Two?  (Three) 4. five! Six ") == ["One.", "Two?", "(Three) 4. five!", "Six"]
    noisy = ("HTTPS://x", "see wWw.x", "see DOI: 10.1", "CopyRight by", "Supplemental Material is", "page 12", "1234")
    clean = ("www x", "http:/x.", "doi 10.1", "xdoi: 10.", "a copyright", "supplemental", "12345", "")
    assert all(one(spark, T.is_noise(F.col("t")), t=t) for t in noisy) and not any(one(spark, T.is_noise(F.col("t")), t=t) for t in clean)


def test_lines_are_cleaned_in_their_page(spark):
    """As merge_hyphens joins them, without windows, sorts or groups of rows."""
    rng = random.Random(6)
    pieces = ["reha-", "bilita-", "tion", "Care-", "-", "", "  a\t b ", "ébauche-", "42", "9-", "www.x.org", "x -", "- 3", "ﬁrst"]
    texts = ["\n".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(80)] + ["", "a-\r\nb-\rc\n\n-\nd"]
    df = pages(spark, *[(f"s{i % 9}", i, t, None) for i, t in enumerate(texts)])
    found = cleaning.clean_lines(df)
    plan = plan_of(found)
    assert not any(x in plan for x in ("Window", "Aggregate", "Sort "))
    rows = []
    for i, t in enumerate(texts):
        lines = [(n, " ".join(x.replace("\t", " ").split(" ")).strip()) for n, x in enumerate(t.replace("\r\n", "\n").replace("\r", "\n").split("\n"))]
        rows += [(f"s{i % 9}", i, n, " ".join(x for x in y.split(" ") if x)) for n, y in lines if y and y not in ("42", "www.x.org")]
    whole = cleaning.merge_hyphens(spark.createDataFrame(rows, "source_id string, page_ord int, line_no int, line string"))
    key = ["source_id", "page_ord", "line_no", "line"]
    assert sorted(map(tuple, found.select(key).collect())) == sorted(map(tuple, whole.select(key).collect()))


def test_sections_need_one_exchange(spark):
    df = pages(spark, ("s", 1, "", None), ("s", 2, "a-\nb.\nMETHODS\nc.", None), ("t", 3, "References\nx", None), ("s", 4, "d .\nBibliography:\ne", ["x", "Y"]))
    found = cleaning.segments(df)
    plan = plan_of(found)
    assert plan.count("Exchange") == 1 and "Join" not in plan and plan.count("LocalTableScan") + plan.count("Scan ExistingRDD") == 1
    got = sorted((r.source_id, r.source_path, r.source_ord, r.seg_id, r.section, r.page_start, r.page_end, r.text) for r in found.collect())
    assert got == [("s", "/c/s", 0, 0, None, 2, 2, "ab."), ("s", "/c/s", 0, 1, "Methods", 2, 4, "c. d.")]


def test_texts_are_packed_once(spark):
    df = pages(spark, ("s", 1, "METHODS\nOne. Two.", None))
    found = chunking.chunks(cleaning.segments(df), Settings())
    assert plan_of(found).count("ArrowEvalPython") == 1 and [r.text for r in found.collect()] == ["Section: Methods\n\nOne. Two."]


def test_tasks_of_layout_grow_in_number_with_the_input(spark, monkeypatch, tmp_path):
    """And not in size: a task sorts its blocks several times."""
    rows = [(f"d{i % 40}", 1 + i // 400, 600.0, i % 10, 0, [10.0, float(i % 7), 0.0, 0.0], [([(f"Text {i % 50}", [10.0, 0.0])],)]) for i in range(1200)]
    spark.createDataFrame(rows, layout.BLOCKS).coalesce(1).write.parquet(f"{tmp_path}/blocks")
    blocks = spark.read.parquet(f"{tmp_path}/blocks")
    few = sorted(map(tuple, layout.assemble_pages(blocks).collect()))
    monkeypatch.setattr(layout, "DEAL_BYTES", 500)
    assert "REPARTITION_BY_NUM" in plan_of(layout.assemble_pages(blocks)) and layout.dealt(blocks).rdd.getNumPartitions() > 4
    assert sorted(map(tuple, layout.assemble_pages(blocks).collect())) == few and len(few) == 120
