"""Tables that the catalogue derives from the given ones, for rules that plain prose seldom meets: documents wrapped into lines, pages
and blocks, with noise, headings, hyphens, headers and references planted by position; documents as hits and as judged answers.

What both the queries and their SQL need to read the same input is stated once, in expressions that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions import text as T

PAGE_LINES = 12
NOISE = ("42", "Page 5", "page12", "12345", "Page", "doi: 10.1161/x", "See DOI:10.1/abc here", "https://example.org/a", "visit www.example.org", "Copyright 2020 by them", "downloaded from there", "Published by X", "All rights reserved.", "Supplemental material is online", "Patients aged 42", "The dose was 10 mg", "supplement", "")
HYPHENS = ("reha-", "bilita-", "tion helps", "post-", "Stroke care", "ends with-", "a", "b-", "ébauche", "c", "-", "x-", "9y")
HEADINGS = ("RESULTS", "Background and purpose", "Methods:", "1.2 Study design", "POST-STROKE CARE", "Key Points", "AB", "Summary.", "The patients were seen.", "Acute Stroke Management", "Note: see below", "Early Mobilisation and Rehabilitation After Stroke", "acute stroke care:", "One two three Four", "One Two Three four", "A very long heading of more than twelve words that nobody would use at all here", "12) Outcomes", "---:", "Treatment", "Mean (SD) Values", "ÉTUDE CLINIQUE", "x" * 111)
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def one_of(values: tuple[str, ...], number: str) -> str:
    return f"split_part('{'|'.join(values)}', '|', CAST(({number}) % {len(values)} + 1 AS INT))"


#: A document's i-th line (from 0), or what is planted in its place.
LINE = f"""CASE WHEN i = 40 + doc_id % 50 THEN 'References:' WHEN (doc_id + i) % 16 = 0 THEN {one_of(NOISE, "i")} WHEN (doc_id + i) % 16 = 3 THEN {one_of(HEADINGS, "i")}
  WHEN (doc_id + i) % 16 = 5 THEN translate(left(line, 40), '{LETTERS}', '{LETTERS.upper()}') WHEN (doc_id + i) % 16 = 8 THEN concat('1.', CAST(i AS STRING), ' ', left(line, 60))
  WHEN (doc_id + i) % 16 = 11 THEN concat(left(line, 30), ':') WHEN (doc_id + i) % 8 = 6 THEN {one_of(HYPHENS, "i")} ELSE line END"""
#: A line as a block of a page that is 600 wide: even pages have two columns, blocks share heights, some are pictures, some table rows.
BLOCK = (
    "doc_id AS doc", f"CAST(floor(i / {PAGE_LINES}) AS INT) + 1 AS page", f"CAST(i % {PAGE_LINES} AS INT) AS block_no", "(doc_id + i) % 13 = 12 AS is_picture", "(doc_id + i) % 5 = 0 AS is_row",
    "CAST(CASE WHEN (doc_id + i) % 10 = 0 THEN 45 ELSE 4 END AS DOUBLE) AS gap", f"CASE WHEN i % {PAGE_LINES} = 0 THEN concat('Journal  of ', coalesce(lang, '')) ELSE line END AS line",
    f"CAST(CASE WHEN floor(i / {PAGE_LINES}) % 2 = 1 AND i % 2 = 1 THEN 320 ELSE 10 END AS DOUBLE) AS x", "CAST(i * 7 % 6 * 10 AS DOUBLE) AS y",
)
#: Four documents in a row are the hits of a question.
HIT_TEXTS = ("Screen swallowing before meals.", "Eat fruit and less salt.", "Nasogastric feeding is reasonable.", "Nutrition matters.", "Aspiration risk and saturated fat.", "Statins lower risk.", "")
HIT = (
    "doc_id", "CAST(floor(doc_id / 4) AS BIGINT) AS query_id", "CAST(doc_id % 4 + 1 AS INT) AS rank", "CASE WHEN floor(doc_id / 4) % 2 = 0 THEN 'patient' ELSE 'clinician' END AS answer_mode",
    f"concat(coalesce(text, ''), ' ', CASE WHEN floor(doc_id / 4) % 3 = 0 THEN '' ELSE {one_of(HIT_TEXTS, 'doc_id')} END) AS text", f"{one_of(('Guide', 'Tubes', 'General', 'Mixed Diet', 'Drugs'), 'doc_id')} AS title",
    f"nullif({one_of(('', 'Prevention', 'Results'), 'doc_id')}, '') AS section", "coalesce(source, '') AS source_id",
)
QUESTION = f"concat(coalesce(text, ''), ' ', {one_of(('eat', 'tPA', 'meals', 'MEALTIME', 'dietary', 'Food'), 'item_id')})"
#: A document as an answer that is judged; lists as texts with bars.
JUDGED = (
    "CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN concat(coalesce(source, ''), '|zz') ELSE 'Guide' END AS hints", "CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat(split_part(plain, ' ', 2), '|', split_part(plain, ' ', 40)) END AS terms",
    "CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 6 = 1 THEN 'a.pdf|b.pdf' ELSE concat('SRC1.pdf|guide', coalesce(source, ''), '.pdf') END AS sources", "CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat(left(plain, 200), '|', substring(plain, 201, 200)) END AS excerpts",
    "CASE WHEN doc_id % 7 = 0 THEN 'I cannot find that.' WHEN doc_id % 7 = 1 THEN 'There is No Relevant passage.' ELSE left(plain, 80) END AS answer", "doc_id % 9 < 2 AS should_refuse", "doc_id AS id",
)
PLAIN = "translate(coalesce(text, ''), '|', ' ') AS plain"


def line_arrays(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, lines): words are parted by hyphens where a line would pass sixty characters."""
    wrapped = F.regexp_replace(F.coalesce("text", F.lit("")), r"([^\n]{59}\p{L})(\p{Ll})", "$1-\n$2")
    planted = docs.select("doc_id", "lang", F.split(wrapped, "\n").alias("raw")).selectExpr("doc_id", "lang", f"transform(raw, (line, i) -> {LINE}) AS lines")
    return planted.withColumn("lines", F.transform("lines", T.tidied))


def line_rows(docs: DataFrame) -> DataFrame:
    # Outer, as no list is empty: else each list would be worked out a second time to see that it isn't.
    return line_arrays(docs).select("doc_id", "lang", F.posexplode_outer("lines").alias("i", "line"))


def pages(docs: DataFrame) -> DataFrame:
    """Each document as a source of pages of twelve lines."""
    last = F.floor((F.size("lines") - 1) / PAGE_LINES).cast("int")
    texts = F.transform(F.sequence(F.lit(0), last), lambda p: F.array_join(F.slice("lines", p * PAGE_LINES + 1, F.lit(PAGE_LINES)), "\n"))
    found = line_arrays(docs).select("doc_id", F.posexplode_outer(texts).alias("p", "text"))
    return found.select(
        (F.col("p") + 1).alias("page_ord"), F.col("doc_id").alias("source_id"), F.concat(F.lit("/corpus/"), "doc_id").alias("source_path"), F.concat(F.lit("Document "), "doc_id").alias("title"),
        (F.col("p") + 1).alias("page_number"), "text", F.lit(None).cast("array<string>").alias("hierarchy"),
    )


def blocks(docs: DataFrame) -> DataFrame:
    """Each document's lines as blocks of laid-out pages, as the operators of layout take them."""
    rows = line_rows(docs).selectExpr(*BLOCK)
    span = lambda t, x: F.struct(t.alias("text"), F.array(x, F.col("y"), x + 20, F.col("y") + 10).alias("bbox"))
    words = F.transform(F.slice(F.split("line", " "), 1, 4), lambda w, k: span(w, F.col("x") + k * F.col("gap")))
    spans = F.when(F.col("is_row"), words).otherwise(F.array(span(F.col("line"), F.col("x"))))
    lines = F.when(F.col("is_picture"), F.array().cast("array<struct<spans:array<struct<text:string,bbox:array<double>>>>>")).otherwise(F.array(F.struct(spans.alias("spans"))))
    return rows.select("doc", "page", F.lit(600.0).alias("width"), "block_no", F.col("is_picture").cast("int").alias("type"), F.array("x", "y", F.col("x") + 50, F.col("y") + 10).alias("bbox"), lines.alias("lines"))


def hits(docs: DataFrame) -> DataFrame:
    return docs.selectExpr(*HIT).withColumns({"chunk_id": F.col("doc_id").cast("string"), "page": F.lit(1), "score": F.lit(0.02), "question": F.lit("What should I eat?")})


def judged(docs: DataFrame) -> DataFrame:
    parts = lambda name: F.filter(F.split(name, "[|]"), lambda x: x != "")
    rows = docs.selectExpr("doc_id", "source", PLAIN).selectExpr(*JUDGED)
    return rows.select("id", parts("hints").alias("source_hints"), parts("terms").alias("answer_terms"), parts("sources").alias("sources"), parts("excerpts").alias("excerpts"), "answer", "should_refuse")


# -- the same in SQL ----------------------------------------------------------------------------------------------------------

SQL_LINES = rf"""
wrapped AS (SELECT doc_id, lang, string_split(regexp_replace(coalesce(text, ''), '([^\n]{{59}}\p{{L}})(\p{{Ll}})', '\1-' || chr(10) || '\2', 'g'), chr(10)) AS parts FROM documents),
cut_lines AS (SELECT doc_id, lang, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS i FROM wrapped),
sheet AS (SELECT doc_id, lang, i, trim(regexp_replace({LINE}, '[ \t]+', ' ', 'g')) AS line FROM cut_lines)"""
SQL_BLOCKS = f"""{SQL_LINES},
boxes AS (SELECT {', '.join(BLOCK)} FROM sheet),
texts AS (SELECT *, CASE WHEN is_row THEN string_split(line, ' ')[1:4] ELSE [line] END AS words FROM boxes WHERE NOT is_picture),
spans AS (SELECT doc, page, block_no, x, y, gap, unnest(words) AS t, generate_subscripts(words, 1) - 1 AS k FROM texts),
blocks AS (SELECT doc, page, block_no, any_value(x) AS x0, any_value(y) AS y0, coalesce(trim(string_agg(t, '' ORDER BY k) FILTER (trim(t) <> '')), '') AS raw,
  coalesce(count(*) FILTER (trim(t) <> '') >= 3 AND count(DISTINCT round_even((x + k * gap) / 10, 0)) FILTER (trim(t) <> '') >= 3 AND count(*) FILTER (trim(t) <> '' AND length(trim(t)) < 40) >= 0.7 * count(*) FILTER (trim(t) <> ''), false) AS is_table,
  coalesce(string_agg(trim(t), ' | ' ORDER BY k) FILTER (trim(t) <> ''), '') AS row FROM spans GROUP BY ALL),
cols AS (SELECT *, CASE WHEN avg(CASE WHEN x0 > 270 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page) > 0.3 THEN 2 ELSE 1 END AS columns FROM blocks),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY CASE WHEN columns = 2 AND x0 > 270 THEN 1 ELSE 0 END, y0, block_no) AS place FROM cols)"""
SQL_JUDGED = f"""
bars AS (SELECT {', '.join(JUDGED)} FROM (SELECT doc_id, source, {PLAIN} FROM documents)),
lists AS (SELECT id, answer, should_refuse, {', '.join(f"list_filter(string_split({n}, '|'), lambda x: x <> '') AS {n}" for n in ('hints', 'terms', 'sources', 'excerpts'))} FROM bars)"""
