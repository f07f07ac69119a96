"""Answers from ranked chunks: excerpts, citations, prompts, evaluation.

results: query_id, question, answer_mode, rank and a chunk's columns. Rules are rows of data in plinth.functions.rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import rules
from plinth.functions import text as T
from plinth.operators.retrieval import evidence_text, is_diet


def citation() -> Column:
    return F.struct(
        F.col("rank").cast("int").alias("id"), F.coalesce("source_id", F.lit("unknown")).alias("source"), F.col("page"), F.col("chunk_id"),
        F.round("score", 6).alias("score"), T.citation_excerpt(F.col("text")).alias("excerpt"),
    )


def by_mode(texts: dict[str, str]) -> Column:
    return F.when(F.col("answer_mode") == "clinician", texts["clinician"]).otherwise(texts["patient"])


def diet_answer(hits: Column) -> Column:
    """hits: (rank, words) of each result. A part for each family that some result speaks of, citing the first that does."""
    first = {name: F.array_min(F.transform(F.filter(hits, lambda h: T.has_any(h["words"], vocabulary)), lambda h: h["rank"])) for name, vocabulary, _ in rules.DIET_FAMILIES}
    parts = []
    for name, _, texts in rules.DIET_FAMILIES:
        halves = [by_mode({k: v.split("{}")[i] for k, v in texts.items()}) for i in (0, 1)]
        parts.append(F.when(first[name].isNotNull(), F.concat(halves[0], first[name].cast("string"), halves[1])))
    none = reduce(lambda a, b: a & b, [f.isNull() for f in first.values()])
    parts.append(F.when(none, F.lit(rules.DIET_UNCLEAR)))
    parts.append(F.when(first["food pattern"].isNull(), F.lit(rules.DIET_NO_PLAN)))
    return F.concat_ws("\n\n", *parts, F.lit(rules.SAFETY_NOTICE))


def extractive_answers(questions: DataFrame, results: DataFrame) -> DataFrame:
    """questions (query_id, question, answer_mode) with answer and citations; those without results get the refusal."""
    rows = results.select(
        "query_id", "rank", citation().alias("citation"), T.best_excerpt(F.col("text"), F.col("question")).alias("excerpt"), F.array_distinct(T.words(F.lower(evidence_text()))).alias("words"),
    )
    row = F.array_sort(F.collect_list(F.struct("rank", "citation", "excerpt", "words")))
    found = rows.groupBy("query_id").agg(row.alias("rows"))
    joined = questions.join(found, "query_id", "left")
    passages = F.transform(F.slice("rows", 1, rules.ANSWER_RESULTS), lambda r: F.concat(r["excerpt"], F.lit(" ["), r["rank"].cast("string"), F.lit("]")))
    extract = F.concat_ws("\n\n", by_mode(rules.OPENERS), F.array_join(passages, "\n\n"), F.lit(rules.SAFETY_NOTICE))
    answer = F.when(F.col("rows").isNull(), rules.NO_RESULT).when(is_diet(F.col("question")), diet_answer(F.col("rows"))).otherwise(extract)
    empty = F.array().cast("array<struct<id:int,source:string,page:int,chunk_id:string,score:double,excerpt:string>>")
    cited = F.coalesce(F.transform("rows", lambda r: r["citation"]), empty)
    return joined.withColumns({"answer": answer, "citations": cited}).drop("rows")


def system_prompt() -> Column:
    return F.concat(F.lit(rules.SYSTEM_PROMPT + "\n\n"), by_mode(rules.MODE_INSTRUCTIONS))


def user_prompts(questions: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, system_prompt, user_prompt) for a generating model."""
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit(", page "), F.col("page").cast("string"))).otherwise("")
    passage = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", "source_id", F.lit("Unknown")), page, F.lit("\n"), F.col("text"))
    found = results.select("query_id", "rank", passage.alias("passage")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "passage"))).alias("rows"))
    joined = questions.join(found, "query_id", "left")
    shown = F.coalesce(F.array_join(F.transform("rows", lambda r: r["passage"]), "\n\n"), F.lit(""))
    prompt = F.concat(F.lit(rules.USER_PROMPT + "Use "), F.col("answer_mode"), F.lit(" answer mode.\n\nQuestion: "), F.col("question"), F.lit("\n\nRetrieved passages:\n\n"), shown)
    return joined.select("query_id", system_prompt().alias("system_prompt"), prompt.alias("user_prompt"))


def evaluation(rows: DataFrame) -> DataFrame:
    """rows: id, source_hints, answer_terms, should_refuse, sources, excerpts, answer. Adds hit, relevance, refused."""
    hit = F.exists("sources", lambda s: F.exists("source_hints", lambda h: F.contains(F.lower(s), F.lower(h))))
    about = F.filter("excerpts", lambda e: F.exists("answer_terms", lambda t: F.contains(F.lower(e), F.lower(t))))
    relevance = F.when(F.size("answer_terms") == 0, 1.0).when(F.size("sources") == 0, 0.0).otherwise(F.size(about) / F.size("sources"))
    said = reduce(lambda a, b: a | b, [F.contains(F.lower("answer"), F.lit(p)) for p in rules.REFUSAL_PHRASES])
    return rows.withColumns({"hit": hit, "relevance": relevance, "refused": (F.size("sources") == 0) | said})


def evaluation_summary(judged: DataFrame) -> DataFrame:
    inside, outside = ~F.col("should_refuse"), F.col("should_refuse")
    return judged.agg(
        F.count_if(inside).alias("in_scope"), F.avg(F.when(inside, F.col("hit").cast("double"))).alias("hit_rate"), F.avg(F.when(inside, F.col("relevance"))).alias("mean_relevance"),
        F.avg(F.when(outside, F.col("refused").cast("double"))).alias("refusal_correctness"),
        F.count_if(inside & ~(F.col("hit") & (F.col("relevance") >= rules.LEAST_RELEVANCE))).alias("failed"),
    )
