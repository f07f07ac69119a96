"""From pages to cleaned lines and sections.

pages: page_ord (order in the corpus), source_id, source_path, title, page_number, text, hierarchy (array, may be null). A window
never holds more than one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import text as T

PAGE = ["source_id", "page_ord"]


def cleaned(text: Column) -> Column:
    """A page's lines as an array of (line_no, line): neither blank nor noise, white space tidied, words parted at line ends joined as
    merge_hyphens does. Each line is tidied once, and judged in the array, not in a filter that would tidy it again for each rule."""
    unix = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    tidied = F.transform(F.split(unix, "\n"), lambda x, i: F.struct(i.alias("line_no"), T.tidied(x).alias("line")))
    kept = F.filter(tidied, lambda x: (x["line"] != "") & ~T.is_noise(x["line"]))
    # No line holds a tab or a line feed any more: these part numbers and lines in one text, where a pattern finds the parted words.
    numbered = F.array_join(F.transform(kept, lambda x: F.concat(x["line_no"].cast("string"), F.lit("\t"), x["line"])), "\n")
    joined = F.filter(F.split(F.regexp_replace(numbered, r"(?U)-\n\d+\t(?=\p{Lower})", ""), "\n"), lambda x: x != "")
    return F.transform(joined, lambda x: F.struct(F.substring_index(x, "\t", 1).cast("int").alias("line_no"), F.substring_index(x, "\t", -1).alias("line")))


def merge_hyphens(lines: DataFrame) -> DataFrame:
    """Words parted at line ends are joined: a line that ends in a hyphen takes the next one if that starts in lower case."""
    order = Window.partitionBy(*PAGE).orderBy("line_no")
    joins = F.coalesce(F.lag("line").over(order).endswith("-") & F.col("line").rlike(r"(?U)^\p{Lower}"), F.lit(False))
    marked = lines.withColumn("joins", joins)
    marked = marked.withColumns({"island": F.sum((~F.col("joins")).cast("int")).over(order), "next_joins": F.coalesce(F.lead("joins").over(order), F.lit(False))})
    piece = F.when(F.col("next_joins"), F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
    rest = [c for c in lines.columns if c not in (*PAGE, "line_no", "line")]
    parts = F.array_sort(F.collect_list(F.struct("line_no", piece.alias("piece"))))
    merged = marked.groupBy(*PAGE, "island").agg(*[F.first(c).alias(c) for c in rest], F.min("line_no").alias("line_no"), parts.alias("parts"))
    return merged.withColumn("line", F.array_join(F.transform("parts", lambda p: p["piece"]), "")).drop("parts", "island")


def clean_lines(pages: DataFrame) -> DataFrame:
    """One row for each line of cleaned()."""
    # Outer, and filtered behind: else each list would be worked out a second time to see that it isn't empty.
    lines = pages.repartition("source_id").select("*", F.explode_outer(cleaned(F.col("text"))).alias("kept")).drop("text").where("kept is not null")
    return lines.select("*", "kept.*").drop("kept")


def segments(pages: DataFrame) -> DataFrame:
    """Sections: source_id, source_path, title, source_ord, seg_id, section, page_start, page_end, text. Heading lines leave the body and
    name what follows, across pages; all from a references heading on is dropped; a page's hierarchy names lines before any heading.

    Pages are dealt by source before they become lines, once: whatever is done by source needs no other exchange and no join."""
    upto = Window.partitionBy("source_id").orderBy("page_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seed = F.nullif(F.element_at("hierarchy", -1), F.lit(""))
    rows = pages.repartition("source_id").select(*PAGE, "page_number", "source_path", "title", "text", F.when(F.size("hierarchy") > 1, seed).alias("seed"))
    first = {"source_path": F.first("source_path").over(upto), "title": F.first("title").over(upto), "source_ord": F.first("page_ord").over(upto)}
    rows = rows.withColumns(first)
    # A page's seed goes before its lines, as a line without text.
    none = F.array().cast("array<struct<line_no:int,line:string>>")
    seeded = F.when(F.col("seed").isNotNull(), F.array(F.struct(F.lit(-1).alias("line_no"), F.lit(None).cast("string").alias("line")))).otherwise(none)
    rows = rows.select("*", F.explode_outer(F.concat(seeded, cleaned(F.col("text")))).alias("kept")).drop("text").where("kept is not null").select("*", "kept.*").drop("kept")
    rows = rows.withColumns({"seed": F.when(F.col("line").isNull(), F.col("seed")), "is_ref": F.coalesce(T.is_reference_heading(F.col("line")), F.lit(False)), "heading": T.heading(F.col("line"))})
    upto = Window.partitionBy("source_id").orderBy("page_ord", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("stopped", F.max("is_ref").over(upto)).where(~F.col("stopped"))
    rows = rows.withColumns({"seg_id": F.count("heading").over(upto), "section": F.last("heading", ignorenulls=True).over(upto)})
    place = F.struct("page_ord", "line_no")
    in_body = F.col("line").isNotNull() & F.col("heading").isNull()
    found = rows.groupBy("source_id", "seg_id").agg(
        *[F.first(c).alias(c) for c in first],
        F.coalesce(F.max("section"), F.min_by("seed", F.when(F.col("seed").isNotNull(), place))).alias("section"),
        F.min_by("page_number", F.when(in_body & F.col("page_number").isNotNull(), place)).alias("page_start"),
        F.max_by("page_number", F.when(in_body, place)).alias("page_end"),
        F.array_sort(F.collect_list(F.when(in_body, F.struct("page_ord", "line_no", "line")))).alias("lines"),
    )
    # No line is blank, so a text is empty only if it has no lines.
    return found.where(F.size("lines") > 0).withColumn("text", T.lines_to_text(F.transform("lines", lambda x: x["line"]))).drop("lines")
