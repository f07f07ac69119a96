"""Text of laid-out pages from their blocks.

blocks: doc, page, width, block_no, type, bbox (x0, y0, x1, y1), lines (array of spans (array of text and bbox)). One row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions import rules
from plinth.functions import text as T
from plinth.runtime import input_bytes, shuffle_partitions

#: Bytes of input files for each task that holds documents' blocks, at most: compressed, a task's sorts take some fifty times as many.
DEAL_BYTES = 4 << 20
BLOCKS = "doc string, page int, width double, block_no int, type int, bbox array<double>, lines array<struct<spans:array<struct<text:string,bbox:array<double>>>>>"


def spans_with_text(lines: Column) -> Column:
    return F.filter(F.flatten(F.transform(lines, lambda x: x["spans"])), lambda s: T.strip(s["text"]) != "")


def block_text(lines: Column) -> Column:
    parts = F.transform(lines, lambda x: F.array_join(F.transform(F.filter(x["spans"], lambda s: T.strip(s["text"]) != ""), lambda s: s["text"]), ""))
    return T.strip(F.array_join(F.filter(parts, lambda p: p != ""), " "))


def is_table_row(lines: Column) -> Column:
    """Three spans in three places at least, most of them short. Places are tens of points, halves rounded to even."""
    spans = spans_with_text(lines)
    places = F.array_distinct(F.transform(spans, lambda s: F.rint(F.get(s["bbox"], 0) / 10)))
    short = F.filter(spans, lambda s: F.length(T.strip(s["text"])) < rules.TABLE_SHORT)
    return (F.size(spans) >= rules.TABLE_SPANS) & (F.size(places) >= rules.TABLE_COLUMNS) & (F.size(short) >= rules.TABLE_SHORT_SHARE * F.size(spans))


def table_row(lines: Column) -> Column:
    return F.array_join(F.transform(spans_with_text(lines), lambda s: T.strip(s["text"])), " | ")


def normalised(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def repeated_texts(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, norm): headers and footers. texts: doc, page, norm; pages: doc, page. Each page counts once."""
    counted = texts.where((F.col("norm") != "") & (F.length("norm") < rules.REPEAT_CHARS)).select("doc", "page", "norm").distinct().groupBy("doc", "norm").agg(F.count(F.lit(1)).alias("n"))
    sizes = pages.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    least = F.greatest(F.lit(rules.REPEAT_LEAST), F.floor(F.col("pages") * rules.REPEAT_SHARE))
    return counted.join(sizes, "doc").where(F.col("n") >= least).select("doc", "norm", "n")


def placed(rows: DataFrame) -> DataFrame:
    """Adds columns (1 or 2) and place to rows of doc, page, width, block_no, x, y, is_text: by y, or left column first. Blocks that
    aren't text come last and count for nothing."""
    page = Window.partitionBy("doc", "page")
    right = (F.col("x") > rules.COLUMN_AT * F.col("width")).cast("int")
    two = (F.avg(F.when(F.col("is_text"), right)).over(page) > rules.COLUMN_SHARE) & (F.col("width") > 0)
    rows = rows.withColumn("columns", F.when(two, 2).otherwise(1))
    side = F.when(F.col("columns") == 2, right).otherwise(0)
    return rows.withColumn("place", F.row_number().over(page.orderBy(F.desc("is_text"), side, "y", "block_no")))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks of text with columns and place."""
    rows = blocks.where("type = 0").withColumns({"x": F.get("bbox", 0), "y": F.get("bbox", 1), "is_text": F.lit(True)})
    return placed(rows).drop("x", "y", "is_text")


def dealt(rows: DataFrame) -> DataFrame:
    """By document, in as many tasks as spark.sql.shuffle.partitions says, or more if the input is too large for so few."""
    n = -(-input_bytes(rows) // DEAL_BYTES)
    return rows.repartition(n, "doc") if n > shuffle_partitions(rows.sparkSession) else rows.repartition("doc")


def assemble_pages(blocks: DataFrame) -> DataFrame:
    """(doc, page, text, columns, has_table) for each page that has any block. All from a references heading on is dropped: the page
    where it stands keeps what is above it, and later pages go.

    Blocks become texts first and are then dealt by document, once: whatever is done by document, page or text needs no other
    exchange and no join. Sorts hold a block's text once, and a short one's normal form. A window holds one document's blocks at most."""
    is_table = is_table_row(F.col("lines"))
    rows = blocks.select(
        "doc", "page", "width", "block_no", F.get("bbox", 0).alias("x"), F.get("bbox", 1).alias("y"), F.coalesce(F.col("type") == 0, F.lit(False)).alias("is_text"),
        block_text(F.col("lines")).alias("raw"), F.when(is_table, table_row(F.col("lines"))).alias("row"),
    )
    rows = placed(dealt(rows.withColumn("noise", T.is_noise(F.col("raw"))))).drop("width", "block_no", "x", "y")
    rows = rows.withColumn("norm", F.when(F.col("is_text") & (F.col("raw") != ""), normalised(F.col("raw"))))
    rows = rows.select(
        "doc", "page", "place", "columns", "is_text", "noise", F.coalesce("row", "raw").alias("line"), F.col("row").isNotNull().alias("is_row"), F.col("norm").isNotNull().alias("held"),
        F.when((F.col("norm") != "") & (F.length("norm") < rules.REPEAT_CHARS), F.col("norm")).alias("short"), F.coalesce(T.without_colons(F.col("norm")).isin(*rules.REFERENCE_HEADINGS), F.lit(False)).alias("names_ref"),
    )
    whole, same = Window.partitionBy("doc"), Window.partitionBy("doc", "short")
    first_of_page = (F.col("place") == 1).cast("int")
    first_in_page = (F.row_number().over(Window.partitionBy("doc", "short", "page").orderBy("place")) == 1).cast("int")
    rows = rows.withColumn("first_in_page", first_in_page).withColumn("n", F.sum("first_in_page").over(same)).withColumn("pages", F.sum(first_of_page).over(whole))
    repeated = F.col("short").isNotNull() & (F.col("n") >= F.greatest(F.lit(rules.REPEAT_LEAST), F.floor(F.col("pages") * rules.REPEAT_SHARE)))
    rows = rows.withColumn("seen", F.col("held") & ~repeated).drop("short", "first_in_page", "n", "pages")
    upto = whole.orderBy("page", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("is_ref", F.col("seen") & F.col("names_ref"))
    rows = rows.withColumns({"stopped": F.max("is_ref").over(upto), "last": F.min(F.when(F.col("is_ref"), F.col("page"))).over(whole)})
    rows = rows.where(F.col("last").isNull() | (F.col("page") <= F.col("last"))).withColumn("kept", F.col("seen") & ~F.col("stopped") & ~F.col("noise"))
    lines = F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("place", "line"))))
    return rows.groupBy("doc", "page").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"), F.coalesce(F.max(F.when(F.col("is_text"), F.col("columns"))), F.lit(1)).alias("columns"),
        F.max(F.col("kept") & F.col("is_row")).alias("has_table"),
    )
