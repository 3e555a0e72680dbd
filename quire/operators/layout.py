"""Scanned pages: Markdown from layout blocks, tables, front matter, authors.

Blocks are rows (doc, page, ord, label, content); everything but the joining of a document's text is by
row or by window inside a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import trim_ws, words

START, END = "<!-- pdf-table:start -->", "<!-- pdf-table:end -->"


def block_markdown(label: Column, content: Column) -> Column:
    """A block by its label: titles become headings, figures images, captions emphasis, tables stay."""
    text = trim_ws(F.coalesce(content, F.lit("")))
    return (
        F.when(label.isin("doc_title", "title"), F.concat(F.lit("# "), text)).when(label.isin("paragraph_title", "heading"), F.concat(F.lit("## "), text))
        .when(label.isin("image", "figure"), F.concat(F.lit("![]("), text, F.lit(")"))).when(label.isin("figure_title", "caption"), F.concat(F.lit("*"), text, F.lit("*")))
        .when(label.isin("header", "footer", "number", "page_number"), F.lit("")).otherwise(text)
    )


def table_groups(blocks: DataFrame, *doc: str) -> DataFrame:
    """Adds ``table``: the number of the run of table blocks that a block is in, null outside."""
    w = Window.partitionBy(*doc).orderBy("page", "ord")
    is_table = F.col("label") == "table"
    starts = (is_table & ~F.coalesce(F.lag(is_table).over(w), F.lit(False))).cast("int")
    run = F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("table", F.when(is_table, run))


def layout_markdown(blocks: DataFrame, *doc: str) -> DataFrame:
    """The Markdown of each document in reading order; runs of tables between marker lines."""
    w = Window.partitionBy(*doc).orderBy("page", "ord")
    rows = table_groups(blocks, *doc)
    first = F.col("table").isNotNull() & F.lag("table").over(w).isNull()
    last = F.col("table").isNotNull() & F.lead("table").over(w).isNull()
    text = F.concat(F.when(first, F.lit(START + "\n")).otherwise(""), block_markdown(F.col("label"), F.col("content")), F.when(last, F.lit("\n" + END)).otherwise(""))
    rows = rows.withColumn("text", text).filter("text <> ''")
    return rows.groupBy(*doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "ord", "text"))), lambda x: x["text"]), "\n\n").alias("markdown"))


def normalised(markdown: Column) -> Column:
    """Words parted by line ends joined, page numbers dropped, runs of blank lines made one."""
    c = F.regexp_replace(markdown, r"([a-z])-\n([a-z])", "$1$2")
    c = F.regexp_replace(c, r"(?m)^\s*(?:\d{1,4}|[Pp]age \d{1,4}(?: of \d{1,4})?)\s*$", "")
    return trim_ws(F.regexp_replace(c, r"\n\s*\n(?:\s*\n)+", "\n\n"))


def header_boundary(blocks: DataFrame, *doc: str) -> DataFrame:
    """(*doc, boundary): the place of the first block of the body: an abstract, an introduction, or
    prose of 40 words; the number of blocks if there is none."""
    named = F.regexp_like("content", F.lit(r"(?i)^\s*#*\s*(?:abstract|introduction|1\.?\s+introduction|摘要|引言)\b"))
    body = named | (F.size(words(F.col("content"))) >= 40)
    place = F.row_number().over(Window.partitionBy(*doc).orderBy("page", "ord")) - 1
    rows = blocks.withColumn("place", place)
    return rows.groupBy(*doc).agg(F.coalesce(F.min(F.when(body, F.col("place"))), F.count(F.lit(1))).cast("long").alias("boundary"))


def front_matter(blocks: DataFrame, *doc: str) -> DataFrame:
    """Title (the first title block, else the first block) and the line behind it as authors."""
    place = F.row_number().over(Window.partitionBy(*doc).orderBy("page", "ord"))
    rows = blocks.withColumn("place", place)
    titled = F.col("label").isin("doc_title", "title")
    at = rows.groupBy(*doc).agg(F.coalesce(F.min(F.when(titled, F.col("place"))), F.lit(1)).alias("at"))
    both = rows.join(at, list(doc)).filter((F.col("place") == F.col("at")) | (F.col("place") == F.col("at") + 1))
    return both.groupBy(*doc).agg(F.max(F.when(F.col("place") == F.col("at"), trim_ws(F.col("content")))).alias("title"), F.max(F.when(F.col("place") > F.col("at"), trim_ws(F.col("content")))).alias("authors"))


def authors(line: Column) -> Column:
    """Names of an author line, without marks, numbers and degrees."""
    c = F.regexp_replace(line, r"[*†‡§¶\d]+|\b(?:PhD|MD|Ph\.D\.|Dr\.?|Prof\.?)(?![A-Za-z])", "")
    names = F.transform(F.split(c, r"\s*(?:,|;|&|\band\b|、|，)\s*"), lambda x: F.regexp_replace(trim_ws(x), r"\s+", " "))
    return F.filter(names, lambda x: F.regexp_like(x, F.lit(r"^\p{L}[\p{L}.'’-]*(?: \p{L}[\p{L}.'’-]*){1,4}$")))
