"""The library: searches, shelves, notes, orders of books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMPORTS = ["pdf", "epub", "docx", "md", "markdown", "txt"]
PAGE = 30


def search(books: DataFrame, query: str, *fields: str) -> DataFrame:
    """Books with the query in any field, case ignored; a blank query finds all."""
    q = query.strip().lower()
    return books if not q else books.filter(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(q)))


def shelf(books: DataFrame, words: list[str]) -> DataFrame:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(F.lower("category"), F.lit(w))
    return books.filter(cond)


def importable(name: Column) -> Column:
    return F.regexp_like(F.lower(name), F.lit(rf"\.({'|'.join(IMPORTS)})$"))


def document_kind(path: Column) -> Column:
    """Pdf, Epub, Docx, Markdown or Text by extension; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(ext == "pdf", "Pdf").when(ext == "epub", "Epub").when(ext == "docx", "Docx").when(ext.isin("md", "markdown"), "Markdown").when(ext == "txt", "Text")


def with_state(books: DataFrame, states: DataFrame) -> DataFrame:
    """Books with progress and last reading of their reader states, where there are any."""
    return books.join(states.select(F.col("book").alias("id"), F.col("progress").alias("read"), "last_read"), "id", "left").withColumn("progress", F.coalesce("read", "progress")).drop("read")


def notes(notes_: DataFrame, bookmarks: DataFrame, books: DataFrame, fallback: str = "Unknown book") -> DataFrame:
    """Notes and bookmarks with their book's title."""
    both = notes_.withColumn("kind", F.lit("anno")).unionByName(bookmarks.withColumn("kind", F.lit("bookmark")))
    titled = both.join(books.select(F.col("id").alias("book"), "title"), "book", "left")
    return titled.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.lit(fallback)))


def newest(rows: DataFrame, n: int, *tie: str) -> DataFrame:
    return rows.orderBy(F.desc("ts"), *tie).limit(n)


def numeric_key(title: Column) -> Column:
    """A key that sorts digits by value: runs of digits padded to twelve."""
    parts = F.regexp_extract_all(F.lower(title), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(F.regexp_like(p, F.lit("^[0-9]")), F.lpad(p, 12, "0")).otherwise(p)), "")


def page_of(index: Column) -> Column:
    return F.floor(F.greatest(index, F.lit(0)) / PAGE) + 1


def tags(raw: Column, most: int = 12, chars: int = 32) -> Column:
    cut = F.transform(raw, lambda t: F.substring(F.trim(t), 1, chars))
    return F.slice(F.array_distinct(F.filter(cut, lambda t: t != "")), 1, most)
