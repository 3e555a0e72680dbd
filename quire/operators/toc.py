"""Tables of contents: titles by position, heading pairs, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import heading_key, numberless_key, trim_ws


def reader_items(toc: DataFrame, translated: DataFrame, *doc: str) -> DataFrame:
    """Entries with their translated title by position, the source's where it is blank; entries
    without any title go. progress: how far into the book, 1 to 100."""
    total = toc.groupBy(*doc).agg(F.count(F.lit(1)).alias("n"))
    rows = toc.join(translated.select(*doc, "ord", "translated_title"), [*doc, "ord"], "left").join(total, list(doc))
    title = trim_ws(F.coalesce(F.nullif(trim_ws(F.col("translated_title")), F.lit("")), F.col("source_title")))
    progress = F.least(F.lit(100), F.greatest(F.lit(1), F.floor((F.col("ord") + 1) * 100 / F.col("n")))).cast("long")
    rows = rows.withColumns({"title": title, "progress": progress}).filter("title <> ''")
    return rows.select(*doc, "ord", "title", F.greatest("level", F.lit(1)).alias("level"), "progress", F.when(trim_ws(F.col("source_title")) != F.col("title"), F.col("source_title")).alias("source_title"))


def heading_pairs(source: DataFrame, target: DataFrame, *doc: str) -> DataFrame:
    """(*doc, level, key, title): headings paired by position, for keys that are unique in the source.
    source, target: (*doc, ord, level, title)."""
    both = source.join(target.select(*doc, "ord", F.col("title").alias("target")), [*doc, "ord"]).filter("title <> '' AND target <> ''")
    keyed = both.withColumn("key", heading_key(F.col("title")))
    return keyed.groupBy(*doc, "level", "key").agg(F.count(F.lit(1)).alias("n"), F.first("target").alias("title")).filter("n = 1").drop("n")


def translated_titles(toc: DataFrame, pairs: DataFrame, *doc: str) -> DataFrame:
    """A translated title for each entry: by level and key, else by level and the key without numbers.
    pairs: (*doc, level, key, title)."""
    exact = pairs.select(*doc, "level", "key", F.col("title").alias("by_key"))
    bare = pairs.withColumn("bare", numberless_key(F.col("key"))).groupBy(*doc, "level", "bare").agg(F.count(F.lit(1)).alias("n"), F.first("title").alias("by_bare")).filter("n = 1").drop("n")
    rows = toc.withColumns({"key": heading_key(F.col("source_title")), "bare": numberless_key(F.col("source_title"))})
    rows = rows.join(exact, [*doc, "level", "key"], "left").join(bare, [*doc, "level", "bare"], "left")
    return rows.withColumn("translated_title", F.coalesce("by_key", "by_bare")).drop("key", "bare", "by_key", "by_bare")


def edited(toc: DataFrame, renames: DataFrame, removed: DataFrame, added: DataFrame, *doc: str) -> DataFrame:
    """Entries renamed by position, some removed, new ones put behind others (null: first; a removed
    or unknown place: last), numbered anew. added: (*doc, after, pos, title, level)."""
    rows = toc.join(renames.select(*doc, "ord", F.col("title").alias("new")), [*doc, "ord"], "left").withColumn("title", F.coalesce("new", "title")).drop("new")
    rows = rows.join(removed.select(*doc, "ord"), [*doc, "ord"], "left_anti")
    place = rows.select(*doc, F.col("ord").alias("after"), F.lit(1).alias("known"))
    own = added.join(place, [*doc, "after"], "left")
    # of several behind one place the last added stands first
    at = F.when(F.col("after").isNull(), F.lit(-1).cast("long")).when(F.col("known") == 1, F.col("after")).otherwise(F.lit(2**62))
    within = F.when(F.col("after").isNull() | (F.col("known") == 1), -F.col("pos")).otherwise(F.col("pos"))
    both = rows.select(*doc, F.col("ord").alias("at"), F.lit(-(2**62)).alias("within"), "title", "level").unionByName(own.select(*doc, at.alias("at"), within.alias("within"), "title", F.greatest("level", F.lit(1)).alias("level")))
    return both.withColumn("ord", (F.row_number().over(Window.partitionBy(*doc).orderBy("at", "within")) - 1).cast("long")).select(*doc, "ord", "title", "level")
