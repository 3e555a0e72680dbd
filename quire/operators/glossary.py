"""Glossaries and terms: overlays, decks, occurrence statistics, first-seen consistency, wave deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import ascii_lower, collapse, mentions, quoted, term_key, trim_ws

ENTRIES, CAST = 2_000, 40


def first_per(rows: DataFrame, key: Column, order: list, *by: str) -> DataFrame:
    """The first row of each key: ``row_number`` as a minimum of the order, with partial results."""
    cols = rows.columns
    return rows.withColumn("_key", key).groupBy(*by, "_key").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r")).select("_r.*")


def normalised(rows: DataFrame, source: str, target: str, pos: str, *by: str) -> DataFrame:
    """Trimmed entries without blank ones, the first of each source (ASCII case ignored)."""
    rows = rows.withColumns({source: trim_ws(F.col(source)), target: trim_ws(F.col(target))}).filter((F.col(source) != "") & (F.col(target) != ""))
    return first_per(rows, ascii_lower(F.col(source)), [pos], *by)


def capped(rows: DataFrame, most: int = ENTRIES) -> DataFrame:
    """The rows, or an error if there are more than allowed."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))  # at most ``most`` rows may pass
    small = rows.limit(most + 1).withColumn("_n", n)
    ok = F.when(F.col("_n") <= most, F.lit(True)).otherwise(F.raise_error(F.lit(f"more than {most} entries")).cast("boolean"))
    return small.filter(ok).drop("_n")


def overlay(entries: DataFrame, overrides: DataFrame) -> DataFrame:
    """Renames, then new translations, then overrides without an entry as entries of origin user.
    entries: (source, translation, occurrences, origin); overrides: (source, translation, rename_from)."""
    old = overrides.filter(F.coalesce("rename_from", F.lit("")) != "").select(ascii_lower(F.col("rename_from")).alias("k"), F.col("source").alias("renamed"))
    rows = entries.join(old, ascii_lower(F.col("source")) == F.col("k"), "left")
    rows = rows.withColumn("origin", F.when(F.col("renamed").isNotNull(), "user").otherwise(F.col("origin"))).withColumn("source", F.coalesce("renamed", "source")).drop("k", "renamed")
    new = overrides.select(ascii_lower(F.col("source")).alias("k"), F.col("translation").alias("new"))
    kept = rows.join(new, ascii_lower(F.col("source")) == F.col("k"), "left").withColumn("translation", F.coalesce("new", "translation")).select("source", "translation", "occurrences", "origin")
    own = rows.select(ascii_lower(F.col("source")).alias("k")).distinct()
    added = overrides.join(own, ascii_lower(F.col("source")) == F.col("k"), "left_anti")
    return kept.unionByName(added.select("source", "translation", F.lit(0).cast("long").alias("occurrences"), F.lit("user").alias("origin")))


def listing(entries: DataFrame, pos: str = "pos") -> DataFrame:
    """One entry for each source (ASCII case ignored), that with most occurrences, in display order."""
    return first_per(entries, ascii_lower(F.col("source")), [-F.col("occurrences"), F.col(pos)]).orderBy(F.desc("occurrences"), "source")


def deck_entries(decks: DataFrame) -> DataFrame:
    """Entries of enabled decks; an earlier deck wins. decks: (deck_pos, enabled, pos, source, target)."""
    return first_per(decks.filter("enabled"), ascii_lower(F.col("source")), [F.col("deck_pos"), F.col("pos")])


def merged(entries: DataFrame, *by: str) -> DataFrame:
    """Entries of a glossary by normalised source, translation, category and origin."""
    return entries.groupBy(*by, term_key(F.col("source")).alias("key"), "translation", "category", "origin").agg(
        F.max("occurrences").alias("occurrences"), F.min("first_chunk").alias("first_chunk"), F.max("matched").alias("matched"), F.array_sort(F.collect_set("heading")).alias("headings")
    )


def wave_delta(terms: DataFrame, *by: str) -> DataFrame:
    """Terms of a wave in order, neighbours of one source (ASCII case ignored) and target once, numbered."""
    rows = terms.withColumns({"source": trim_ws(F.col("source")), "target": trim_ws(F.col("target"))}).filter("source <> '' AND target <> ''")
    order = Window.partitionBy(*by).orderBy("source", "target", "chunk")
    same = (ascii_lower(F.lag("source").over(order)) == ascii_lower(F.col("source"))) & (F.lag("target").over(order) == F.col("target"))
    kept = rows.withColumn("_same", F.coalesce(same, F.lit(False))).filter("NOT _same").drop("_same")
    return kept.withColumn("seq", F.row_number().over(order).cast("long"))


def first_seen(terms: DataFrame, *by: str) -> DataFrame:
    """Adds ``anchor``: the translation with which the term was first confirmed. The first of each
    key is a minimum that partial results give, joined back."""
    key = term_key(F.col("source"))
    rows = terms.withColumn("key", key)
    first = rows.groupBy(*by, "key").agg(F.min_by("translation", F.struct("chunk", "pos", "translation")).alias("anchor"))
    return rows.join(first, [*by, "key"])


def hint_order(hints: DataFrame) -> DataFrame:
    return hints.orderBy(*_hint_keys())


def hint_places(hints: DataFrame) -> DataFrame:
    """Adds each hint's place in that order, from 1."""
    return hints.withColumn("place", F.row_number().over(Window.orderBy(*_hint_keys())).cast("long"))


def _hint_keys() -> list:
    return [F.desc(F.col("target").isNotNull()), F.desc("occurrences"), "first_chunk", "source", "id"]


def cast_block(hints: DataFrame, most: int = CAST, *by: str) -> DataFrame:
    """The first strict hints with a target, by first chunk and source."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("first_chunk", "source", "id"))
    return hints.filter("enforcement = 'strict' AND target IS NOT NULL").withColumn("rank", rank).filter(F.col("rank") <= most)


def selection_order(hints: DataFrame, *by: str) -> DataFrame:
    strict = F.when((F.col("enforcement") == "strict") & F.col("target").isNotNull(), 0).otherwise(1)
    return hints.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(strict, "first_chunk", "source", "id")).cast("long"))


def occurrence_stats(terms: DataFrame, chunks: DataFrame, *by: str) -> DataFrame:
    """How often and where each term stands in the chunks' sources: (term, occurrences, first_chunk,
    matched). A term's first word joins it to the chunks that hold this word; the exact count follows.
    terms: (*by, term)."""
    word = lambda c: F.regexp_extract(ascii_lower(c), "[a-z0-9]+", 0)
    held = chunks.select(*by, "idx", "source", F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("source")), F.lit("[a-z0-9]+"), F.lit(0)))).alias("w"))
    hits = terms.select(*by, "term").distinct().withColumn("w", word(F.col("term"))).join(held, [*by, "w"])
    count = F.regexp_count("source", quoted(F.col("term")))
    return hits.withColumn("n", count).filter("n > 0").groupBy(*by, "term").agg(F.sum("n").cast("long").alias("occurrences"), F.min("idx").alias("first_chunk"), F.count(F.lit(1)).alias("matched"))


def mentioned(terms: DataFrame, chunks: DataFrame, *by: str) -> DataFrame:
    """(*by, idx, term): chunks that mention a term at word boundaries, joined on the first word."""
    word = lambda c: F.regexp_extract(c, "[A-Za-z0-9]+", 0)
    held = chunks.select(*by, "idx", "source", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit("[A-Za-z0-9]+"), F.lit(0)))).alias("w"))
    hits = terms.select(*by, "term").distinct().withColumn("w", word(F.col("term"))).join(held, [*by, "w"])
    return hits.filter(mentions(F.col("source"), F.col("term"))).select(*by, "idx", "term")


def whole_counts(terms: DataFrame, chunks: DataFrame, *by: str) -> DataFrame:
    """Terms that the sources of a task hold while its translations lack the target. terms: (*by, term, target)."""
    pairs = terms.join(chunks, list(by))
    sums = pairs.groupBy(*by, "term", "target").agg(F.sum(F.regexp_count("source", quoted(F.col("term")))).alias("in_source"), F.sum(F.coalesce(F.regexp_count("translated", quoted(F.col("target"))), F.lit(0))).alias("in_target"))
    return sums.filter("in_source > 0 AND in_target = 0")


def proper_noun_issues(hints: DataFrame, chunks: DataFrame, *by: str) -> DataFrame:
    """(*by, idx, code, term): names of a chunk that its translation leaves as they are, or, where strict, without
    their target. hints: (*by, term, target, strict)."""
    rows = mentioned(hints, chunks, *by).join(hints, [*by, "term"]).join(chunks.filter("translated IS NOT NULL").select(*by, "idx", "translated"), [*by, "idx"])
    left = F.when(F.contains("translated", F.col("term")), "UNRESOLVED_PROPER_NOUN")
    gone = F.when(F.col("strict") & ~F.contains("translated", F.col("target")), "MISSING_CANONICAL_PROPER_NOUN_TRANSLATION")
    codes = F.filter(F.array(left, gone), lambda c: c.isNotNull())
    return rows.filter("target IS NOT NULL").select(*by, "idx", "term", F.explode(codes).alias("code"))


def synthesized(hits: DataFrame, chunks: DataFrame, confirmed: DataFrame, *by: str) -> DataFrame:
    """(*by, idx, source, target, confidence): strict hits (*by, idx, ord, source, target) whose target stands in the
    translation and that no confirmed term (*by, idx, source, translation) has by source or target, nor an
    earlier one of them. A chunk's hits are few, so they are one array."""
    key = lambda c: ascii_lower(collapse(c))
    here = hits.join(chunks.filter("translated IS NOT NULL").select(*by, "idx", "translated"), [*by, "idx"]).filter(F.contains("translated", F.col("target")))
    own = here.groupBy(*by, "idx").agg(F.array_sort(F.collect_list(F.struct("ord", "source", "target"))).alias("hits"))
    known = confirmed.groupBy(*by, "idx").agg(F.collect_set(key(F.col("source"))).alias("sources"), F.collect_set(trim_ws(F.col("translation"))).alias("targets"))
    none = F.array().cast("array<string>")
    start = F.struct(F.coalesce("sources", none).alias("sources"), F.coalesce("targets", none).alias("targets"), F.array().cast("array<struct<source:string,target:string>>").alias("new"))

    def step(a: Column, h: Column) -> Column:
        seen = F.array_contains(a["sources"], key(h["source"])) | F.array_contains(a["targets"], h["target"])
        more = F.struct(
            F.concat(a["sources"], F.array(key(h["source"]))).alias("sources"), F.concat(a["targets"], F.array(trim_ws(h["target"]))).alias("targets"),
            F.concat(a["new"], F.array(F.struct(h["source"].alias("source"), h["target"].alias("target")))).alias("new"),
        )
        return F.when(seen, a).otherwise(more)

    rows = own.join(known, [*by, "idx"], "left").select(*by, "idx", F.explode(F.aggregate("hits", start, step, lambda a: a["new"])).alias("n"))
    return rows.select(*by, "idx", "n.source", "n.target", F.lit(100).cast("long").alias("confidence"))


def sequenced(terms: DataFrame, order: list, *by: str) -> DataFrame:
    """Adds seq: the number of a term in the order in which waves and their chunks put terms out."""
    return terms.withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def frozen_index(terms: DataFrame, chunks: DataFrame, *by: str) -> DataFrame:
    """(*by, idx, frozen_at, seq, source): for each body chunk the terms it has yet to take up, as of the last
    sequence number; see ``delta_terms``. chunks: (*by, idx, kind, started, patched)."""
    last = terms.groupBy(*by).agg(F.max("seq").alias("frozen_at"))
    return delta_terms(terms, chunks.filter("kind = 'body'"), *by).join(last, list(by)).select(*by, "idx", "frozen_at", "seq", "source")


def delta_terms(terms: DataFrame, chunks: DataFrame, *by: str) -> DataFrame:
    """Terms of other chunks that came after a chunk started and after it was last patched.
    terms: (*by, seq, chunk, source); chunks: (*by, idx, started, patched)."""
    a, b = terms.alias("t"), chunks.alias("c")
    on = [F.col(f"t.{x}") == F.col(f"c.{x}") for x in by]
    late = (F.col("t.chunk") != F.col("c.idx")) & (F.col("t.seq") > F.greatest(F.col("c.started"), F.col("c.patched")))
    cond = late
    for x in on:
        cond = cond & x
    return a.join(b, cond).select(*[F.col(f"c.{x}") for x in by], "idx", "seq", "source")


def first_delta_terms(terms: DataFrame, chunks: DataFrame, *by: str) -> DataFrame:
    """Of ``delta_terms`` the first of each source (ASCII case ignored) for each chunk. Between two neighbouring times
    at which chunks began to take terms, only the first place of a source in a chunk can be one, so terms are
    reduced to those before they meet the chunks."""
    times = chunks.groupBy(*by).agg(F.collect_set(F.greatest("started", "patched")).alias("_times"))
    rows = terms.join(times, list(by)).withColumn("_span", F.size(F.filter("_times", lambda x: x < F.col("seq"))))
    rows = rows.groupBy(*by, "chunk", "source", "_span").agg(F.min("seq").alias("seq"))
    return first_per(delta_terms(rows, chunks, *by), ascii_lower(F.col("source")), ["seq", "source"], *by, "idx")


def carried_over(chunks: DataFrame, new: DataFrame, *by: str) -> DataFrame:
    """Translations for new chunks whose source an old chunk had, word for word; the first such."""
    known = chunks.filter("translated IS NOT NULL").groupBy(*by, "source").agg(F.min_by("translated", "idx").alias("translated"))
    return new.join(known, [*by, "source"], "left")
