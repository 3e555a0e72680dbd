"""Vocabulary: dictionary joins with lemmas, difficult words, cards, marks, spaced repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import ascii_lower, lemma_candidates, trim_ws

CARDS, NOTEBOOK, ACTIVITIES, LOG_DAYS = 5_000, 10_000, 180, 90


def lemma_lookup(words: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """(word, entry, rank) of the distinct words that the dictionary has, itself or by the first lemma
    that it has. words is made distinct before its candidates are joined, so a frequent word is one row."""
    distinct = words.select(F.col(word).alias("word")).distinct()
    tries = distinct.select("word", F.posexplode(F.concat(F.array("word"), lemma_candidates(F.col("word")))).alias("pos", "candidate"))
    hits = tries.join(dictionary.select(F.col("word").alias("candidate"), "rank"), "candidate")
    return hits.groupBy("word").agg(F.min_by("candidate", "pos").alias("entry"), F.min_by("rank", "pos").alias("rank"))


def annotate(words: DataFrame, dictionary: DataFrame, level: int, mastered: DataFrame, learning: DataFrame, *keep: str) -> DataFrame:
    """Words to annotate, input order and repeats kept: not mastered (by form or entry), and either
    being learned or above the reader's level. Adds entry, rank (null: not in the dictionary) and
    ``surface``, the form where it differs from the entry."""
    rows = words.withColumn("word", ascii_lower(F.col("word"))).filter("word <> ''")
    # all that is asked of a word is settled once for each distinct word; the rows meet one small relation
    forms = rows.select("word").distinct().join(lemma_lookup(rows, dictionary), "word", "left").withColumn("lemma", F.coalesce("entry", "word"))
    known, wanted = (m.select(ascii_lower(F.col("word")).alias("m")).distinct() for m in (mastered, learning))
    for by in ("word", "lemma"):
        forms = forms.join(known, forms[by] == known["m"], "left_anti")
    for by in ("word", "lemma"):
        forms = forms.join(wanted.select(F.col("m").alias(by), F.lit(True).alias(f"{by}_wanted")), by, "left")
    forms = forms.withColumn("learning", F.coalesce("word_wanted", F.lit(False)) | F.coalesce("lemma_wanted", F.lit(False)))
    forms = forms.filter(F.col("learning") | F.coalesce(F.col("rank") > level, F.lit(False)))
    rows = rows.join(forms.select("word", "lemma", "rank", "learning"), "word")
    return rows.select(*keep, F.col("lemma").alias("word"), "rank", "learning", F.when(F.col("lemma") != F.col("word"), F.col("word")).otherwise("").alias("surface"))


def difficult_words(words: DataFrame, dictionary: DataFrame, level: int, mastered: DataFrame, learning: DataFrame, *by: str) -> DataFrame:
    """Distinct entries to annotate, for each group of ``by``."""
    return annotate(words.select(*by, "word").distinct(), dictionary, level, mastered, learning, *by).select(*by, "word", "rank").distinct()


def card_faces(cards: DataFrame, dictionary: DataFrame, definitions: DataFrame) -> DataFrame:
    """Cards with level and definition; the card's own definition wins."""
    found = lemma_lookup(cards, dictionary)
    rows = cards.join(found, "word", "left").join(definitions.select(F.col("word").alias("entry"), "definition"), "entry", "left")
    return rows.withColumn("definition", F.coalesce(F.nullif(trim_ws(F.col("custom")), F.lit("")), "definition", F.lit("")))


def word_info(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(pos, word, rank): entries of words, trimmed and in lower case, each once, by first place."""
    rows = words.select(ascii_lower(trim_ws(F.col("word"))).alias("word"), "pos").filter("word <> ''").groupBy("word").agg(F.min("pos").alias("pos"))
    return rows.join(lemma_lookup(rows, dictionary), "word").select("pos", F.col("entry").alias("word"), "rank")


def valid_word(c: Column) -> Column:
    return F.regexp_like(trim_ws(c), F.lit("^[A-Za-z][A-Za-z'-]{0,31}$"))


def is_due(due_at: Column, now: str) -> Column:
    """A card without a date, or with one that is no date, is due."""
    return due_at.isNull() | F.coalesce(F.try_to_timestamp(due_at) <= F.lit(now).cast("timestamp"), F.lit(True))


def due_queue(cards: DataFrame, now: str, *tie: str) -> DataFrame:
    """Due cards: new ones by creation first, then by date."""
    return cards.filter(is_due(F.col("due_at"), now)).orderBy(F.col("due_at").asc_nulls_first(), F.when(F.col("due_at").isNull(), F.col("created_at")), *tie)


def seed_cards(cards: DataFrame, seeds: DataFrame, capacity: int = CARDS) -> DataFrame:
    """Cards to add: words without a card, the first seed of each, as many as the book has room for.
    (book, word, context, chapter); seeds have ``pos``."""
    key = ascii_lower(trim_ws(F.col("word")))
    new = seeds.withColumn("word", key).filter("word <> ''").join(cards.select("book", "word"), ["book", "word"], "left_anti")
    first = new.groupBy("book", "word").agg(F.min_by(F.struct("context", "chapter", "pos"), "pos").alias("s")).select("book", "word", "s.*")
    held = cards.groupBy("book").agg(F.count(F.lit(1)).alias("held"))
    rank = F.row_number().over(Window.partitionBy("book").orderBy("pos"))
    return first.join(held, "book", "left").withColumn("rank", rank).filter(F.col("rank") <= capacity - F.coalesce("held", F.lit(0))).select("book", "word", "context", "chapter")


def upsert_cards(cards: DataFrame, updates: DataFrame, capacity: int = CARDS) -> DataFrame:
    """Context and chapter refreshed where new ones are not empty; the schedule stays; new words get a
    new card."""
    new = updates.select("book", ascii_lower(trim_ws(F.col("word"))).alias("word"), F.col("context").alias("new_context"), F.col("chapter").alias("new_chapter")).filter("word <> ''")
    both = cards.join(new, ["book", "word"], "full")
    pick = lambda n, o: F.coalesce(F.nullif(F.col(n), F.lit("")), F.col(o), F.lit(""))
    return both.select("book", "word", pick("new_context", "context").alias("context"), pick("new_chapter", "chapter").alias("chapter"), F.coalesce("repetitions", F.lit(0)).alias("repetitions"))


def upsert_marks(marks: DataFrame, updates: DataFrame) -> DataFrame:
    """Marks with new status and context; custom definitions stay."""
    new = updates.select("book", ascii_lower(trim_ws(F.col("word"))).alias("word"), F.col("status").alias("new_status"), F.col("context").alias("new_context")).filter("word <> ''")
    both = marks.join(new, ["book", "word"], "full")
    return both.select("book", "word", F.coalesce("new_status", "status").alias("status"), F.when(F.col("new_status").isNotNull(), F.col("new_context")).otherwise(F.col("context")).alias("context"), F.coalesce("custom", F.lit("")).alias("custom"))


def keep_activities(rows: DataFrame, most: int = ACTIVITIES) -> DataFrame:
    """The newest activities of each book; minutes from 0.1 to a day."""
    rank = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("ts"), F.desc("seq")))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most).withColumn("minutes", F.greatest(F.lit(0.1), F.least(F.lit(1440.0), F.col("minutes"))))


def trim_log(log: DataFrame, now: str, days: int = LOG_DAYS) -> DataFrame:
    """Reviews from the first one (by position) inside the window on; later stale ones stay."""
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    start = log.filter(F.col("ts").cast("timestamp") >= cutoff).groupBy("book").agg(F.min("seq").alias("start"))
    return log.join(start, "book").filter(F.col("seq") >= F.col("start")).drop("start")


# Spaced repetition ---------------------------------------------------------------------------------

EASE, LEAST_EASE, RELEARN = 2.5, 1.3, 0.007


def sm2_step(repetitions: Column, interval: Column, ease: Column, quality: Column) -> Column:
    """The schedule after a review of quality 0 to 5, in single precision."""
    f = lambda x: F.lit(x).cast("float")
    q = F.least(quality, F.lit(5))
    miss = (F.lit(5) - q).cast("float")
    good = q >= 3
    reps = F.when(good, repetitions + 1).otherwise(0).cast("int")
    days = F.when(~good, f(RELEARN)).when(repetitions == 0, f(1.0)).when(repetitions == 1, f(6.0)).otherwise(F.greatest((interval * ease).cast("float"), f(1.0)))
    factor = (ease + (f(0.1) - (miss * (f(0.08) + (miss * f(0.02)).cast("float")).cast("float")).cast("float")).cast("float")).cast("float")
    return F.struct(reps.alias("repetitions"), days.cast("float").alias("interval"), F.greatest(f(LEAST_EASE), factor).cast("float").alias("ease"))


def sm2_history(reviews: DataFrame, *key: str) -> DataFrame:
    """The schedule of each card after all its reviews, in order of ``seq``. A card's reviews are few
    (a retention window bounds them), so the fold is over one array a card."""
    history = reviews.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "quality", "ts"))).alias("h"))
    start = F.struct(F.lit(0).alias("repetitions"), F.lit(0.0).cast("float").alias("interval"), F.lit(EASE).cast("float").alias("ease"))
    end = F.aggregate("h", start, lambda a, r: sm2_step(a["repetitions"], a["interval"], a["ease"], r["quality"]))
    last = F.element_at("h", -1)["ts"].cast("timestamp")
    out = history.withColumn("s", end).select(*key, F.size("h").cast("long").alias("reviews"), "s.*", last.alias("last"))
    return out.withColumn("due", F.timestamp_millis(F.unix_millis("last") + (F.col("interval") * F.lit(86_400_000.0).cast("float")).cast("float").cast("long")))


def next_interval(repetitions: Column, interval: Column, ease: Column, quality: Column) -> Column:
    """What a review of that quality would schedule, in days."""
    return sm2_step(repetitions, interval, ease, quality)["interval"]
