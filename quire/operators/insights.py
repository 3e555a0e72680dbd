"""Reading insights: day and week buckets, streaks, retention, progress, top lists.

``today`` and ``now`` are parameters; days are days of the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def calendar(spark: SparkSession, today: str, days: int) -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(date_sub(date'{today}', {days - 1}), date'{today}')) AS day")


def per_day(rows: DataFrame, today: str, days: int, value=None) -> DataFrame:
    """(day, total) over the last days, zero where there is nothing. value: a sum's column, else rows
    are counted. Rows are summed to days before they meet the calendar."""
    what = F.count(F.lit(1)) if value is None else F.sum(value)
    sums = rows.groupBy(F.to_date("ts").alias("day")).agg(what.alias("total"))
    zero = F.lit(0) if value is None else F.lit(0.0)
    return calendar(rows.sparkSession, today, days).join(sums, "day", "left").select("day", F.coalesce("total", zero).alias("total"))


def minutes_per_book(rows: DataFrame) -> DataFrame:
    return rows.groupBy("book").agg(F.sum("minutes").alias("minutes")).filter("minutes > 0").orderBy(F.desc("minutes"), "book")


def length_buckets(words: DataFrame) -> DataFrame:
    n = F.length("word")
    return words.groupBy(F.when(n <= 5, "≤5").when(n <= 9, "6–9").otherwise("10+").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def average_progress(books: DataFrame) -> DataFrame:
    return books.agg(F.coalesce(F.round(F.avg("progress")), F.lit(0.0)).cast("long").alias("average"))


def streak(days: DataFrame) -> DataFrame:
    """How many days at the end of the range have a positive total, without a gap."""
    # a row for each day of a bounded range
    rank = F.row_number().over(Window.orderBy(F.desc("day")))
    ranked = days.withColumn("rn", rank)
    gap = ranked.agg(F.min(F.when(F.col("total") <= 0, F.col("rn"))).alias("gap"), F.count(F.lit(1)).alias("n"))
    return gap.select((F.coalesce("gap", F.col("n") + 1) - 1).cast("long").alias("streak"))


def summary(books: DataFrame, days: DataFrame) -> DataFrame:
    """One row: books by progress, minutes, active days, the first day with the most minutes."""
    a = books.agg(F.count(F.lit(1)).alias("books"), F.count_if(F.col("progress") == 0).alias("not_started"), F.count_if((F.col("progress") > 0) & (F.col("progress") < 100)).alias("active"), F.count_if(F.col("progress") >= 100).alias("finished"))
    b = days.agg(F.round(F.sum("total"), 6).alias("minutes"), F.count_if(F.col("total") > 0).alias("active_days"), F.min_by("day", F.struct(-F.col("total"), "day")).alias("peak_day"))
    return a.crossJoin(b)  # one row each


def retention(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.coalesce(F.round(100 * F.try_divide(F.count_if(F.col("quality") >= 3), F.count(F.lit(1)))), F.lit(0.0)).cast("long").alias("retention"))


def quality_histogram(reviews: DataFrame) -> DataFrame:
    grades = reviews.sparkSession.range(6).select(F.col("id").alias("quality"))
    return grades.join(reviews.groupBy("quality").agg(F.count(F.lit(1)).alias("n")), "quality", "left").na.fill({"n": 0})


def year_heat(rows: DataFrame, now: str) -> DataFrame:
    """52 weeks counted back from now: (week, level), level 0 to 4 of the largest week."""
    ago = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / (7 * 86_400 * 1_000_000))
    sums = rows.withColumn("week", F.lit(51) - ago).filter("week BETWEEN 0 AND 51").groupBy("week").agg(F.sum("minutes").alias("minutes"))
    weeks = rows.sparkSession.range(52).select(F.col("id").alias("week")).join(sums, "week", "left").na.fill({"minutes": 0.0})
    most = F.greatest(F.max("minutes").over(Window.partitionBy(F.lit(1))), F.lit(1.0))  # 52 rows
    return weeks.select("week", F.when(F.col("minutes") == 0, 0).otherwise(F.least(F.lit(4), F.ceil(4 * F.col("minutes") / most))).cast("long").alias("level"))


def top_categories(books: DataFrame, n: int = 4, blank: str = "Uncategorised") -> DataFrame:
    name = F.when(F.trim("category") == "", blank).otherwise(F.col("category"))
    return books.groupBy(name.alias("category")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).orderBy(F.desc("n"), "first").limit(n).select("category", "n")


def recent_books(books: DataFrame, states: DataFrame, n: int = 5) -> DataFrame:
    return books.join(states, books["id"] == states["book"]).orderBy(F.desc("updated"), "id").limit(n).select("id", "title", "updated")


def levels(cards: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Cards by dictionary level; -1 for words that it lacks."""
    return cards.join(dictionary, "word", "left").groupBy(F.coalesce("rank", F.lit(-1)).cast("long").alias("rank")).agg(F.count(F.lit(1)).alias("n"))
