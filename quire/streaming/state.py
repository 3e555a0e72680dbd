"""Structured Streaming forms of the stateful operators.

State is kept by key, in the state store or in a table that each wave rewrites; a batch run over the same rows in
order gives the same result.
Output and checkpoints go to a folder that all executors share: ``spark.checkpoint.dir``, or the
warehouse where that is unset.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.vocab import EASE, sm2_step

SM2 = "book long, word string, reviews long, repetitions int, interval float, ease float"
FIRST = "task long, key string, seq long, translation string, anchor string"


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names in ``spark.checkpoint.dir``; in a local session without
    it, as in tests, one in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/quire-streams"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, sf_dir: str, name: str, bytes_a_batch: int = 1 << 26) -> DataFrame:
    """A table's Parquet files as a stream; a batch has a file at least."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_a_batch).option("recursiveFileLookup", True).parquet(f"{sf_dir}/{name}.parquet*")


def event_log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only log of JSON lines as a stream; malformed lines are errors."""
    return spark.readStream.schema(schema).option("mode", "FAILFAST").json(path)


def run_to_table(stream: DataFrame) -> DataFrame:
    """Runs over what is there and returns the output."""
    spark = stream.sparkSession
    path = shared_folder(spark)
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def micro_batches(stream: DataFrame, flush: Callable[[DataFrame, int], None], seconds: int = 5):
    """A query that hands every wave of rows to ``flush``; batches commit with the checkpoint, so a lost
    executor or driver repeats at most the wave that was open."""
    path = shared_folder(stream.sparkSession)
    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", path).trigger(processingTime=f"{seconds} seconds").start()


def sm2_cards(reviews: DataFrame) -> DataFrame:
    """The schedule of each card after all reviews that a stream has. reviews: (book, word, seq, quality).
    A wave's reviews are folded onto the schedules before it, which are one row a card, without Python.
    Two folders take turns, so a wave that is repeated finds the schedules before it whole."""
    spark = reviews.sparkSession
    path, key, done = shared_folder(spark), ["book", "word"], []
    schedule = ["reviews", "repetitions", "interval", "ease"]
    folder = lambda number: f"{path}/cards{number % 2}"

    def fold(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.schema(SM2).parquet(folder(number - 1)) if number else batch.sparkSession.createDataFrame([], SM2)
        rows = batch.select(*key, F.struct("seq", "quality").alias("r")).unionByName(before.select(*key, F.struct(*schedule).alias("s")), allowMissingColumns=True)
        cards = rows.groupBy(*key).agg(F.array_sort(F.collect_list("r")).alias("h"), F.first("s", ignorenulls=True).alias("s"))
        start = F.coalesce(F.col("s"), F.struct(F.lit(0).cast("long").alias("reviews"), F.lit(0).alias("repetitions"), F.lit(0.0).cast("float").alias("interval"), F.lit(EASE).cast("float").alias("ease")))
        first = F.struct(*[start[c].alias(c) for c in schedule[1:]])
        last = F.aggregate("h", first, lambda a, r: sm2_step(a["repetitions"], a["interval"], a["ease"], r["quality"]))
        cards.select(*key, (start["reviews"] + F.size("h")).alias("reviews"), last.alias("l")).select(*key, "reviews", "l.*").write.mode("overwrite").parquet(folder(number))
        done.append(number)

    reviews.writeStream.foreachBatch(fold).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(SM2).parquet(folder(done[-1])) if done else spark.createDataFrame([], SM2)


def first_seen_stream(terms: DataFrame) -> DataFrame:
    """Each term with the translation that was confirmed first. terms: (task, key, seq, translation)."""

    def update(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values(["seq", "translation"])
        anchor = state.get[0] if state.exists else rows["translation"].iloc[0]
        state.update((anchor,))
        yield rows.assign(anchor=anchor)[["task", "key", "seq", "translation", "anchor"]]

    return terms.groupBy("task", "key").applyInPandasWithState(update, FIRST, "anchor string", "append", "NoTimeout")
