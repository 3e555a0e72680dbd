"""Pipeline metrics: event logs, chunk stages, latencies, terms and tables of contents.

Every aggregate is a sum, count, maximum or nearest-rank percentile by task, so partial results combine
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import ascii_lower, collapse, metric, trim_ws

LONG_TAIL_MS = 120_000
# US dollars for a million tokens.
CACHED_USD, INPUT_USD, OUTPUT_USD = 0.028, 0.14, 0.28


def current_run(log: DataFrame, *task: str) -> DataFrame:
    """Adds ``current``: the event does not precede its task's last ``queued`` event (no such event:
    all are current). One aggregate and a join, no sort of the log."""
    start = log.groupBy(*task).agg(F.coalesce(F.max(F.when(F.col("stage") == "queued", F.col("seq"))), F.min("seq")).alias("_start"))
    return log.join(start, list(task)).withColumn("current", F.col("seq") >= F.col("_start")).drop("_start")


def event_metrics(log: DataFrame, *task: str) -> DataFrame:
    """Counts and sums of the log, for all events and for the current run."""
    rows = current_run(log, *task)
    for f in ("elapsed_ms", "llm_elapsed_ms", "wait_ms"):
        rows = rows.withColumn(f, metric(F.col("message"), f))
    chunk = F.col("stage") == "chunk_translated"
    count = lambda c: F.count_if(c)
    total = lambda c, x: F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0))
    now = F.col("current")
    return rows.groupBy(*task).agg(
        F.count(F.lit(1)).alias("events"), count(now).alias("run_events"), count(chunk).alias("chunks"), count(chunk & now).alias("run_chunks"), count(chunk & (F.col("elapsed_ms") >= LONG_TAIL_MS)).alias("long_tail"),
        F.coalesce(F.max(F.when(chunk, F.col("elapsed_ms"))), F.lit(0)).alias("slowest_ms"), total(chunk, "llm_elapsed_ms").alias("llm_ms"), total(chunk & now, "llm_elapsed_ms").alias("run_llm_ms"),
        total(chunk, "wait_ms").alias("wait_ms"), total(chunk & now, "wait_ms").alias("run_wait_ms"),
    )


def chunk_p95(log: DataFrame, *task: str, share: float = 0.95) -> DataFrame:
    """Nearest-rank percentile of the chunks' times; 0 without chunks."""
    ms = F.when(F.col("stage") == "chunk_translated", metric(F.col("message"), "elapsed_ms"))
    rows = log.withColumn("_ms", ms)
    return rows.groupBy(*task).agg(F.coalesce(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY _ms)").cast("long"), F.lit(0)).alias("p95_ms"))


def structure_error_rate(log: DataFrame, *task: str) -> DataFrame:
    """Mismatches among structure checks; 0 without checks."""
    check = F.col("stage") == "chunk_structure_check"
    bad = F.sum(F.when(check, metric(F.col("message"), "mismatch")))
    return log.groupBy(*task).agg(F.coalesce(F.try_divide(bad, F.count_if(check)), F.lit(0.0)).alias("error_rate"))


def stage_timings(log: DataFrame, *task: str, only_current: bool = False) -> DataFrame:
    """Milliseconds by pipeline stage."""
    rows = current_run(log, *task).filter("current") if only_current else log
    name = F.regexp_extract("message", r"(?:^|;)\s*stage\s*=\s*([^;]*)", 1)
    rows = rows.filter(F.col("stage") == "pipeline_stage").withColumn("name", trim_ws(name)).filter("name <> ''")
    return rows.groupBy(*task, "name").agg(F.count(F.lit(1)).alias("events"), F.sum(metric(F.col("message"), "elapsed_ms")).alias("elapsed_ms"))


def slowest_stage(timings: DataFrame, *task: str) -> DataFrame:
    """The stage with the largest total; ties go to the first name."""
    return timings.groupBy(*task).agg(F.min_by("name", F.struct(-F.col("elapsed_ms"), "name")).alias("slowest"), F.max("elapsed_ms").alias("slowest_ms"))


def stage_counts(chunks: DataFrame, *task: str) -> DataFrame:
    """Chunks by kind and stage, a row for each task."""
    body = F.col("kind") == "body"
    names = {"pending": "pending", "translated": "translated", "term_consistency": "termConsistencyApplied", "residual_reviewed": "residualReviewed", "merge_ready": "mergeReady", "failed": "translationFailed"}
    return chunks.groupBy(*task).agg(
        F.count_if(body).alias("body"), *[F.count_if(body & (F.col("stage") == s)).alias(f"body_{n}") for n, s in names.items()], F.count_if(F.col("kind") == "reference").alias("reference"),
        F.count_if(F.col("kind") == "protectedMetadata").alias("protected_metadata"), F.count_if(F.col("kind") == "pdfTable").alias("pdf_table"), F.count_if(~body & (F.col("stage") == "protectedPassthrough")).alias("passthrough"), F.count("translated").alias("with_translation"),
    )


def several_translations(terms: DataFrame, *task: str) -> DataFrame:
    """Terms (ASCII case ignored) with more than one translation."""
    source, target = trim_ws(F.col("source")), trim_ws(F.col("translation"))
    rows = terms.filter((source != "") & (target != "")).groupBy(*task, ascii_lower(source).alias("term")).agg(F.countDistinct(target).alias("translations"))
    return rows.filter("translations > 1")


def hint_metrics(hints: DataFrame, *task: str) -> DataFrame:
    missing = F.coalesce(F.col("target"), F.lit("")) == ""
    keys = hints.groupBy(*task, ascii_lower(trim_ws(F.col("source"))).alias("key")).agg(F.count(F.lit(1)).alias("n")).groupBy(*task).agg(F.count_if(F.col("n") > 1).alias("duplicate_sources"))
    counts = hints.groupBy(*task).agg(
        F.count(F.lit(1)).alias("hints"), F.count_if(F.col("enforcement") == "strict").alias("strict"), F.count_if(F.col("enforcement") == "contextual").alias("contextual"), F.count_if(missing).alias("missing_target"),
        F.sum("occurrences").alias("occurrences"), F.sum("n_chunks").alias("indexed_chunks"), F.max("n_chunks").alias("max_indexed_chunks"),
    )
    return counts.join(keys, list(task))


def toc_quality(toc: DataFrame, *doc: str) -> DataFrame:
    """Entries of low confidence, titles that repeat, entries without page and link."""
    key = ascii_lower(collapse(F.col("source_title")))
    repeats = toc.withColumn("_key", key).filter("_key <> ''").groupBy(*doc, "_key").agg(F.count(F.lit(1)).alias("n")).groupBy(*doc).agg(F.count_if(F.col("n") > 1).alias("duplicate_titles"))
    lost = F.col("page").isNull() & (F.coalesce(F.col("href"), F.lit("")) == "")
    counts = toc.groupBy(*doc).agg(F.count_if(F.col("confidence") < 0.6).alias("low_confidence"), F.count_if(lost).alias("missing_locators"))
    return counts.join(repeats, list(doc), "left").na.fill({"duplicate_titles": 0})


def translated_toc_metrics(source: DataFrame, translated: DataFrame, *doc: str) -> DataFrame:
    """Titles found, structural mismatches (unequal lengths count too) and moved locators."""
    a = source.select(*doc, "ord", F.col("level").alias("a_level"), F.col("page").alias("a_page"), F.lit(1).alias("a"))
    b = translated.select(*doc, "ord", F.col("level").alias("b_level"), F.col("page").alias("b_page"), "translated_title", F.lit(1).alias("b"))
    both = a.join(b, [*doc, "ord"], "full")
    filled = F.coalesce(F.col("translated_title"), F.lit("")) != ""
    one = F.col("a").isNull() | F.col("b").isNull()
    return both.groupBy(*doc).agg(
        F.count_if(F.col("b").isNotNull() & ~filled).alias("missing_titles"), F.count_if(F.col("b").isNotNull() & filled).alias("matched_titles"),
        F.count_if(one | ~F.col("a_level").eqNullSafe(F.col("b_level"))).alias("structural_mismatches"), F.count_if(~one & ~F.col("a_page").eqNullSafe(F.col("b_page"))).alias("locator_mutations"),
        F.coalesce(F.try_divide(F.count_if(F.col("b").isNotNull() & filled), F.count("b")), F.lit(0.0)).alias("backfill_rate"),
    )


def cost_usd(cached: Column, uncached: Column, output: Column, responses: Column) -> Column:
    cost = cached / 1e6 * CACHED_USD + uncached / 1e6 * INPUT_USD + output / 1e6 * OUTPUT_USD
    return F.when(responses > 0, F.round(cost, 6))


def token_usage(usage: DataFrame, *task: str) -> DataFrame:
    """Sums of token counts; cached tokens count at most as the prompt's."""
    cached = F.least(F.coalesce(F.col("cached"), F.lit(0)), F.col("prompt"))
    return usage.groupBy(*task).agg(F.sum("prompt").alias("prompt"), F.sum(cached).alias("cached"), F.sum(F.col("prompt") - cached).alias("uncached"), F.sum("completion").alias("completion"), F.count(F.lit(1)).alias("responses"))


def structure_stats(pairs: DataFrame) -> DataFrame:
    from quire.functions.segments import blocks, headings

    out = pairs.select("*", *[F.size(f(F.col(c))).cast("long").alias(f"{c}_{n}") for c in ("source", "target") for n, f in (("blocks", blocks), ("headings", headings))])
    return out.withColumn("block_delta", F.abs(F.col("source_blocks") - F.col("target_blocks"))).withColumn("mismatch", (F.col("block_delta") > 0) | (F.col("source_headings") != F.col("target_headings")))


def window_percentile(log: DataFrame, *task: str, value: str, share: float = 0.95, last: int = 64) -> DataFrame:
    """Nearest-rank percentile of the last samples of each task."""
    rank = F.row_number().over(Window.partitionBy(*task).orderBy(F.desc("seq")))
    return log.withColumn("_r", rank).filter(F.col("_r") <= last).groupBy(*task).agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})").alias("percentile"))


def route_health(success: Column, rate_limits: Column, other_errors: Column) -> Column:
    """Rate limits weigh threefold; between 0.05 and 1, and 1 before the first success."""
    return F.when(success <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(1.0), success / (success + 3 * rate_limits + F.greatest(other_errors, F.lit(0))))))


def resume_audit(chunks: DataFrame, *task: str) -> DataFrame:
    done = F.col("translated").isNotNull()
    return chunks.groupBy(*task).agg(
        F.count_if(F.col("stage") == "pending").alias("pending"), F.count_if(F.col("stage") == "translationFailed").alias("failed"), F.count_if(done).alias("translated"),
        F.count_if(done & F.col("stage").isin("pending", "translationFailed")).alias("done_but_open"), F.count_if(~done & ~F.col("stage").isin("pending", "translationFailed")).alias("advanced_without_text"),
    )


def deltas(before: DataFrame, after: DataFrame, key: str, *names: str) -> DataFrame:
    """After minus before for each named metric."""
    return after.alias("y").join(before.alias("x"), key).select(key, *[(F.col(f"y.{n}") - F.col(f"x.{n}")).alias(f"{n}_delta") for n in names])


def acceptance(text: Column) -> Column:
    """Share of Chinese characters among these and English words; null for 40 characters or fewer."""
    from quire.functions.text import CJK, count_of

    cjk = count_of(text, f"[{CJK}]")
    latin = F.size(F.filter(F.split(text, "[^A-Za-z'’]+"), lambda w: F.octet_length(w) > 1))
    return F.when(F.length(trim_ws(text)) > 40, cjk / F.greatest(cjk + latin, F.lit(1)))
