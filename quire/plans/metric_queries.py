"""Metrics and insights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import insights as I
from quire.operators import metrics as M
from quire.registry import _SQL, query
from quire.sources.tables import table

from . import duck as D
from .standins import BOOKS_SQL, CHUNKS_SQL, DICT_SQL, HINTS_SQL, LOG_SQL, NOW, PAIRS_SQL, REVIEWS_SQL, TERMS_SQL, TODAY, books, chunks, dictionary, event_log, hints, pairs, reviews, terms


def q(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(f)


m = lambda field: f"coalesce(TRY_CAST(nullif(regexp_extract(message, '(?:^|;)\\s*{field}\\s*=\\s*([0-9]*)', 1), '') AS BIGINT), 0)"
RUN = f"WITH {LOG_SQL}, st AS (SELECT task, coalesce(max(seq) FILTER (stage = 'queued'), min(seq)) AS s0 FROM log GROUP BY task), l AS (SELECT log.*, seq >= s0 AS cur, {m('elapsed_ms')} AS ms, {m('llm_elapsed_ms')} AS llm, {m('wait_ms')} AS wt FROM log JOIN st USING (task))"
CH = "stage = 'chunk_translated'"
q("agg08_event_metrics", lambda s, d: M.event_metrics(event_log(s, d), "task"), f"{RUN} SELECT task, count(*) AS events, count(*) FILTER (cur) AS run_events, count(*) FILTER ({CH}) AS chunks, count(*) FILTER ({CH} AND cur) AS run_chunks, count(*) FILTER ({CH} AND ms >= 120000) AS long_tail, coalesce(max(ms) FILTER ({CH}), 0) AS slowest_ms, CAST(coalesce(sum(llm) FILTER ({CH}), 0) AS BIGINT) AS llm_ms, CAST(coalesce(sum(llm) FILTER ({CH} AND cur), 0) AS BIGINT) AS run_llm_ms, CAST(coalesce(sum(wt) FILTER ({CH}), 0) AS BIGINT) AS wait_ms, CAST(coalesce(sum(wt) FILTER ({CH} AND cur), 0) AS BIGINT) AS run_wait_ms FROM l GROUP BY task")
q("agg09_chunk_p95", lambda s, d: M.chunk_p95(event_log(s, d), "task"), f"WITH {LOG_SQL} SELECT task, coalesce(CAST(quantile_disc({m('elapsed_ms')}, 0.95) FILTER ({CH}) AS BIGINT), 0) AS p95_ms FROM log GROUP BY task")
q("agg10_structure_error_rate", lambda s, d: M.structure_error_rate(event_log(s, d), "task"), f"WITH {LOG_SQL} SELECT task, coalesce(CAST(sum({m('mismatch')}) FILTER (stage = 'chunk_structure_check') AS DOUBLE) / nullif(count(*) FILTER (stage = 'chunk_structure_check'), 0), 0.0) AS error_rate FROM log GROUP BY task")
STG = "trim(regexp_extract(message, '(?:^|;)\\s*stage\\s*=\\s*([^;]*)', 1))"
q("agg11_stage_timings", lambda s, d: M.stage_timings(event_log(s, d), "task"), f"WITH {LOG_SQL} SELECT task, {STG} AS name, count(*) AS events, CAST(sum({m('elapsed_ms')}) AS BIGINT) AS elapsed_ms FROM log WHERE stage = 'pipeline_stage' AND {STG} <> '' GROUP BY ALL")
q("agg11_slowest_stage", lambda s, d: M.slowest_stage(M.stage_timings(event_log(s, d), "task"), "task"), f"WITH {LOG_SQL}, t AS (SELECT task, {STG} AS name, sum({m('elapsed_ms')}) AS e FROM log WHERE stage = 'pipeline_stage' GROUP BY ALL) SELECT task, name AS slowest, CAST(e AS BIGINT) AS slowest_ms FROM t QUALIFY row_number() OVER (PARTITION BY task ORDER BY e DESC, name) = 1")
q("agg12_run_stage_timings", lambda s, d: M.stage_timings(event_log(s, d), "task", only_current=True), f"{RUN} SELECT task, {STG} AS name, count(*) AS events, CAST(sum(ms) AS BIGINT) AS elapsed_ms FROM l WHERE stage = 'pipeline_stage' AND cur GROUP BY ALL")
_st = {"pending": "pending", "translated": "translated", "term_consistency": "termConsistencyApplied", "residual_reviewed": "residualReviewed", "merge_ready": "mergeReady", "failed": "translationFailed"}
q("agg07_stage_counts", lambda s, d: M.stage_counts(chunks(s, d), "task"), f"WITH {CHUNKS_SQL} SELECT task, count(*) FILTER (kind = 'body') AS body, {', '.join(f"count(*) FILTER (kind = 'body' AND stage = '{v}') AS body_{k}" for k, v in _st.items())}, count(*) FILTER (kind = 'reference') AS reference, count(*) FILTER (kind = 'protectedMetadata') AS protected_metadata, count(*) FILTER (kind = 'pdfTable') AS pdf_table, count(*) FILTER (kind <> 'body' AND stage = 'protectedPassthrough') AS passthrough, count(translated) AS with_translation FROM chunks GROUP BY task")
q("agg13_several_translations", lambda s, d: M.several_translations(terms(s, d), "task"), f"WITH {TERMS_SQL} SELECT task, {D.low('trim(source)')} AS term, count(DISTINCT trim(translation)) AS translations FROM terms WHERE trim(source) <> '' AND trim(translation) <> '' GROUP BY ALL HAVING count(DISTINCT trim(translation)) > 1")
q("agg14_hint_metrics", lambda s, d: M.hint_metrics(hints(s, d), "task"), f"WITH {HINTS_SQL}, k AS (SELECT task, count(*) FILTER (n > 1) AS duplicate_sources FROM (SELECT task, {D.low('trim(source)')} AS key, count(*) AS n FROM hints GROUP BY ALL) GROUP BY task) SELECT task, count(*) AS hints, count(*) FILTER (enforcement = 'strict') AS strict, count(*) FILTER (enforcement = 'contextual') AS contextual, count(*) FILTER (coalesce(target, '') = '') AS missing_target, CAST(sum(occurrences) AS BIGINT) AS occurrences, CAST(sum(n_chunks) AS BIGINT) AS indexed_chunks, max(n_chunks) AS max_indexed_chunks, any_value(duplicate_sources) AS duplicate_sources FROM hints JOIN k USING (task) GROUP BY task")


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries of tables of contents: (doc, ord, source_title, level, page, href, confidence)."""
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 40).alias("doc"), F.floor(F.col("p_partkey") / 40).alias("ord"), F.col("p_name").alias("source_title"), (F.col("p_size") % 3 + 1).alias("level"), F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("page"),
        F.when(F.col("p_size") % 8 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("href"), (F.col("p_size") / 50).alias("confidence"),
    )


TOC_SQL = "toc AS (SELECT p_partkey % 40 AS doc, p_partkey // 40 AS ord, p_name AS source_title, p_size % 3 + 1 AS level, CASE WHEN p_size % 4 <> 0 THEN p_size END AS page, CASE WHEN p_size % 8 = 0 THEN '' ELSE p_brand END AS href, p_size / 50 AS confidence FROM part)"


def translated_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toc(spark, sf_dir).filter("(doc + ord) % 11 <> 0")
    return rows.select("doc", "ord", F.when(F.col("ord") % 5 != 0, F.upper("source_title")).alias("translated_title"), F.when(F.col("ord") % 7 == 0, 1).otherwise(F.col("level")).alias("level"), F.when(F.col("ord") % 6 == 0, F.col("page") + 1).otherwise(F.col("page")).alias("page"))


TTOC_SQL = f"{TOC_SQL}, ttoc AS (SELECT doc, ord, CASE WHEN ord % 5 <> 0 THEN upper(source_title) END AS translated_title, CASE WHEN ord % 7 = 0 THEN 1 ELSE level END AS level, CASE WHEN ord % 6 = 0 THEN page + 1 ELSE page END AS page FROM toc WHERE (doc + ord) % 11 <> 0)"
q("agg15_toc_quality", lambda s, d: M.toc_quality(toc(s, d), "doc"), f"WITH {TOC_SQL}, r AS (SELECT doc, count(*) FILTER (n > 1) AS duplicate_titles FROM (SELECT doc, {D.low(D.collapse('source_title'))} AS k, count(*) AS n FROM toc GROUP BY ALL) WHERE k <> '' GROUP BY doc) SELECT doc, count(*) FILTER (confidence < 0.6) AS low_confidence, count(*) FILTER (page IS NULL AND href = '') AS missing_locators, coalesce(any_value(duplicate_titles), 0) AS duplicate_titles FROM toc LEFT JOIN r USING (doc) GROUP BY doc")
q("agg16_translated_toc", lambda s, d: M.translated_toc_metrics(toc(s, d), translated_toc(s, d), "doc"), f"WITH {TTOC_SQL}, j AS (SELECT coalesce(a.doc, b.doc) AS doc, a.doc IS NOT NULL AS ha, b.doc IS NOT NULL AS hb, a.level AS al, b.level AS bl, a.page AS ap, b.page AS bp, coalesce(translated_title, '') <> '' AS filled FROM toc a FULL JOIN ttoc b ON a.doc = b.doc AND a.ord = b.ord) SELECT doc, count(*) FILTER (hb AND NOT filled) AS missing_titles, count(*) FILTER (hb AND filled) AS matched_titles, count(*) FILTER (NOT ha OR NOT hb OR al IS DISTINCT FROM bl) AS structural_mismatches, count(*) FILTER (ha AND hb AND ap IS DISTINCT FROM bp) AS locator_mutations, coalesce(CAST(count(*) FILTER (hb AND filled) AS DOUBLE) / nullif(count(*) FILTER (hb), 0), 0.0) AS backfill_rate FROM j GROUP BY doc")


def metrics_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of each task in one wide row."""
    log = event_log(spark, sf_dir)
    slowest = M.slowest_stage(M.stage_timings(log, "task"), "task").withColumnRenamed("slowest_ms", "slowest_stage_ms")
    used = M.token_usage(usage(spark, sf_dir), "task")
    cost = used.select(*used.columns, M.cost_usd(F.col("cached"), F.col("uncached"), F.col("completion"), F.col("responses")).alias("usd"))
    parts = [
        M.event_metrics(log, "task"),
        M.chunk_p95(log, "task"),
        M.structure_error_rate(log, "task"),
        slowest,
        M.stage_counts(chunks(spark, sf_dir), "task"),
        M.hint_metrics(hints(spark, sf_dir), "task"),
        cost,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "task", "left")
    return out


USE = "u AS (SELECT user_id AS task, CAST(floor(value * 1000) AS BIGINT) AS prompt, CAST(json_extract_string(props, '$.k') AS BIGINT) * 50 AS cached, event_id % 500 AS completion FROM events)"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), F.floor(F.col("value") * 1000).cast("long").alias("prompt"), (F.get_json_object("props", "$.k").cast("long") * 50).alias("cached"), (F.col("event_id") % 500).alias("completion"))


_use = "SELECT task, CAST(sum(prompt) AS BIGINT) AS prompt, CAST(sum(least(coalesce(cached, 0), prompt)) AS BIGINT) AS cached, CAST(sum(prompt - least(coalesce(cached, 0), prompt)) AS BIGINT) AS uncached, CAST(sum(completion) AS BIGINT) AS completion, count(*) AS responses FROM u GROUP BY task"
q("agg37_token_usage", lambda s, d: M.token_usage(usage(s, d), "task"), f"WITH {USE} {_use}")
q("agg18_cost", lambda s, d: M.token_usage(usage(s, d), "task").select("task", M.cost_usd(F.col("cached"), F.col("uncached"), F.col("completion"), F.col("responses")).alias("usd")), f"WITH {USE}, t AS ({_use}) SELECT task, round(cached / 1e6 * 0.028 + uncached / 1e6 * 0.14 + completion / 1e6 * 0.28, 6) AS usd FROM t")
_parts = [_SQL[n] for n in ("agg08_event_metrics", "agg09_chunk_p95", "agg10_structure_error_rate", "agg11_slowest_stage", "agg07_stage_counts", "agg14_hint_metrics", "agg37_token_usage", "agg18_cost")]
_names = ["a.*", "b.* EXCLUDE (task)", "c.* EXCLUDE (task)", "slowest, s.slowest_ms AS slowest_stage_ms", "k.* EXCLUDE (task)", "h.* EXCLUDE (task)", "t.* EXCLUDE (task)", "usd"]
q(
    "agg17_metrics_artifact",
    metrics_artifact,
    f"SELECT {', '.join(_names)} FROM ({_parts[0]}) a " + " ".join(f"LEFT JOIN ({sql}) {at} ON a.task = {at}.task" for at, sql in zip("bcskhtu", _parts[1:], strict=True)),
)
q("agg19_structure_stats", lambda s, d: M.structure_stats(pairs(s, d)).select("task", "idx", "source_blocks", "target_blocks", "source_headings", "target_headings", "block_delta", "mismatch"), None)
q("agg36_digits", lambda s, d: pairs(s, d).select("task", "idx", F.array_join(F.array_sort(F.regexp_extract_all("source", F.lit("[0-9]"), F.lit(0))), "").alias("digits")), f"WITH {PAIRS_SQL} SELECT task, idx, array_to_string(list_sort(regexp_extract_all(source, '[0-9]')), '') AS digits FROM p")
q("agg38_window_percentile", lambda s, d: M.window_percentile(event_log(s, d).withColumn("ms", X.metric(F.col("message"), "elapsed_ms")), "task", value="ms").withColumn("percentile", F.col("percentile").cast("long")), f"WITH {LOG_SQL}, w AS (SELECT task, {m('elapsed_ms')} AS ms FROM log QUALIFY row_number() OVER (PARTITION BY task ORDER BY seq DESC) <= 64) SELECT task, CAST(quantile_disc(ms, 0.95) AS BIGINT) AS percentile FROM w GROUP BY task")
_h = "count(*) FILTER (stage = 'chunk_translated')"
q("agg39_route_health", lambda s, d: event_log(s, d).groupBy("task").agg(M.route_health(F.count_if(F.col("stage") == "chunk_translated"), F.count_if(F.col("stage") == "error"), F.count_if(F.col("stage") == "queued")).alias("health")), f"WITH {LOG_SQL} SELECT task, CASE WHEN {_h} = 0 THEN 1.0 ELSE greatest(0.05, least(1.0, CAST({_h} AS DOUBLE) / ({_h} + 3 * count(*) FILTER (stage = 'error') + count(*) FILTER (stage = 'queued')))) END AS health FROM log GROUP BY task")
q("agg40_resume_audit", lambda s, d: M.resume_audit(chunks(s, d), "task"), f"WITH {CHUNKS_SQL} SELECT task, count(*) FILTER (stage = 'pending') AS pending, count(*) FILTER (stage = 'translationFailed') AS failed, count(translated) AS translated, count(*) FILTER (translated IS NOT NULL AND stage IN ('pending', 'translationFailed')) AS done_but_open, count(*) FILTER (translated IS NULL AND stage NOT IN ('pending', 'translationFailed')) AS advanced_without_text FROM chunks GROUP BY task")
q("agg41_translated_count", lambda s, d: chunks(s, d).groupBy("task").agg(F.count("translated").alias("translated")), f"WITH {CHUNKS_SQL} SELECT task, count(translated) AS translated FROM chunks GROUP BY task")


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log(spark, sf_dir)
    sums = lambda keep: rows.filter(keep).groupBy("task").agg(F.count(F.lit(1)).alias("events"), F.sum(X.metric(F.col("message"), "elapsed_ms")).alias("ms"))
    return M.deltas(sums("seq % 2 = 0"), sums("seq % 2 = 1"), "task", "events", "ms")


q("agg42_comparison", compared, f"WITH {LOG_SQL}, x AS (SELECT task, seq % 2 AS side, count(*) AS n, CAST(sum({m('elapsed_ms')}) AS BIGINT) AS ms FROM log GROUP BY ALL) SELECT a.task, b.n - a.n AS events_delta, b.ms - a.ms AS ms_delta FROM x a JOIN x b ON a.task = b.task AND a.side = 0 AND b.side = 1")
q("agg43_acceptance", lambda s, d: pairs(s, d).select("task", "idx", F.round(M.acceptance(F.col("target")), 6).alias("ratio")), f"WITH {PAIRS_SQL}, a AS (SELECT *, {D.count('target', '[一-鿿]')} AS cjk, len(list_filter(regexp_split_to_array(target, '[^A-Za-z''’]+'), lambda w: strlen(w) > 1)) AS latin FROM p) SELECT task, idx, CASE WHEN length({D.trim('target')}) > 40 THEN round(CAST(cjk AS DOUBLE) / greatest(cjk + latin, 1), 6) END AS ratio FROM a")
q("agg44_search_hits", lambda s, d: table(s, d, "documents").select("doc_id", F.regexp_count("text", F.lit("(?i)tion")).cast("long").alias("hits")).filter("hits > 0"), "SELECT doc_id, len(regexp_extract_all(text, '(?i)tion')) AS hits FROM documents WHERE regexp_matches(text, '(?i)tion')")
q("agg26_lowest_level", lambda s, d: table(s, d, "orders").select("o_orderkey", X.lowest_level(F.concat_ws(" ", F.element_at(F.array(*[F.lit(x) for x in ("zk", "gk", "cet4", "cet6", "ky", "ielts", "none")]), (F.col("o_custkey") % 7 + 1).cast("int")), F.element_at(F.array(*[F.lit(x) for x in ("toefl", "tem4", "tem8", "gre", "x")]), (F.col("o_orderkey") % 5 + 1).cast("int")))).cast("long").alias("rank")), "SELECT o_orderkey, list_min(list_filter([[0, 1, 2, 3, 4, 5, NULL][o_custkey % 7 + 1], [6, 7, 8, 9, NULL][o_orderkey % 5 + 1]], lambda x: x IS NOT NULL)) AS rank FROM orders")

# --- insights
CAL = f"cal AS (SELECT CAST(unnest(generate_series(DATE '{TODAY}' - INTERVAL 29 DAY, DATE '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS day)"
DAYS = f"{REVIEWS_SQL}, {CAL}, days AS (SELECT day, coalesce(total, 0.0) AS total FROM cal LEFT JOIN (SELECT CAST(ts AS DATE) AS day, sum(minutes) AS total FROM reviews WHERE minutes > 48 GROUP BY 1) USING (day))"
long_sessions = lambda s, d: reviews(s, d).filter("minutes > 48")
q("agg27_minutes_per_day", lambda s, d: I.per_day(long_sessions(s, d), TODAY, 30, "minutes").withColumn("total", F.round("total", 6)), f"WITH {DAYS} SELECT day, round(total, 6) AS total FROM days")
q("agg28_minutes_per_book", lambda s, d: I.minutes_per_book(reviews(s, d)).withColumn("minutes", F.round("minutes", 6)), f"WITH {REVIEWS_SQL} SELECT book, round(sum(minutes), 6) AS minutes FROM reviews GROUP BY book HAVING sum(minutes) > 0")
q("agg29_reviews_per_day", lambda s, d: I.per_day(reviews(s, d), TODAY, 7), f"WITH {REVIEWS_SQL}, {CAL} SELECT day, coalesce(total, 0) AS total FROM (SELECT * FROM cal WHERE day > DATE '{TODAY}' - INTERVAL 7 DAY) LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS total FROM reviews GROUP BY 1) USING (day)")
q("agg30_length_buckets", lambda s, d: I.length_buckets(dictionary(s, d)), f"WITH {DICT_SQL} SELECT CASE WHEN length(word) <= 5 THEN '≤5' WHEN length(word) <= 9 THEN '6–9' ELSE '10+' END AS label, count(*) AS n FROM dict GROUP BY 1")
q("agg31_average_progress", lambda s, d: I.average_progress(books(s, d)), f"WITH {BOOKS_SQL} SELECT CAST(coalesce(round(avg(progress)), 0) AS BIGINT) AS average FROM books")
q("agg32_summary", lambda s, d: I.summary(books(s, d), I.per_day(long_sessions(s, d), TODAY, 30, "minutes")), f"WITH {DAYS}, {BOOKS_SQL} SELECT * FROM (SELECT count(*) AS books, count(*) FILTER (progress = 0) AS not_started, count(*) FILTER (progress > 0 AND progress < 100) AS active, count(*) FILTER (progress >= 100) AS finished FROM books), (SELECT round(sum(total), 6) AS minutes, count(*) FILTER (total > 0) AS active_days, (SELECT day FROM days ORDER BY total DESC, day LIMIT 1) AS peak_day FROM days)")
q("agg33_levels", lambda s, d: I.levels(reviews(s, d).select(F.regexp_replace("word", "[0-9]", "").alias("word")), dictionary(s, d)), f"WITH {DICT_SQL}, {REVIEWS_SQL} SELECT coalesce(rank, -1) AS rank, count(*) AS n FROM (SELECT regexp_replace(word, '[0-9]', '', 'g') AS word FROM reviews) LEFT JOIN dict USING (word) GROUP BY 1")
q("agg34_retention", lambda s, d: I.retention(reviews(s, d)), f"WITH {REVIEWS_SQL} SELECT CAST(round(100.0 * count(*) FILTER (quality >= 3) / count(*)) AS BIGINT) AS retention FROM reviews")
q("agg34_quality_histogram", lambda s, d: I.quality_histogram(reviews(s, d)), f"WITH {REVIEWS_SQL} SELECT quality, count(seq) AS n FROM (SELECT unnest(generate_series(0, 5)) AS quality) LEFT JOIN reviews USING (quality) GROUP BY quality")
q("agg35_year_heat", lambda s, d: I.year_heat(reviews(s, d), NOW), f"WITH {REVIEWS_SQL}, w AS (SELECT 51 - CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 604800000000.0) AS BIGINT) AS week, sum(minutes) AS minutes FROM reviews GROUP BY 1), a AS (SELECT week, coalesce(minutes, 0) AS minutes FROM (SELECT unnest(generate_series(0, 51)) AS week) LEFT JOIN w USING (week)) SELECT week, CASE WHEN minutes = 0 THEN 0 ELSE CAST(least(4, ceil(4 * minutes / greatest((SELECT max(minutes) FROM a), 1))) AS BIGINT) END AS level FROM a")
q("win10_streak", lambda s, d: I.streak(I.per_day(long_sessions(s, d), TODAY, 30, "minutes")), f"WITH {DAYS}, r AS (SELECT total, row_number() OVER (ORDER BY day DESC) AS rn FROM days) SELECT coalesce(min(rn) FILTER (total <= 0), count(*) + 1) - 1 AS streak FROM r")
q("srt03_top_categories", lambda s, d: I.top_categories(books(s, d)), f"WITH {BOOKS_SQL} SELECT CASE WHEN trim(category) = '' THEN 'Uncategorised' ELSE category END AS category, count(*) AS n FROM books GROUP BY 1 ORDER BY n DESC, min(id) LIMIT 4")
q("srt04_recent_books", lambda s, d: I.recent_books(books(s, d), reviews(s, d).groupBy("book").agg(F.max("ts").alias("updated"))), f"WITH {BOOKS_SQL}, {REVIEWS_SQL} SELECT id, title, max(ts) AS updated FROM books JOIN reviews ON id = book GROUP BY id, title ORDER BY updated DESC, id LIMIT 5")
