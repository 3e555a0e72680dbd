"""Rules over the state of a task: titles, names, synthesized terms, sequences, the resume gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import chunks as C
from quire.operators import glossary as G
from quire.registry import query
from quire.sources.tables import table

from .standins import CHUNKS_SQL, LOG_SQL, PAIRS_SQL, TERMS_SQL, chunks, event_log, fixture, pairs, terms, values_sql

NAMES = [("the", "der", True), ("of", "von", False), ("this", "thing", True), ("que", "que", True), ("thing", None, True)]
NAMES_SQL = f"names AS (SELECT * FROM {values_sql(NAMES, 'term, target, strict')})"
SAYS = "regexp_matches(' ' || source || ' ', '[^A-Za-z0-9_-]' || term || '[^A-Za-z0-9_-]')"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, term, target, strict): five names for every task."""
    return chunks(spark, sf_dir).select("task").distinct().crossJoin(F.broadcast(fixture(spark, NAMES, "term string, target string, strict boolean")))


@query(
    "txt89_chapter_title",
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url WHEN page_id % 3 = 0 THEN lang WHEN page_id % 4 = 0 THEN 'H' || page_id WHEN page_id % 7 = 0 THEN 'T' ELSE 'Chapter ' || page_id + 1 END AS title,
    CASE WHEN page_id % 5 = 0 THEN 'EpubNcx' WHEN page_id % 3 = 0 THEN 'EpubNav' WHEN page_id % 4 = 0 OR page_id % 7 = 0 THEN 'EpubHtmlTitle' ELSE 'EpubSpineFallback' END AS source
    FROM (SELECT page_id, url, substr(url, 1, 9) AS lang FROM pages)""",
)
def txt89(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    title = X.chapter_title(
        F.when(n % 5 == 0, F.col("url")), F.when(n % 3 == 0, F.substring("url", 1, 9)), F.when(n % 4 == 0, F.concat(F.lit("H"), n)), F.when(n % 7 == 0, F.lit("T")), n
    )
    return table(spark, sf_dir, "pages").select("page_id", title.alias("t")).select("page_id", "t.title", "t.source")


@query(
    "jn13_missing_canonical",
    f"""WITH {CHUNKS_SQL}, {NAMES_SQL}, h AS (SELECT * FROM chunks, names WHERE translated IS NOT NULL AND target IS NOT NULL AND {SAYS})
    SELECT task, idx, term, 'UNRESOLVED_PROPER_NOUN' AS code FROM h WHERE contains(translated, term)
    UNION ALL SELECT task, idx, term, 'MISSING_CANONICAL_PROPER_NOUN_TRANSLATION' FROM h WHERE strict AND NOT contains(translated, target)""",
)
def jn13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.proper_noun_issues(names(spark, sf_dir), chunks(spark, sf_dir), "task")


_confirmed = "CASE WHEN idx % 2 = 0 THEN 'THE' ELSE 'zz' END AS source, CASE WHEN idx % 2 = 0 THEN 'x' ELSE ' thing ' END AS translation"


@query(
    "set12_missing_strict",
    f"""WITH {CHUNKS_SQL}, {NAMES_SQL}, h AS (SELECT * FROM chunks, names WHERE translated IS NOT NULL AND strict AND {SAYS} AND contains(translated, coalesce(target, term)))
    SELECT task, idx, term AS source, coalesce(target, term) AS target, CAST(100 AS BIGINT) AS confidence FROM h
    WHERE NOT CASE WHEN idx % 2 = 0 THEN term = 'the' ELSE coalesce(target, term) = 'thing' END
    QUALIFY row_number() OVER (PARTITION BY task, idx, coalesce(target, term) ORDER BY term DESC) = 1""",
)
def set12(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, strict = chunks(spark, sf_dir), names(spark, sf_dir).filter("strict")
    hits = G.mentioned(strict, own, "task").join(strict, ["task", "term"])
    # names in falling order, so that "this" comes before "thing", which has its target
    hits = hits.select("task", "idx", F.when(F.col("term") == "this", 0).when(F.col("term") == "thing", 1).otherwise(2).alias("ord"), F.col("term").alias("source"), F.coalesce("target", "term").alias("target"))
    return G.synthesized(hits, own, own.selectExpr("task", "idx", *_confirmed.split(", ")), "task")


@query("win19_wave_sequence", f"WITH {TERMS_SQL} SELECT task, chunk, pos, source, row_number() OVER (PARTITION BY task ORDER BY chunk, pos, source, translation, confidence) AS seq FROM terms")
def win19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sequenced(terms(spark, sf_dir), ["chunk", "pos", "source", "translation", "confidence"], "task").select("task", "chunk", "pos", "source", "seq")


@query(
    "str05_frozen_index",
    f"""WITH {TERMS_SQL}, c AS (SELECT DISTINCT task, chunk AS idx FROM terms WHERE chunk % 4 <> 3), m AS (SELECT task, max(pos) AS frozen_at FROM terms GROUP BY task)
    SELECT c.task, idx, frozen_at, count(*) AS terms, min(pos) AS first FROM c JOIN m USING (task) JOIN terms t ON t.task = c.task AND t.chunk <> idx AND pos > greatest(idx * 900, c.task * 50) GROUP BY ALL""",
)
def str05(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = terms(spark, sf_dir)
    where = own.select("task", F.col("chunk").alias("idx")).distinct().selectExpr("task", "idx", "CASE WHEN idx % 4 = 3 THEN 'reference' ELSE 'body' END AS kind", "idx * 900 AS started", "task * 50 AS patched")
    frozen = G.frozen_index(own.select("task", F.col("pos").alias("seq"), "chunk", "source"), where, "task")
    return frozen.groupBy("task", "idx", "frozen_at").agg(F.count(F.lit(1)).alias("terms"), F.min("seq").alias("first"))


_match = "bool_and(translated IS NULL OR NOT (task % 4 = 0 AND idx = 1)) AND bool_or(translated IS NOT NULL)"


@query(
    "str09_resume_gate",
    f"""WITH {CHUNKS_SQL} SELECT task, CASE WHEN task % 7 = 0 OR task % 5 = 0 THEN NULL WHEN task % 3 = 0 THEN 'ExactSourceHash' WHEN {_match} THEN 'MatchingTranslatedSources' END AS gate
    FROM chunks GROUP BY task""",
)
def str09(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunks(spark, sf_dir)
    task = own.select("task").distinct()
    prompt = "CASE WHEN task % 5 = 0 THEN '  ' ELSE 'p' END AS prompt_hash"
    saved = task.selectExpr("task", "concat('h', task) AS source_hash", "100 AS chunk_size", prompt)
    now = task.selectExpr("task", "CASE WHEN task % 3 = 0 THEN concat('h', task) ELSE 'other' END AS source_hash", "CASE WHEN task % 7 = 0 THEN 200 ELSE 100 END AS chunk_size", prompt)
    changed = own.withColumn("source", F.when((F.col("task") % 4 == 0) & (F.col("idx") == 1), "changed").otherwise(F.col("source")))
    return C.resume_gate(saved, now, C.sources_match(own, changed, "task"), "task")


STAGES = ["Imported", "OcrRunning", "Chunking", "Translating", "TermConsistency", "ResidualReview", "Rendering", "WritingArtifacts", "Completed"]


@query(
    "str14_latest_state",
    f"""WITH {LOG_SQL}, x AS (SELECT task, seq, ['Imported', 'OcrRunning', 'Chunking', 'Translating', 'Translating', 'Translating', 'Rendering', 'WritingArtifacts', 'Completed'][seq % 9 + 1] AS phase, message FROM log)
    SELECT task, 'Processing' AS status, arg_max(phase, seq) AS phase, least(max(seq) % 130, 100) AS progress, arg_max(message, seq) AS message FROM x GROUP BY task""",
)
def str14(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.element_at(F.array(*map(F.lit, STAGES)), (F.col("seq") % 9 + 1).cast("int"))
    return C.running_state(event_log(spark, sf_dir).select("task", "seq", stage.alias("stage"), (F.col("seq") % 130).alias("progress"), "message"), "task")


@query("qa08_table_snapshot", f"WITH {PAIRS_SQL} SELECT task, idx, task % 3 = 0 AS missing FROM p")
def qa08(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("task") % 3 == 0, "\n<!-- x:pdf-table:image-missing -->\n").otherwise("\n<!-- x:pdf-table:start -->\n")
    return pairs(spark, sf_dir).select("task", "idx", C.table_snapshot_missing(F.concat("target", mark)).alias("missing"))
