"""Operators that need Python in the plan, sources, sinks and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import fuzzy as Z
from quire.functions import segments as G
from quire.functions import text as X
from quire.operators import align as A
from quire.operators import chunks as C
from quire.registry import query
from quire.sources import artifacts as S
from quire.sources import books as B
from quire.sources.tables import table
from quire.streaming import state as T

from . import duck as D
from .standins import CHUNKS_SQL, LOG_SQL, PAIRS_SQL, REVIEWS_SQL, SNIPPETS_SQL, TERMS_SQL, chunks, event_log, pairs, reviews, snippets, terms
from .text_queries import key_sql


def q(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(f)


def one(name: str, f: Callable, kind: str = "string", sql: str | None = None) -> None:
    q(name, lambda s, d: snippets(s, d).select("id", F.col("n").cast("long").alias("n"), Z.column(f, kind)(F.col("t")).alias("out")), None if sql is None else f"WITH {SNIPPETS_SQL} SELECT id, n, {sql} AS out FROM s")


def two(name: str, f: Callable, kind: str = "string", sql: str | None = None) -> None:
    q(name, lambda s, d: pairs(s, d).select("task", "idx", Z.column(f, kind)("source", "target").alias("out")), None if sql is None else f"WITH {PAIRS_SQL} SELECT task, idx, {sql} AS out FROM p")


page = lambda f: lambda s, d: table(s, d, "pages").select("page_id", Z.column(f, "string")(F.col("html")).alias("out"))
q("txt09_densest_block", page(Z.densest_block))
q("txt14_boilerplate", page(Z.without_boilerplate))
q("src22_page_markdown", page(Z.page_markdown))
q("txt24_protected_metadata", lambda s, d: snippets(s, d).select("id", F.col("n").cast("long").alias("n"), X.protected_metadata(F.col("t")).alias("out")))
two("txt35_toc_title", Z.toc_title)
two("txt36_chapter_heading", lambda a, b: Z.repair_chapter_heading(b), sql="target")
two("txt43_lcs", Z.lcs_length, "int")
two("txt45_match_level", lambda a, b: Z.match_level(a, b))
two("txt46_mentions", lambda a, b: any(Z.mentions(a, w) for w in dict.fromkeys(b.split())), "boolean")
two("txt51_structural_evidence", lambda a, b: any(Z.structural_evidence(a, w) for w in dict.fromkeys(b.split())), "boolean")
one("txt55_mask", Z.mask)
one("txt56_mask_special", Z.mask_special)
two("txt59_repeated_title", lambda a, b: Z.without_repeated_title(f"# {a}\n\n{a}\n\n{b}"))
q("txt61_replace_terms", lambda s, d: snippets(s, d).select("id", F.col("n").cast("long").alias("n"), X.replace_terms(F.col("t"), [{"source": "the", "target": "DER"}, {"source": "the and", "target": "X"}]).alias("out")))
q("txt62_replace_aliases", lambda s, d: snippets(s, d).select("id", F.col("n").cast("long").alias("n"), X.replace_aliases(F.col("t"), [{"source": "on", "target": "AN"}, {"source": "onon", "target": "B"}]).alias("out")))
q("txt65_fnv1a", lambda s, d: table(s, d, "part").select("p_partkey", Z.column(Z.fnv1a64, "string")(F.col("p_name")).alias("hash")))
one("txt67_json_object", Z.json_object)
one("txt76_sentence_context", lambda t: Z.sentence_context(t, "the"))
two("txt78_source_residual", lambda a, b: Z.source_residual(b, a, "目标"))
two("txt79_alignment_score", lambda a, b: Z.alignment_score("paragraph", a, "paragraph\x1f" + b), "int")
one("txt81_residual_decision", Z.residual_decision)
two("txt83_replace_residual", lambda a, b: Z.replace_residual(b, max(a.split(), key=len, default=""), "目标"))
q("chk15_speech_chunks", lambda s, d: table(s, d, "documents").select("doc_id", F.explode(Z.column(Z.speech_chunks, "array<string>")(F.col("text"))).alias("chunk")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("chunk")).cast("long").alias("largest")))
q("chk22_html_blocks", lambda s, d: table(s, d, "pages").select("page_id", F.inline(Z.column(Z.html_blocks, "array<struct<ord:int,kind:string,text:string>>")(F.col("html")))).groupBy("kind").agg(F.count(F.lit(1)).alias("n")))
q("chk02_reference_chunks", lambda s, d: A.reference_aware(pairs(s, d).select("task", "idx", F.concat("source", F.lit("\n# References\n"), "target", F.lit("\n# Tail\nend")).alias("t")), "t", 300, "task", "idx").groupBy("task", "idx", "part").agg(F.count(F.lit(1)).alias("n")))
q("chk03_academic_chunks", lambda s, d: A.academic_parts(pairs(s, d).select("task", "idx", F.concat(F.lit("Department of X\na@b.c\n\n"), "source").alias("t")), "t", 300, "task", "idx").groupBy("part").agg(F.count(F.lit(1)).alias("n")))
q("chk07_source_blocks", lambda s, d: A.source_blocks(pairs(s, d).select("task", "idx", F.concat(F.lit("# A\n\n"), "source", F.lit("\n\n### B\n\n- x\n\n### C\n\n"), "target").alias("t")), "t", "task", "idx").select("task", "idx", "ord", "kind", "translate", F.array_join("heading_path", "/").alias("path")))
q("win05_heading_path", lambda s, d: A.source_blocks(pairs(s, d).select("task", "idx", F.concat(F.lit("# A\n\n"), "source", F.lit("\n\n### B\n\n### C\n\n"), "target").alias("t")), "t", "task", "idx").filter("kind = 'heading'").groupBy("task", "idx").agg(F.max(F.size("heading_path")).cast("long").alias("depth")))
q("chk24_markdown_blocks", lambda s, d: snippets(s, d).select(X.block_kind(F.col("t")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")))

_blocks = lambda s, d, c: pairs(s, d).select("task", "idx", F.posexplode(G.sentences(F.col(c))).alias("ord", "text")).withColumn("kind", F.lit("paragraph"))
q("jn20_alignment", lambda s, d: A.aligned(_blocks(s, d, "source"), _blocks(s, d, "target"), "task", "idx"))
q("jn21_chunk_alignment", lambda s, d: A.by_ordinal(_blocks(s, d, "source"), _blocks(s, d, "target"), "task", "idx").select("task", "idx", "ord", "text", "target"), None)
q("jn28_unique_anchor", lambda s, d: A.unique_anchors(_blocks(s, d, "source"), _blocks(s, d, "target"), "task", "idx"))
q("jn18_heading_pairs", lambda s, d: A.heading_sequence(_blocks(s, d, "source"), _blocks(s, d, "target"), "task", "idx"))
_first = lambda s, d: terms(s, d).filter("confidence >= 85").select("task", "chunk", "source", "translation")
q("jn22_patch_residuals", lambda s, d: pairs(s, d).select("task", "idx", Z.column(lambda a, b: Z.source_residual(b, max(a.split(), key=len, default=""), "译"), "string")("source", "target").alias("residual")).filter("residual IS NOT NULL"))
q("jn27_local_cover", lambda s, d: pairs(s, d).select("task", "idx", Z.column(lambda a, b: Z.mentions(a, max(b.split(), key=len, default="")) or Z.mentions(b, max(a.split(), key=len, default="")), "boolean")("source", "target").alias("covered")))
q("jn16_confirmed_stats", lambda s, d: terms(s, d).groupBy("task", X.term_key(F.col("source")).alias("key")).agg(F.count(F.lit(1)).alias("occurrences"), F.min("chunk").alias("first_chunk"), F.countDistinct("chunk").alias("matched")), f"WITH {TERMS_SQL} SELECT task, {key_sql('source')} AS key, count(*) AS occurrences, min(chunk) AS first_chunk, count(DISTINCT chunk) AS matched FROM terms GROUP BY ALL")
q("win02_family_match", lambda s, d: pairs(s, d).select("task", "idx", Z.column(lambda a, b: Z.match_level(a, b) in ("High", "Exact"), "boolean")("source", "target").alias("family")))
q("win03_first_seen_lock", lambda s, d: A.locked(_first(s, d), "task").select("task", "key", "target"), f"WITH {TERMS_SQL} SELECT task, {key_sql('source')} AS key, translation AS target FROM terms WHERE confidence >= 85 QUALIFY row_number() OVER (PARTITION BY task, {key_sql('source')} ORDER BY chunk, source, translation) = 1")
q("set11_pruned_hints", lambda s, d: A.pruned(terms(s, d).filter("confidence < 70").select("task", "source").distinct(), terms(s, d).filter("confidence >= 105").select("task", "source").distinct(), "task"), f"WITH {TERMS_SQL}, h AS (SELECT DISTINCT task, source FROM terms WHERE confidence < 70), c AS (SELECT DISTINCT task, {key_sql('source')} AS k FROM terms WHERE confidence >= 105) SELECT task, source FROM h WHERE (task, {key_sql('source')}) NOT IN (SELECT (task, k) FROM c)")
q("set16_merged_excerpts", lambda s, d: A.merged_neighbours(pairs(s, d).select("task", "idx", F.col("source").alias("excerpt"), X.words(F.col("source")).alias("terms")), "task").select("task", "idx", "excerpt", F.array_join("terms", ",").alias("terms")))
q("set18_clean_terms", lambda s, d: A.cleaned_terms(terms(s, d), "task", "chunk"), f"WITH {TERMS_SQL} SELECT task, chunk, trim(source) AS source, trim(translation) AS translation, least(confidence, 100) AS confidence FROM terms WHERE trim(source) <> '' AND trim(translation) <> '' AND source <> translation QUALIFY row_number() OVER (PARTITION BY task, chunk, lower(trim(source)), trim(translation) ORDER BY pos, confidence, source) = 1")
q("agg20_anchoring_summary", lambda s, d: A.anchoring_summary(terms(s, d).filter("confidence >= 85"), "task"), f"WITH {TERMS_SQL}, k AS (SELECT *, {key_sql('source')} AS key FROM terms WHERE confidence >= 85), f AS (SELECT *, first_value(translation) OVER (PARTITION BY task, key ORDER BY chunk, pos, translation) AS anchor FROM k) SELECT task, count(DISTINCT key) AS anchored, count(DISTINCT chunk) FILTER (translation <> anchor) AS repaired_chunks FROM f GROUP BY task")
q("agg21_potential_variants", lambda s, d: A.potential_variants(pairs(s, d), ["Thent", "Andon"], "task"))
q("agg23_hint_build", lambda s, d: A.hint_build(pairs(s, d), "task").select("task", "phrase", "occurrences", "first_chunk", F.array_join("chunks", ",").alias("chunks")))
q("agg24_running_titles", lambda s, d: A.running_titles(table(s, d, "documents").select(F.col("lang").alias("task"), F.col("doc_id").alias("idx"), "text"), "task"), f"SELECT lang AS task, line AS title, count(DISTINCT doc_id) AS chunks FROM (SELECT lang, doc_id, {D.trim('unnest(string_split(text, chr(10)))')} AS line FROM documents) WHERE regexp_full_match(line, '[A-Z][^.!?;:]{{2,59}}') GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3")
_pk = lambda s, d: table(s, d, "part").select((F.col("p_partkey") % 3).alias("pack"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("word"), (F.col("p_size") % 10).alias("rank"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.concat(F.lit("d"), "p_partkey")).alias("definition"))
q("agg25_merged_packs", lambda s, d: S.merged_packs(_pk(s, d)).select("key", "word", F.col("rank").cast("long").alias("rank"), "definition"), "WITH e AS (SELECT p_partkey % 3 AS pack, p_partkey AS pos, p_name AS word, p_size % 10 AS rank, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'd' || p_partkey END AS definition FROM part), x AS (SELECT *, lower(word) AS key, row_number() OVER w AS place, rank < min(rank) OVER (PARTITION BY lower(word) ORDER BY pack, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lowers FROM e WINDOW w AS (PARTITION BY lower(word) ORDER BY pack, pos)) SELECT key, arg_min(word, place) AS word, CAST(min(rank) AS BIGINT) AS rank, coalesce(arg_max(definition, place) FILTER (lowers AND definition <> ''), arg_min(definition, place)) AS definition FROM x GROUP BY key")
q("agg04_glossary_merge", lambda s, d: terms(s, d).groupBy("source").agg(F.max("confidence").alias("occurrences"), F.min("chunk").alias("first_chunk"), F.array_join(F.array_sort(F.collect_set("translation")), ",").alias("headings")), f"WITH {TERMS_SQL} SELECT source, max(confidence) AS occurrences, min(chunk) AS first_chunk, array_to_string(list_sort(list(DISTINCT translation)), ',') AS headings FROM terms GROUP BY source")
q("qa01_masked_residual", lambda s, d: C.residual_terms(pairs(s, d).select("task", "idx", Z.column(Z.mask_both, "struct<source:string,target:string>")("source", "target").alias("m")).select("task", "idx", "m.*"), True, "task", "idx"))
q("qa07_residual_issues", lambda s, d: C.residual_terms(chunks(s, d).filter((F.col("kind") == "body") & ~C.skips_review(F.col("source"))).select("task", "idx", "source", F.col("translated").alias("target")), True, "task", "idx").groupBy("task", "idx").agg(F.count(F.lit(1)).alias("terms")))
q("qa14_shared_clusters", lambda s, d: A.clusters(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("parts"))).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))

# --- sources and sinks: written to the shared folder and read back
_log = lambda s, d: event_log(s, d).select("seq", F.col("ts").cast("string").alias("timestamp"), "stage", "message", F.col("progress").cast("smallint").alias("progress"), F.lit("info").alias("level"))


def round_trip(write: Callable, read: Callable, make: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        path = T.shared_folder(s)
        write(make(s, d), path)
        return read(s, path)

    return run


_plain = f"WITH {LOG_SQL} SELECT seq, stage, message, CAST(progress AS SMALLINT) AS progress FROM log"
q("src14_event_log", lambda s, d: round_trip(S.append_events, S.event_lines, _log)(s, d).select("seq", "stage", "message", "progress"), _plain)
q("snk01_json_artifact", lambda s, d: round_trip(S.write_json, lambda s_, p: s_.read.schema(S.EVENTS).json(p), _log)(s, d).select("seq", "stage", "message", "progress"), _plain)
q("snk04_append_events", lambda s, d: round_trip(lambda df, p: (S.append_events(df.filter("seq % 2 = 0"), p), S.append_events(df.filter("seq % 2 = 1"), p)), S.event_lines, _log)(s, d).select("seq", "stage", "message", "progress"), _plain)
q("snk06_checkpoint", lambda s, d: round_trip(lambda df, p: S.write_checkpoint(df, p, "r1"), lambda s_, p: s_.read.parquet(p).filter("run = 'r1'"), _log)(s, d).select("seq", "stage", "message", "progress"), _plain)
q("src13_json_lines", lambda s, d: round_trip(S.write_json, S.event_lines, _log)(s, d).groupBy("stage").agg(F.count(F.lit(1)).alias("n")), f"WITH {LOG_SQL} SELECT stage, count(*) AS n FROM log GROUP BY stage")
_value = lambda s, d: table(s, d, "nation").groupBy().agg(F.sort_array(F.collect_list("n_name")).alias("names"), F.count(F.lit(1)).alias("n")).coalesce(1)
q(
    "src15_json_artifact",
    lambda s, d: round_trip(S.write_json, lambda s_, p: S.json_artifact(s_, p, "names array<string>, n long"), _value)(s, d).select(F.array_join("names", ",").alias("names"), "n"),
    "SELECT string_agg(n_name, ',' ORDER BY n_name) AS names, count(*) AS n FROM nation",
)
_ocr = lambda s, d: table(s, d, "pages").select(F.to_json(F.struct(F.col("page_id").cast("int").alias("page"), F.array(F.struct(F.lit("text").alias("label"), F.col("url").alias("content"), F.array(F.lit(1), F.lit(2)).alias("bbox"), F.lit(0).alias("order"))).alias("blocks"))).alias("json"))
q("src12_ocr_blocks", lambda s, d: S.ocr_blocks(_ocr(s, d)).select(F.col("page").cast("long").alias("page"), "label", "content"), "SELECT page_id AS page, 'text' AS label, url AS content FROM pages")
q("src02_texts", lambda s, d: round_trip(S.write_text, B.texts, lambda s_, d_: table(s_, d_, "nation").select("n_name").coalesce(1))(s, d).select("text", "hash"))
_csv = "word,phonetic,definition,translation,tag\nabandon,,to leave,,gk cet4\nknife,,\"a quoted, comma\",,gk\nzep,,,,\n"
q("src17_word_pack", lambda s, d: round_trip(lambda df, p: S.write_text(df, p), S.import_pack, lambda s_, d_: s_.createDataFrame([(x,) for x in _csv.strip().split("\n")], "value string").coalesce(1))(s, d).select("word", "definition", F.col("rank").cast("long").alias("rank")), "SELECT * FROM (VALUES ('abandon', 'to leave', 1), ('knife', 'a quoted, comma', 1)) t(word, definition, rank)")
_json = '{"words": [{"word": "the", "level": "zhongKao"}, {"word": "bad word", "level": "gre"}, {"word": "serendipity", "level": "gre", "definition": "luck"}]}'
q("src18_json_pack", lambda s, d: round_trip(S.write_text, S.import_pack, lambda s_, d_: s_.createDataFrame([(_json,)], "value string").coalesce(1))(s, d).select("word", "definition", F.col("rank").cast("long").alias("rank")), "SELECT * FROM (VALUES ('the', '', 0), ('serendipity', 'luck', 9)) t(word, definition, rank)")
_list = "# comment\nword;meaning\ngood;ok\nbad word;x\n3d;y\nokay-ish;z"
q("src20_word_list", lambda s, d: round_trip(S.write_text, S.import_pack, lambda s_, d_: s_.createDataFrame([(x,) for x in _list.split("\n")], "value string").coalesce(1))(s, d).select("word", "definition"), "SELECT * FROM (VALUES ('good', 'ok'), ('okay-ish', 'z')) t(word, definition)")
q("snk07_manifest", lambda s, d: S.manifest(event_log(s, d).select("task", F.col("stage").alias("kind"), F.col("stage").alias("path"), "progress").groupBy("task", "kind", "path").agg(F.sum("progress").alias("bytes")), "task").select("task", "bytes", F.size("files").cast("long").alias("files")), f"WITH {LOG_SQL} SELECT task, CAST(sum(progress) AS BIGINT) AS bytes, count(DISTINCT stage) AS files FROM log GROUP BY task")
q("snk08_anki_lines", lambda s, d: S.anki_lines(pairs(s, d).withColumn("tag", F.col("task").cast("string")), "source", "target", "tag"), f"WITH {PAIRS_SQL} SELECT {'{}'} AS value FROM p".format(" || chr(9) || ".join(f"replace(translate({c}, chr(9) || chr(13), '  '), chr(10), '<br>')" for c in ("source", "target", "CAST(task AS VARCHAR)"))))
q("snk09_anki_cards", lambda s, d: S.anki_lines(table(s, d, "part").withColumn("tag", F.lit("t")).orderBy("p_name"), "p_name", "p_type", "tag"), "SELECT p_name || chr(9) || p_type || chr(9) || 't' AS value FROM part")
q("snk10_reviewed_markdown", lambda s, d: S.reviewed_markdown(chunks(s, d).select("task", F.col("idx").alias("ord"), F.col("heading").alias("chapter"), F.coalesce("translated", "source").alias("target")), "task").select("task", F.md5(F.col("markdown").cast("binary")).alias("md5")), f"WITH {CHUNKS_SQL}, x AS (SELECT task, idx, heading, coalesce(translated, source) AS t, lag(heading) OVER (PARTITION BY task ORDER BY idx) AS ph FROM chunks) SELECT task, md5(string_agg(CASE WHEN heading IS NOT NULL AND heading IS DISTINCT FROM ph THEN '## ' || heading || chr(10) || chr(10) ELSE '' END || t, chr(10) || chr(10) ORDER BY idx)) AS md5 FROM x GROUP BY task")
one("snk12_markdown_html", S.markdown_html)
q("snk14_finalize", lambda s, d: S.finalize({"chunks": chunks(s, d), "log": event_log(s, d)}, T.shared_folder(s)).select("kind"), "SELECT unnest(['chunks', 'log']) AS kind")

# --- streams
_rev = lambda s, d: T.table_stream(s, d, "events").select(F.col("user_id").alias("book"), F.concat("event_type", F.get_json_object("props", "$.k").cast("long") % 5).alias("word"), F.col("event_id").alias("seq"), (F.col("event_id") % 6).alias("quality"))
q("str16_sm2_stream", lambda s, d: T.sm2_cards(_rev(s, d)).select("book", "word", "reviews", F.col("repetitions").cast("long").alias("repetitions")), f"WITH {REVIEWS_SQL}, b AS (SELECT *, max(CASE WHEN quality < 3 THEN seq END) OVER (PARTITION BY book, word) AS bad FROM reviews) SELECT book, word, count(*) AS reviews, count(*) FILTER (bad IS NULL OR seq > bad) AS repetitions FROM b GROUP BY ALL")
_trm = lambda s, d: T.table_stream(s, d, "lineitem").select((F.col("l_orderkey") % 200).alias("task"), F.concat(F.lit("term"), F.col("l_partkey") % 50).alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("T"), F.col("l_suppkey") % 4).alias("translation"))
q("win03_first_seen_stream", lambda s, d: T.run_to_table(T.first_seen_stream(_trm(s, d))).groupBy("task", "key").agg(F.min("anchor").alias("anchor"), F.count(F.lit(1)).alias("n")), "WITH t AS (SELECT l_orderkey % 200 AS task, 'term' || l_partkey % 50 AS key, l_orderkey * 10 + l_linenumber AS seq, 'T' || l_suppkey % 4 AS tr FROM lineitem) SELECT task, key, arg_min(tr, struct_pack(a := seq, b := tr)) AS anchor, count(*) AS n FROM t GROUP BY ALL")
q("str08_rebuilt_checkpoint", lambda s, d: C.best_candidate(reviews(s, d).select(F.col("book").alias("task"), F.col("quality").alias("translated"), F.lit(True).alias("exact"), F.col("seq").alias("writes"), "ts"), "task").select("task", "translated", "writes"), f"WITH {REVIEWS_SQL} SELECT book AS task, quality AS translated, seq AS writes FROM reviews QUALIFY row_number() OVER (PARTITION BY book ORDER BY quality DESC, seq DESC, ts DESC) = 1")
q("str02_waves", lambda s, d: A.waves(event_log(s, d), 16, "task").groupBy("task", "wave").agg(F.count(F.lit(1)).alias("n")), f"WITH {LOG_SQL} SELECT task, wave, count(*) AS n FROM (SELECT task, (row_number() OVER (PARTITION BY task ORDER BY seq) - 1) // 16 AS wave FROM log) GROUP BY ALL")
q("str06_flush_policy", lambda s, d: A.flushes(event_log(s, d), "task").groupBy("task").agg(F.sum("flush").alias("flushes")))
q("str19_cache_key", lambda s, d: table(s, d, "pages").select("page_id", Z.column(lambda a, b: Z.fnv1a64(a + "\x1f" + b), "string")("url", F.lit("contract-1")).alias("key")))
q("str01_schedule", lambda s, d: A.translate(chunks(s, d).filter("stage = 'pending'"), lambda texts: [Z.upper(t) for t in texts]).select("task", "idx", "translated", "stage"), f"WITH {CHUNKS_SQL} SELECT task, idx, upper(source) AS translated, 'translated' AS stage FROM chunks WHERE stage = 'pending'")
q("str04_late_patch", lambda s, d: A.patched(chunks(s, d).filter("translated IS NOT NULL"), [{"source": "the", "target": "DER"}]).groupBy("task").agg(F.count_if("patched").alias("patched")))
q("udf05_ner_hints", lambda s, d: A.ner_hints(table(s, d, "part").select((F.col("p_partkey") % 5).alias("task"), F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("source"), F.col("p_brand").alias("target"))).alias("terms"))).alias("json")), "json", "task"), "SELECT p_partkey % 5 AS task, p_name AS source, p_brand AS target, count(*) AS n FROM part GROUP BY ALL")
q("udf06_style_profile", lambda s, d: A.style_rules(table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.to_json(F.struct(F.array("n_name", F.lit("words like x"), F.lit("Keep it plain.")).alias("rules"))).alias("json")), "json").select("id", F.array_join("rules", "|").alias("rules")), "SELECT n_nationkey AS id, n_name || '|Keep it plain.' AS rules FROM nation")
q("udf15_toc_inference", lambda s, d: pairs(s, d).select("task", "idx", F.posexplode(G.headings(F.concat(F.lit("# One\n\n"), "source", F.lit("\n\n## Two ##\n"), "target"))).alias("ord", "h")).select("task", "idx", F.col("ord").cast("long").alias("ord"), F.col("h.level").cast("long").alias("level"), "h.title").filter("task >= 0"), f"WITH {PAIRS_SQL} SELECT task, idx, CAST(o AS BIGINT) AS ord, CAST(o + 1 AS BIGINT) AS level, CASE o WHEN 0 THEN 'One' ELSE 'Two' END AS title FROM p, (VALUES (0), (1)) t(o) WHERE task >= 0")
_entry = lambda at: f"CAST(floor({at} / 2) + floor({at} / 14) AS BIGINT)"  # noqa: E731  a gap at every seventh entry
q(
    "udf16_reference_runs",
    lambda s, d: A.numbered_runs(table(s, d, "orders").select((F.col("o_orderkey") % 2).alias("doc"), F.expr(_entry("o_orderkey")).alias("n")), "doc"),
    f"WITH x AS (SELECT o_orderkey % 2 AS doc, {_entry('o_orderkey')} AS n FROM orders), y AS (SELECT doc, n, n - row_number() OVER (PARTITION BY doc ORDER BY n) AS g FROM x) SELECT doc, min(n) AS first, max(n) AS last, count(*) AS entries FROM y GROUP BY doc, g",
)
