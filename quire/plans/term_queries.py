"""Words, cards, terms, glossaries, chunks, quality rules, the library and tables of contents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.segments import sentences
from quire.operators import chunks as C
from quire.operators import glossary as G
from quire.operators import library as L
from quire.operators import toc as T
from quire.operators import vocab as V
from quire.registry import query
from quire.sources.tables import table

from . import duck as D
from .metric_queries import TOC_SQL, TTOC_SQL, toc, translated_toc
from .standins import BOOKS_SQL, CHUNKS_SQL, DICT_SQL, HINTS_SQL, LOG_SQL, NOW, PAIRS_SQL, REVIEWS_SQL, TERMS_SQL, books, chunks, dictionary, event_log, fixture, hints, pairs, reviews, of_documents, staged_tokens, terms, tokens, vocabulary, values_sql
from .text_queries import LEMMA_SQL


def q(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(f)


# --- words: a third of the vocabulary is missing from the dictionary, so lemmas matter
def small_dictionary(s: SparkSession, d: str, tok: DataFrame | None = None) -> DataFrame:
    return dictionary(s, d, tok).filter((F.length("word") + F.col("rank")) % 3 != 0)


DIC = f"{DICT_SQL}, dic AS MATERIALIZED (SELECT * FROM dict WHERE (length(word) + rank) % 3 <> 0), voc AS MATERIALIZED (SELECT DISTINCT {D.low('word')} AS word FROM tok), tries AS (SELECT word, unnest([word] || {LEMMA_SQL('word')}) AS cand, unnest(generate_series(0, len({LEMMA_SQL('word')}))) AS pos FROM voc), found AS MATERIALIZED (SELECT t.word, arg_min(cand, pos) AS entry, arg_min(rank, pos) AS rank FROM tries t JOIN dic ON dic.word = cand GROUP BY t.word)"
MASTERED, LEARNING = "length(word) % 7 = 0", "length(word) % 11 = 0"
words_of = lambda s, d: tokens(s, d).select("doc_id", "lang", "pos", "word")
marks = lambda s, d, cond, tok=None: vocabulary(s, d, tok).filter(cond).select("word")


def difficult(s: SparkSession, d: str) -> DataFrame:
    """Words above level 6 of each language, without mastered ones, with those being learned."""
    tok = staged_tokens(s, d, "lang")
    out = V.difficult_words(tok, small_dictionary(s, d, tok), 6, marks(s, d, MASTERED, tok), marks(s, d, LEARNING, tok), "lang")
    return out.withColumn("rank", F.col("rank").cast("long"))


ANN = f"m AS (SELECT word FROM voc WHERE {MASTERED}), le AS (SELECT word FROM voc WHERE {LEARNING}), ann AS (SELECT t.*, {D.low('t.word')} AS w, coalesce(entry, {D.low('t.word')}) AS lemma, rank FROM tok t LEFT JOIN found f ON f.word = {D.low('t.word')}), kept AS (SELECT *, (w IN (SELECT word FROM le) OR lemma IN (SELECT word FROM le)) AS learning FROM ann WHERE w NOT IN (SELECT word FROM m) AND lemma NOT IN (SELECT word FROM m))"
q("jn04_difficult_words", difficult, f"WITH {DIC}, {ANN} SELECT DISTINCT lang, lemma AS word, CAST(rank AS BIGINT) AS rank FROM kept WHERE learning OR rank > 6")
q("jn03_lemma_lookup", lambda s, d: V.lemma_lookup(marks(s, d, "true"), small_dictionary(s, d)).withColumn("rank", F.col("rank").cast("long")), f"WITH {DIC} SELECT word, entry, CAST(rank AS BIGINT) AS rank FROM found")


def annotated(s: SparkSession, d: str) -> DataFrame:
    """Words to annotate of each document, counted."""
    tok = staged_tokens(s, d, "doc_id")
    out = V.annotate(tok, small_dictionary(s, d, tok), 6, marks(s, d, MASTERED, tok), marks(s, d, LEARNING, tok), "doc_id", "n")
    times = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return out.groupBy("doc_id").agg(F.sum("n").alias("n"), times(F.col("learning")).alias("learning"), times(F.col("surface") != "").alias("inflected"))


def info(s: SparkSession, d: str) -> DataFrame:
    """The dictionary's entries of English words, by first place."""
    tok = staged_tokens(s, d, pos=F.min(F.when(F.col("lang") == "en", F.col("doc_id") * 100_000 + F.col("pos"))))
    return V.word_info(tok.filter("pos IS NOT NULL").select("word", "pos"), small_dictionary(s, d, tok)).withColumn("rank", F.col("rank").cast("long"))


def seeds(s: SparkSession, d: str) -> DataFrame:
    """Words of each language that are not mastered, with their first document."""
    tok = staged_tokens(s, d, "lang", first_doc=F.min("doc_id"))
    return tok.select("lang", "word", "first_doc").join(marks(s, d, MASTERED, tok), "word", "left_anti")


q("jn02_annotate", annotated, f"WITH {DIC}, {ANN} SELECT doc_id, count(*) AS n, count(*) FILTER (learning) AS learning, count(*) FILTER (lemma <> w) AS inflected FROM kept WHERE learning OR rank > 6 GROUP BY doc_id")
q("jn05_word_info", info, f"WITH {DIC}, o AS (SELECT {D.low('word')} AS w, min(doc_id * 100000 + pos) AS pos FROM tok WHERE lang = 'en' GROUP BY 1) SELECT pos, entry AS word, CAST(rank AS BIGINT) AS rank FROM o JOIN found ON found.word = w")
q("chk25_lookup_tokens", lambda s, d: of_documents(table(s, d, "documents").repartition("doc_id")).withColumn("w", F.lower("word")).filter(F.length("w") >= 3).groupBy("doc_id", "w").agg(F.min("pos").alias("pos")).withColumn("learning", F.length("w") % 11 == 0).withColumn("place", F.expr("row_number() OVER (PARTITION BY doc_id ORDER BY NOT learning, pos)")).filter("learning OR place <= 200").select("doc_id", "w", "learning"), f"WITH {DICT_SQL}, a AS (SELECT doc_id, {D.low('word')} AS w, min(pos) AS pos FROM tok WHERE length(word) >= 3 GROUP BY 1, 2), b AS (SELECT *, length(w) % 11 = 0 AS learning, row_number() OVER (PARTITION BY doc_id ORDER BY length(w) % 11 <> 0, pos) AS place FROM a) SELECT doc_id, w, learning FROM b WHERE learning OR place <= 200")
_vw = ["run", "well-known", "it's", "a b", "", "3d", "x" * 33, " pad ", "'tis", "été"]
q("flt11_valid_word", lambda s, d: fixture(s, [(w,) for w in _vw], "w string").union(table(s, d, "part").select("p_name")).select("w", V.valid_word(F.col("w")).alias("valid")), f"SELECT w, regexp_full_match(trim(w), '[A-Za-z][A-Za-z''-]{{0,31}}') AS valid FROM (SELECT * FROM {values_sql([(w,) for w in _vw], 'w')} UNION ALL SELECT p_name FROM part)")


# --- cards
def cards(s: SparkSession, d: str) -> DataFrame:
    """A card for each (book, word) that was reviewed; every fourth has no date, some a bad one."""
    r = reviews(s, d).groupBy("book", "word").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.min("ts").alias("created_at"))
    due = F.when(F.col("n") % 4 == 0, F.lit(None)).when(F.col("n") % 9 == 0, "no date").otherwise(F.date_format(F.col("last") + F.expr("INTERVAL 2 DAYS"), "yyyy-MM-dd HH:mm:ss"))
    return r.select("book", "word", "n", "created_at", due.alias("due_at"))


CARDS_SQL = f"{REVIEWS_SQL}, cards AS (SELECT book, word, n, created_at, CASE WHEN n % 4 = 0 THEN NULL WHEN n % 9 = 0 THEN 'no date' ELSE strftime(last + INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S') END AS due_at FROM (SELECT book, word, count(*) AS n, max(ts) AS last, min(ts) AS created_at FROM reviews GROUP BY 1, 2))"
_due = f"(due_at IS NULL OR coalesce(TRY_CAST(due_at AS TIMESTAMP) <= TIMESTAMP '{NOW}', true))"
q("flt07_due", lambda s, d: cards(s, d).select("book", "word", V.is_due(F.col("due_at"), NOW).alias("due")), f"WITH {CARDS_SQL} SELECT book, word, {_due} AS due FROM cards")
q("srt01_due_cards", lambda s, d: V.due_queue(cards(s, d), NOW, "book", "word").select("book", "word", "due_at"), f"WITH {CARDS_SQL} SELECT book, word, due_at FROM cards WHERE {_due} ORDER BY due_at NULLS FIRST, created_at, book, word")
q("srt02_due_queue", lambda s, d: V.due_queue(cards(s, d), NOW, "book", "word").select("book", "word", "due_at"), f"WITH {CARDS_SQL} SELECT book, word, due_at FROM cards WHERE {_due}")
q("jn01_card_faces", lambda s, d: V.card_faces(marks(s, d, "length(word) > 6").withColumn("custom", F.when(F.length("word") % 5 == 0, F.concat(F.lit("own "), "word")).otherwise(" ")), small_dictionary(s, d), small_dictionary(s, d).select("word", F.concat(F.lit("def "), "word").alias("definition"))).select("word", "definition", F.col("rank").cast("long").alias("rank")), f"WITH {DIC} SELECT v.word, CASE WHEN length(v.word) % 5 = 0 THEN 'own ' || v.word ELSE coalesce('def ' || entry, '') END AS definition, CAST(rank AS BIGINT) AS rank FROM voc v LEFT JOIN found f ON f.word = v.word WHERE length(v.word) > 6")
_seed = lambda s, d: reviews(s, d).select("book", F.upper("word").alias("word"), F.concat(F.lit("c"), "seq").alias("context"), F.lit("1").alias("chapter"), F.col("seq").alias("pos"))
q("set06_seed_cards", lambda s, d: V.seed_cards(cards(s, d).filter("n > 3"), _seed(s, d), 15), f"WITH {CARDS_SQL}, c AS (SELECT * FROM cards WHERE n > 3), f AS (SELECT book, word, min(seq) AS pos FROM reviews WHERE (book, word) NOT IN (SELECT (book, word) FROM c) GROUP BY 1, 2), h AS (SELECT book, count(*) AS held FROM c GROUP BY 1) SELECT book, word, 'c' || pos AS context, '1' AS chapter FROM f LEFT JOIN h USING (book) QUALIFY row_number() OVER (PARTITION BY book ORDER BY pos) <= 15 - coalesce(held, 0)")
_cc = lambda s, d: cards(s, d).select("book", "word", F.lit("old").alias("context"), F.lit("ch1").alias("chapter"), F.col("n").cast("int").alias("repetitions"))
_up = lambda s, d: reviews(s, d).filter("quality = 5").groupBy("book", F.concat("word", F.when(F.col("seq") % 3 == 0, "x").otherwise("")).alias("word")).agg(F.lit("new").alias("context"), F.lit("").alias("chapter"))
q("set07_upsert_cards", lambda s, d: V.upsert_cards(_cc(s, d), _up(s, d)), f"WITH {CARDS_SQL}, u AS (SELECT DISTINCT book, word || CASE WHEN seq % 3 = 0 THEN 'x' ELSE '' END AS word FROM reviews WHERE quality = 5) SELECT book, word, CASE WHEN u.word IS NOT NULL THEN 'new' ELSE 'old' END AS context, CASE WHEN c.n IS NOT NULL THEN 'ch1' ELSE '' END AS chapter, coalesce(CAST(n AS INT), 0) AS repetitions FROM cards c FULL JOIN u USING (book, word)")
q("set08_upsert_marks", lambda s, d: V.upsert_marks(cards(s, d).select("book", "word", F.lit("learning").alias("status"), F.lit("old").alias("context"), F.concat(F.lit("d"), "n").alias("custom")), _up(s, d).select("book", "word", F.lit("mastered").alias("status"), "context")), f"WITH {CARDS_SQL}, u AS (SELECT DISTINCT book, word || CASE WHEN seq % 3 = 0 THEN 'x' ELSE '' END AS word FROM reviews WHERE quality = 5) SELECT book, word, CASE WHEN u.word IS NOT NULL THEN 'mastered' ELSE 'learning' END AS status, CASE WHEN u.word IS NOT NULL THEN 'new' ELSE 'old' END AS context, coalesce('d' || n, '') AS custom FROM cards c FULL JOIN u USING (book, word)")
q("set09_notebook_add", lambda s, d: V.seed_cards(cards(s, d).filter("n > 5"), _seed(s, d), V.NOTEBOOK), f"WITH {CARDS_SQL}, c AS (SELECT * FROM cards WHERE n > 5) SELECT book, word, 'c' || min(seq) AS context, '1' AS chapter FROM reviews WHERE (book, word) NOT IN (SELECT (book, word) FROM c) GROUP BY book, word")
q("set15_book_seeds", seeds, f"WITH {DICT_SQL} SELECT {D.low('word')} AS word, lang, min(doc_id) AS first_doc FROM tok WHERE length(word) % 7 <> 0 GROUP BY ALL")
q("win15_activities", lambda s, d: V.keep_activities(reviews(s, d), 40).select("book", "seq", F.round("minutes", 6).alias("minutes")), f"WITH {REVIEWS_SQL} SELECT book, seq, round(greatest(0.1, least(1440.0, minutes)), 6) AS minutes FROM reviews QUALIFY row_number() OVER (PARTITION BY book ORDER BY ts DESC, seq DESC) <= 40")
q("win16_review_log", lambda s, d: V.trim_log(reviews(s, d), NOW, 20).select("book", "seq"), f"WITH {REVIEWS_SQL}, s AS (SELECT book, min(seq) AS start FROM reviews WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY GROUP BY book) SELECT book, seq FROM reviews JOIN s USING (book) WHERE seq >= start")
q("str16_sm2", lambda s, d: V.sm2_history(reviews(s, d), "book", "word").select("book", "word", "reviews", F.col("repetitions").cast("long").alias("repetitions"), F.round(F.col("interval").cast("double"), 2).alias("interval"), F.round(F.col("ease").cast("double"), 3).alias("ease")))
q("str17_notebook_sm2", lambda s, d: V.sm2_history(reviews(s, d).withColumn("notebook", F.col("book") % 10), "notebook", "word").select("notebook", "word", "reviews", F.col("repetitions").cast("long").alias("repetitions")), f"WITH {REVIEWS_SQL}, r AS (SELECT book % 10 AS notebook, word, seq, quality FROM reviews), b AS (SELECT *, max(CASE WHEN quality < 3 THEN seq END) OVER (PARTITION BY notebook, word) AS bad FROM r) SELECT notebook, word, count(*) AS reviews, count(*) FILTER (bad IS NULL OR seq > bad) AS repetitions FROM b GROUP BY ALL")
q("str18_next_interval", lambda s, d: cards(s, d).select("book", "word", F.round(V.next_interval(F.col("n").cast("int"), (F.col("n") * 2).cast("float"), F.lit(2.5).cast("float"), F.col("n") % 6).cast("double"), 3).alias("days")), f"WITH {CARDS_SQL} SELECT book, word, CASE WHEN n % 6 < 3 THEN 0.007 WHEN n = 0 THEN 1.0 WHEN n = 1 THEN 6.0 ELSE round(n * 5.0, 3) END AS days FROM cards")

# --- glossaries and terms
q("win01_first_seen", lambda s, d: G.first_seen(terms(s, d).filter("confidence >= 85"), "task").select("task", "chunk", "pos", "source", "translation", "anchor"), f"WITH {TERMS_SQL}, k AS (SELECT *, {D.low("regexp_replace(source, '[^A-Za-z0-9]', '', 'g')")} AS key FROM terms WHERE confidence >= 85), f AS (SELECT task, key, translation AS anchor FROM k QUALIFY row_number() OVER (PARTITION BY task, key ORDER BY chunk, pos, translation) = 1) SELECT task, chunk, pos, source, translation, anchor FROM k JOIN f USING (task, key)")
_ent = lambda s, d: table(s, d, "part").select(F.col("p_name").alias("source"), F.concat(F.lit("T"), "p_size").alias("translation"), F.col("p_size").cast("long").alias("occurrences"), F.lit("static").alias("origin"), F.col("p_partkey").alias("pos"))
ENT = "ent AS (SELECT p_name AS source, 'T' || p_size AS translation, CAST(p_size AS BIGINT) AS occurrences, 'static' AS origin, p_partkey AS pos FROM part)"
_ov = [("RED WIDGET", "widget!", None), ("tiny thing", "ding", "small ring"), ("unknown", "neu", None)]
q("set01_overlay", lambda s, d: G.overlay(_ent(s, d).drop("pos"), fixture(s, _ov, "source string, translation string, rename_from string")), f"WITH {ENT}, ov AS (SELECT * FROM {values_sql(_ov, 'source, translation, rename_from')}), r AS (SELECT coalesce(o.source, e.source) AS source, e.translation, occurrences, CASE WHEN o.source IS NOT NULL THEN 'user' ELSE origin END AS origin FROM ent e LEFT JOIN ov o ON lower(o.rename_from) = lower(e.source)) SELECT r.source, coalesce(o.translation, r.translation) AS translation, occurrences, origin FROM r LEFT JOIN ov o ON lower(o.source) = lower(r.source) UNION ALL SELECT source, translation, 0, 'user' FROM ov WHERE lower(source) NOT IN (SELECT lower(source) FROM r)")
q("set02_overrides", lambda s, d: G.normalised(_ent(s, d), "source", "translation", "pos").select("source", "translation", "pos"), f"WITH {ENT} SELECT source, translation, pos FROM ent QUALIFY row_number() OVER (PARTITION BY lower(source) ORDER BY pos) = 1")
q("set03_user_glossary", lambda s, d: G.capped(G.normalised(_ent(s, d), "source", "translation", "pos")).select("source", "translation"), f"WITH {ENT} SELECT source, translation FROM ent QUALIFY row_number() OVER (PARTITION BY lower(source) ORDER BY pos) = 1")
q("set04_deck_entries", lambda s, d: G.normalised(_ent(s, d).withColumn("deck", F.col("pos") % 5), "source", "translation", "pos", "deck").select("deck", "source", "translation"), f"WITH {ENT} SELECT pos % 5 AS deck, source, translation FROM ent QUALIFY row_number() OVER (PARTITION BY pos % 5, lower(source) ORDER BY pos) = 1")
q("set05_decks", lambda s, d: G.deck_entries(_ent(s, d).withColumns({"deck_pos": F.col("pos") % 7, "enabled": F.col("pos") % 7 != 2})).select("deck_pos", "source", "translation"), f"WITH {ENT} SELECT pos % 7 AS deck_pos, source, translation FROM ent WHERE pos % 7 <> 2 QUALIFY row_number() OVER (PARTITION BY lower(source) ORDER BY pos % 7, pos) = 1")
q("srt11_listing", lambda s, d: G.listing(_ent(s, d)).select("source", "occurrences", "pos"), f"WITH {ENT} SELECT source, occurrences, pos FROM ent QUALIFY row_number() OVER (PARTITION BY lower(source) ORDER BY occurrences DESC, pos) = 1")
q("set10_wave_delta", lambda s, d: G.wave_delta(terms(s, d).filter("confidence >= 85").select("task", "source", "translation", "chunk").withColumnRenamed("translation", "target").distinct(), "task"), f"WITH {TERMS_SQL}, x AS (SELECT DISTINCT task, trim(source) AS source, trim(translation) AS target, chunk FROM terms WHERE confidence >= 85), y AS (SELECT *, lower(lag(source) OVER w) = lower(source) AND lag(target) OVER w = target AS same FROM x WINDOW w AS (PARTITION BY task ORDER BY source, target, chunk)) SELECT task, source, target, chunk, row_number() OVER (PARTITION BY task ORDER BY source, target, chunk) AS seq FROM y WHERE NOT coalesce(same, false)")
_tags = [(1, [" a ", "b", "a", "", "x" * 40]), (2, [str(i) for i in range(20)]), (3, [])]
q("set13_tags", lambda s, d: fixture(s, _tags, "id long, tags array<string>").select("id", F.array_join(L.tags(F.col("tags")), "|").alias("tags")), f"SELECT id, tags FROM {values_sql([(1, 'a|b|' + 'x' * 32), (2, '|'.join(str(i) for i in range(12))), (3, '')], 'id, tags')}")
q("set17_unique", lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(F.array_distinct(F.filter(F.transform(F.split("text", "\n"), lambda x: X.trim_spaces(x)), lambda x: x != "")), "|").alias("lines")), None)
q("agg03_glossary", lambda s, d: G.merged(terms(s, d).select("task", "source", "translation", F.lit("term").alias("category"), F.lit("dynamic").alias("origin"), "confidence", F.col("chunk").alias("first_chunk"), F.col("chunk").alias("matched"), F.concat(F.lit("H"), "chunk").alias("heading")).withColumnRenamed("confidence", "occurrences"), "task").withColumn("headings", F.array_join("headings", ",")), f"WITH {TERMS_SQL} SELECT task, {D.low("regexp_replace(source, '[^A-Za-z0-9]', '', 'g')")} AS key, translation, 'term' AS category, 'dynamic' AS origin, max(confidence) AS occurrences, min(chunk) AS first_chunk, max(chunk) AS matched, array_to_string(list_sort(list(DISTINCT 'H' || chunk)), ',') AS headings FROM terms GROUP BY ALL")
q("agg05_grouped_hits", lambda s, d: terms(s, d).groupBy("chunk", "source").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("task").alias("matched")).withColumn("place", F.expr("row_number() OVER (PARTITION BY chunk ORDER BY hits DESC, matched DESC, source)").cast("long")), f"WITH {TERMS_SQL} SELECT chunk, source, count(*) AS hits, count(DISTINCT task) AS matched, row_number() OVER (PARTITION BY chunk ORDER BY count(*) DESC, count(DISTINCT task) DESC, source) AS place FROM terms GROUP BY chunk, source")
q("agg06_final_order", lambda s, d: terms(s, d).groupBy("source", "translation").agg(F.countDistinct("task").alias("matched"), F.count(F.lit(1)).alias("n"), F.min("chunk").alias("first")).withColumn("same", F.expr("lag(source) OVER (ORDER BY matched DESC, n DESC, first, source, translation) = source")).filter(~F.coalesce("same", F.lit(False))).drop("same"), f"WITH {TERMS_SQL}, g AS (SELECT source, translation, count(DISTINCT task) AS matched, count(*) AS n, min(chunk) AS first FROM terms GROUP BY 1, 2) SELECT * EXCLUDE same FROM (SELECT *, lag(source) OVER (ORDER BY matched DESC, n DESC, first, source, translation) = source AS same FROM g) WHERE NOT coalesce(same, false)")
q("srt06_hint_order", lambda s, d: G.hint_order(hints(s, d)).select("id", "source", "occurrences"), f"WITH {HINTS_SQL} SELECT id, source, occurrences FROM hints ORDER BY target IS NOT NULL DESC, occurrences DESC, first_chunk, source, id")
q("srt06_hint_places", lambda s, d: G.hint_places(hints(s, d)).select("id", "source", "occurrences", "place"), f"WITH {HINTS_SQL} SELECT id, source, occurrences, row_number() OVER (ORDER BY target IS NOT NULL DESC, occurrences DESC, first_chunk, source, id) AS place FROM hints")
q("srt08_cast_block", lambda s, d: G.cast_block(hints(s, d), 40, "task").select("task", "id", "source"), f"WITH {HINTS_SQL} SELECT task, id, source FROM hints WHERE enforcement = 'strict' AND target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task ORDER BY first_chunk, source, id) <= 40")
q("srt09_selection", lambda s, d: G.selection_order(hints(s, d), "task").select("task", "id", "place"), f"WITH {HINTS_SQL} SELECT task, id, row_number() OVER (PARTITION BY task ORDER BY CASE WHEN enforcement = 'strict' AND target IS NOT NULL THEN 0 ELSE 1 END, first_chunk, source, id) AS place FROM hints")


# terms that the chunks hold: common words of the language
_tl = ["the", "of", "this", "der", "que", "thing", "and on"]
tl = lambda s, d, n="term": chunks(s, d).select("task").distinct().crossJoin(fixture(s, [(t,) for t in _tl], f"{n} string"))  # noqa: E731  seven literals
q("jn15_occurrences", lambda s, d: G.occurrence_stats(tl(s, d), chunks(s, d), "task"), f"WITH {CHUNKS_SQL}, t AS (SELECT * FROM {values_sql([(t,) for t in _tl], 'term')}), x AS (SELECT task, idx, term, (length(source) - length(replace(source, term, ''))) // length(term) AS n FROM chunks, t WHERE list_contains(regexp_extract_all(lower(source), '[a-z0-9]+'), regexp_extract(term, '[a-z0-9]+'))) SELECT task, term, CAST(sum(n) AS BIGINT) AS occurrences, min(idx) AS first_chunk, count(*) AS matched FROM x WHERE n > 0 GROUP BY task, term")
q("flt16_mentions", lambda s, d: G.mentioned(tl(s, d), chunks(s, d), "task"), f"WITH {CHUNKS_SQL}, t AS (SELECT * FROM {values_sql([(t,) for t in _tl], 'term')}) SELECT task, idx, term FROM chunks, t WHERE regexp_matches(' ' || source || ' ', '[^A-Za-z0-9_-]' || term || '[^A-Za-z0-9_-]')")
q("jn08_glossary_mentions", lambda s, d: G.mentioned(tl(s, d), chunks(s, d), "task").groupBy("task", "idx").agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("terms")), f"WITH {CHUNKS_SQL}, t AS (SELECT * FROM {values_sql([(t,) for t in _tl], 'term')}) SELECT task, idx, string_agg(term, ',' ORDER BY term) AS terms FROM chunks, t WHERE regexp_matches(' ' || source || ' ', '[^A-Za-z0-9_-]' || term || '[^A-Za-z0-9_-]') GROUP BY task, idx")
q("jn09_strict_hits", lambda s, d: G.mentioned(tl(s, d), chunks(s, d), "task").withColumn("origin", F.lit("static")).unionByName(G.mentioned(tl(s, d).filter("length(term) = 3"), chunks(s, d), "task").withColumn("origin", F.lit("noun"))), f"WITH {CHUNKS_SQL}, t AS (SELECT * FROM {values_sql([(t,) for t in _tl], 'term')}), h AS (SELECT task, idx, term FROM chunks, t WHERE regexp_matches(' ' || source || ' ', '[^A-Za-z0-9_-]' || term || '[^A-Za-z0-9_-]')) SELECT *, 'static' AS origin FROM h UNION ALL SELECT *, 'noun' FROM h WHERE length(term) = 3")
q("jn12_terminology", lambda s, d: G.mentioned(tl(s, d), chunks(s, d), "task").join(chunks(s, d), ["task", "idx"]).filter(~F.contains(F.lower("translated"), F.col("term"))).select("task", "idx", "term"), f"WITH {CHUNKS_SQL}, t AS (SELECT * FROM {values_sql([(t,) for t in _tl], 'term')}) SELECT task, idx, term FROM chunks, t WHERE regexp_matches(' ' || source || ' ', '[^A-Za-z0-9_-]' || term || '[^A-Za-z0-9_-]') AND NOT contains(lower(translated), term)")
q("agg02_whole_counts", lambda s, d: G.whole_counts(tl(s, d).withColumn("target", F.concat("term", F.lit("s"))), chunks(s, d), "task").select("task", "term", "in_source"), f"WITH {CHUNKS_SQL}, t AS (SELECT * FROM {values_sql([(t,) for t in _tl], 'term')}), x AS (SELECT task, term, sum((length(source) - length(replace(source, term, ''))) // length(term)) AS a, sum(coalesce((length(translated) - length(replace(translated, term || 's', ''))) // (length(term) + 1), 0)) AS b FROM chunks, t GROUP BY task, term) SELECT task, term, CAST(a AS BIGINT) AS in_source FROM x WHERE a > 0 AND b = 0")
q("jn10_delta_terms", lambda s, d: G.delta_terms(terms(s, d).select("task", F.col("pos").alias("seq"), "chunk", "source"), terms(s, d).select("task", F.col("chunk").alias("idx")).distinct().withColumns({"started": F.col("idx") * 1000, "patched": F.col("task") * 40}), "task").groupBy("task", "idx").agg(F.count(F.lit(1)).alias("terms"), F.min("seq").alias("first")), f"WITH {TERMS_SQL}, c AS (SELECT DISTINCT task, chunk AS idx, chunk * 1000 AS started, task * 40 AS patched FROM terms) SELECT c.task, idx, count(*) AS terms, min(pos) AS first FROM terms t JOIN c ON t.task = c.task AND t.chunk <> c.idx AND pos > greatest(started, patched) GROUP BY ALL")
q("jn11_frozen_index", lambda s, d: G.first_delta_terms(terms(s, d).select("task", F.col("pos").alias("seq"), "chunk", "source"), terms(s, d).select("task", F.col("chunk").alias("idx")).distinct().withColumns({"started": F.col("idx") * 1000, "patched": F.lit(0)}), "task"), f"WITH {TERMS_SQL}, c AS (SELECT DISTINCT task, chunk AS idx, chunk * 1000 AS started FROM terms) SELECT c.task, idx, pos AS seq, source FROM terms t JOIN c ON t.task = c.task AND t.chunk <> c.idx AND pos > started QUALIFY row_number() OVER (PARTITION BY c.task, idx, lower(source) ORDER BY pos, source) = 1")
q("jn14_resource_hints", lambda s, d: G.first_per(hints(s, d).filter("target IS NOT NULL"), X.term_key(F.col("source")), ["id"], "task").select("task", "id", "source", "target"), f"WITH {HINTS_SQL} SELECT task, id, source, target FROM hints WHERE target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task, lower(regexp_replace(source, '[^A-Za-z0-9]', '', 'g')) ORDER BY id) = 1")
q("flt12_hint_applies", lambda s, d: hints(s, d).select("task", "id", (F.when(F.col("target").isNotNull(), F.contains("source", F.lit("ring"))).when(F.col("n_chunks") == 0, F.col("first_chunk") == 3).otherwise(F.array_contains(F.sequence(F.col("first_chunk"), F.col("first_chunk") + F.col("n_chunks") - 1), F.lit(3).cast("long")))).alias("applies")), f"WITH {HINTS_SQL} SELECT task, id, CASE WHEN target IS NOT NULL THEN contains(source, 'ring') WHEN n_chunks = 0 THEN first_chunk = 3 ELSE 3 BETWEEN first_chunk AND first_chunk + n_chunks - 1 END AS applies FROM hints")
q("jn23_carried_over", lambda s, d: G.carried_over(chunks(s, d), chunks(s, d).filter("idx % 2 = 0").select("task", (F.col("idx") + 10).alias("new_idx"), "source"), "task").select("task", "new_idx", "translated"), f"WITH {CHUNKS_SQL}, k AS (SELECT task, source, arg_min(translated, idx) AS translated FROM chunks WHERE translated IS NOT NULL GROUP BY 1, 2) SELECT n.task, n.idx + 10 AS new_idx, k.translated FROM chunks n LEFT JOIN k ON k.task = n.task AND k.source = n.source WHERE n.idx % 2 = 0")
q("str03_key_index", lambda s, d: terms(s, d).groupBy(X.term_key(F.col("source")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last")), f"WITH {TERMS_SQL} SELECT lower(regexp_replace(source, '[^A-Za-z0-9]', '', 'g')) AS key, count(*) AS n, min(pos) AS first, max(pos) AS last FROM terms GROUP BY 1")

# --- chunks
q("flt01_bilingual", lambda s, d: pairs(s, d).filter(X.trim_ws(F.col("source")) != "").select("task", "idx", "source", "target"), f"WITH {PAIRS_SQL} SELECT task, idx, source, target FROM p WHERE trim(source) <> ''")
q("flt02_review_segments", lambda s, d: pairs(s, d).filter(X.trim_ws(F.col("source")) != "").join(reviews(s, d).groupBy(F.col("book").alias("task")).agg(F.max("word").alias("edited")), "task", "left").select("task", "idx", F.coalesce(F.when(F.col("idx") % 2 == 0, F.col("edited")), "target").alias("effective")), f"WITH {PAIRS_SQL}, {REVIEWS_SQL}, o AS (SELECT book AS task, max(word) AS edited FROM reviews GROUP BY 1) SELECT p.task, idx, coalesce(CASE WHEN idx % 2 = 0 THEN edited END, target) AS effective FROM p LEFT JOIN o ON o.task = p.task WHERE trim(source) <> ''")
q("flt03_pending", lambda s, d: C.pending(chunks(s, d)).select("task", "idx"), f"WITH {CHUNKS_SQL} SELECT task, idx FROM chunks WHERE kind = 'body' AND stage = 'pending'")
q("flt04_failed", lambda s, d: C.failed(chunks(s, d)).select("task", "idx"), f"WITH {CHUNKS_SQL} SELECT task, idx FROM chunks WHERE kind = 'body' AND stage = 'translationFailed'")
q("flt05_reviewable", lambda s, d: C.reviewable(chunks(s, d)).select("task", "idx"))
q("flt06_skips_review", lambda s, d: pairs(s, d).select("task", "idx", C.skips_review(F.col("source")).alias("skips")))
_b = "kind = 'body' AND translated IS NOT NULL"
q("flt13_needs", lambda s, d: C.needs(chunks(s, d), "task"), f"WITH {CHUNKS_SQL} SELECT task, bool_or({_b} AND stage = 'translated') AS term_consistency, bool_or({_b} AND stage = 'termConsistencyApplied') AS residual_review, bool_or(({_b} AND stage = 'residualReviewed') OR coalesce(kind <> 'body' AND translated = source AND stage <> 'protectedPassthrough', false)) AS merge_ready FROM chunks GROUP BY task")
for _i, _n in ((14, "residual_review"), (15, "merge_ready")):
    q(f"flt{_i}_needs_{_n}", lambda s, d, n=_n: C.needs(chunks(s, d), "task").filter(n).select("task"), f"WITH {CHUNKS_SQL} SELECT task FROM chunks GROUP BY task HAVING " + (f"bool_or({_b} AND stage = 'termConsistencyApplied')" if _i == 14 else f"bool_or(({_b} AND stage = 'residualReviewed') OR coalesce(kind <> 'body' AND translated = source AND stage <> 'protectedPassthrough', false))"))
q("win04_heading", lambda s, d: C.with_heading(chunks(s, d), "task").select("task", "idx", "current"), f"WITH {CHUNKS_SQL} SELECT task, idx, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY task ORDER BY idx ROWS UNBOUNDED PRECEDING), 'Untitled') AS current FROM chunks")
q("win06_references", lambda s, d: C.in_references(chunks(s, d), F.col("idx") % 3 == 1, F.col("idx") % 4 == 3, "task").select("task", "idx", "in_references"), f"WITH {CHUNKS_SQL} SELECT task, idx, coalesce(last_value(CASE WHEN idx % 3 = 1 THEN true WHEN idx % 4 = 3 THEN false END IGNORE NULLS) OVER (PARTITION BY task ORDER BY idx ROWS UNBOUNDED PRECEDING), false) AS in_references FROM chunks")
q("win07_neighbours", lambda s, d: C.neighbours(chunks(s, d), "task").select("task", "idx", "previous", "next"), f"WITH {CHUNKS_SQL} SELECT task, idx, lag({D.trim('source')}) OVER w AS previous, lead({D.trim('source')}) OVER w AS next FROM chunks WINDOW w AS (PARTITION BY task ORDER BY idx)")
q("win08_next_paragraph", lambda s, d: C.neighbours(chunks(s, d), "task").filter("next IS NOT NULL").select("task", "idx", F.length("next").cast("long").alias("n")), f"WITH {CHUNKS_SQL} SELECT task, idx, n FROM (SELECT task, idx, lead(length({D.trim('source')})) OVER (PARTITION BY task ORDER BY idx) AS n FROM chunks) WHERE n IS NOT NULL")
_sn = "list_filter(list_transform(regexp_extract_all(source, '[^.!?。！？\\n]*[.!?。！？\\n]|[^.!?。！？\\n]+'), lambda x: {}), lambda x: x <> '')".format(D.trim("x"))
q("win09_sentence_window", lambda s, d: pairs(s, d).select("task", "idx", C.sentence_window(sentences(F.col("source")), F.lit(1)).alias("w")), f"WITH {PAIRS_SQL} SELECT task, idx, array_to_string(({_sn})[1:3], ' ') AS w FROM p")
q("win11_ewma", lambda s, d: C.ewma(event_log(s, d), "task").withColumn("per_minute", F.round("per_minute", 6)), f"WITH {LOG_SQL}, g AS (SELECT task, seq, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY task ORDER BY seq)) / 1000000.0 AS gap FROM log), r AS (SELECT task, list(60.0 / gap ORDER BY seq) AS h FROM g WHERE gap > 0.001 GROUP BY task) SELECT task, round(list_reduce(h, lambda a, x: 0.7 * a + 0.3 * x), 6) AS per_minute FROM r")
q("win12_log_contract", lambda s, d: C.log_contract(event_log(s, d), ["queued", "translating", "finalized"], "task"), f"WITH {LOG_SQL}, l AS (SELECT *, progress < lag(progress) OVER (PARTITION BY task ORDER BY seq) AS dr FROM log) SELECT task, count(*) FILTER (dr) AS drops, arg_min(stage, seq) = 'queued' AS starts_queued, array_to_string(list_sort(list_filter(['queued', 'translating', 'finalized'], lambda x: NOT list_contains(list(stage), x))), ',') AS missing FROM l GROUP BY task")
q("win13_contiguous", lambda s, d: C.contiguous(chunks(s, d).filter("stage <> 'mergeReady'"), "task"), f"WITH {CHUNKS_SQL} SELECT task, min(idx) = 0 AND max(idx) = count(*) - 1 AND count(DISTINCT idx) = count(*) AS contiguous FROM chunks WHERE stage <> 'mergeReady' GROUP BY task")
q("win14_best_candidate", lambda s, d: C.best_candidate(reviews(s, d).select(F.col("book").alias("task"), F.col("quality").alias("translated"), (F.col("seq") % 3 == 0).alias("exact"), (F.col("seq") % 7).alias("writes"), "ts"), "task"), f"WITH {REVIEWS_SQL} SELECT book AS task, quality AS translated, seq % 3 = 0 AS exact, seq % 7 AS writes, ts FROM reviews QUALIFY row_number() OVER (PARTITION BY book ORDER BY quality DESC, seq % 3 = 0 DESC, seq % 7 DESC, ts DESC) = 1")
q("win17_pseudo_pages", lambda s, d: table(s, d, "orders").select((F.col("o_custkey") % 50).alias("book"), "o_orderkey").withColumn("page", F.expr("floor((row_number() OVER (PARTITION BY book ORDER BY o_orderkey) - 1) / 30) + 1")), "SELECT o_custkey % 50 AS book, o_orderkey, (row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1) // 30 + 1 AS page FROM orders")
q("win18_page_of", lambda s, d: table(s, d, "orders").select("o_orderkey", L.page_of(F.col("o_orderkey") - 100).alias("page")), "SELECT o_orderkey, greatest(o_orderkey - 100, 0) // 30 + 1 AS page FROM orders")
q("win20_water_filling", lambda s, d: C.water_filling(table(s, d, "supplier").select((F.col("s_nationkey") % 5).cast("long").alias("pool"), F.col("s_suppkey").alias("route"), (F.col("s_suppkey") % 13 + 1).cast("double").alias("speed"), (F.col("s_suppkey") % 9).cast("double").alias("capacity")), 20.0, "pool").select("pool", "route", "given"), "WITH r AS (SELECT CAST(s_nationkey % 5 AS BIGINT) AS pool, s_suppkey AS route, CAST(s_suppkey % 13 + 1 AS DOUBLE) AS speed, CAST(s_suppkey % 9 AS DOUBLE) AS capacity FROM supplier), u AS (SELECT *, CASE WHEN speed >= 0.2 * max(speed) OVER (PARTITION BY pool) THEN capacity ELSE 0.0 END AS used FROM r) SELECT pool, route, least(used, greatest(0.0, 20.0 - coalesce(sum(used) OVER (PARTITION BY pool ORDER BY speed DESC, capacity DESC, route ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))) AS given FROM u")
_rank = "list_position(['pending', 'translated', 'termConsistencyApplied', 'residualReviewed', 'translationFailed', 'mergeReady', 'protectedPassthrough'], {})"
q("win21_advance", lambda s, d: C.advanced(chunks(s, d), F.lit("residualReviewed")).select("task", "idx", "stage"), f"WITH {CHUNKS_SQL} SELECT task, idx, CASE WHEN {_rank.format('stage')} <= 4 THEN 'residualReviewed' ELSE stage END AS stage FROM chunks")
q("str15_reset_failed", lambda s, d: C.reset_failed(chunks(s, d)).groupBy("stage").count().withColumnRenamed("count", "n"), f"WITH {CHUNKS_SQL} SELECT CASE WHEN stage = 'translationFailed' THEN 'pending' ELSE stage END AS stage, count(*) AS n FROM chunks GROUP BY 1")
q("str20_merge_ready", lambda s, d: C.marked_ready(chunks(s, d)).groupBy("kind", "stage").count().withColumnRenamed("count", "n"), f"WITH {CHUNKS_SQL} SELECT kind, CASE WHEN {_b} AND stage = 'residualReviewed' THEN 'mergeReady' ELSE stage END AS stage, count(*) AS n FROM chunks GROUP BY 1, 2")
q("str07_flush_interval", lambda s, d: table(s, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") < 3, 1).when(F.col("n_nationkey") < 20, 2).otherwise(4).cast("long").alias("writes")), "SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 1 WHEN n_nationkey < 20 THEN 2 ELSE 4 END AS writes FROM nation")
q("str11_retry_delay", lambda s, d: table(s, d, "events").select("event_id", F.when(F.col("event_type") == "error", F.greatest(F.coalesce(F.when(F.col("event_id") % 2 == 0, F.col("value")), F.lit(60.0)), F.lit(60.0), (F.col("event_id") % 20 * 5).cast("double"))).otherwise((F.col("event_id") % 20 * 5).cast("double")).alias("seconds")), "SELECT event_id, CASE WHEN event_type = 'error' THEN greatest(coalesce(CASE WHEN event_id % 2 = 0 THEN value END, 60.0), 60.0, CAST(event_id % 20 * 5 AS DOUBLE)) ELSE CAST(event_id % 20 * 5 AS DOUBLE) END AS seconds FROM events")
q("jn24_sources_match", lambda s, d: C.sources_match(chunks(s, d), chunks(s, d).withColumn("source", F.when((F.col("task") % 4 == 0) & (F.col("idx") == 1), "changed").otherwise(F.col("source"))), "task"), f"WITH {CHUNKS_SQL} SELECT task, bool_and(translated IS NULL OR NOT (task % 4 = 0 AND idx = 1)) AND bool_or(translated IS NOT NULL) AS match FROM chunks GROUP BY task")

# --- quality
_ln = lambda c: f"(length({c}) - length(replace({c}, '“', '')))"
_rn = lambda c: f"(length({c}) - length(replace({c}, '”', '')))"
q("qa03_quotes", lambda s, d: pairs(s, d).select("task", "idx", C.quote_imbalance(F.col("target")).alias("bad")), f"WITH {PAIRS_SQL} SELECT task, idx, {_ln('target')} <> {_rn('target')} AS bad FROM p")
q("qa04_numbers", lambda s, d: pairs(s, d).select("task", "idx", F.array_join(C.missing_numbers(F.col("source"), F.col("target")), ",").alias("missing")))
q("qa05_half_heading", lambda s, d: pairs(s, d).unionByName(fixture(s, [(-2, 0, "Chapter 1: The Start", "Chapter 1: 开始"), (-2, 1, "Chapter 2: On", "第二章：继续")], "task long, idx long, source string, target string")).select("task", "idx", C.half_heading(F.col("target")).alias("half")), f"WITH {PAIRS_SQL}, x AS (SELECT * FROM p UNION ALL SELECT * FROM {values_sql([(-2, 0, 'a', 'Chapter 1: 开始'), (-2, 1, 'b', '第二章：继续')], 'task, idx, source, target')}) SELECT task, idx, regexp_matches(target, '(?m)^\\s*(?:(?:Book|Volume|Part|Section)\\s+\\w+[,:：]?\\s+)?Chapter\\s+(\\d+)\\s*[:：]\\s*[^\\n]*[一-鿿]') AS half FROM x")
q("qa02_drift", lambda s, d: C.drift(pairs(s, d), "task", "idx"))
_un = f"(trim(target) = '' OR {D.low('trim(target)')} = {D.low('trim(source)')} OR NOT regexp_matches(target, '[一-鿿]'))"
q("qa06_review_checks", lambda s, d: C.review_checks(pairs(s, d), "task", "idx"), f"WITH {PAIRS_SQL} SELECT task, idx, 'untranslated' AS rule FROM p WHERE {_un} UNION ALL SELECT task, idx, 'digits' FROM p WHERE NOT {_un} AND list_sort(regexp_extract_all(source, '[0-9]')) <> list_sort(regexp_extract_all(target, '[0-9]')) UNION ALL SELECT task, idx, 'newlines' FROM p WHERE NOT {_un} AND length(source) - length(replace(source, chr(10), '')) <> length(target) - length(replace(target, chr(10), ''))")
q("qa01_residual_terms", lambda s, d: C.residual_terms(pairs(s, d), True, "task", "idx"), f"WITH {PAIRS_SQL}, t AS (SELECT task, idx, list_transform(regexp_extract_all(source, '[A-Za-z]{{2,}}'), lambda w: {D.low('w')}) AS own, unnest(regexp_extract_all(target, '[A-Za-z]{{2,}}')) AS token FROM p) SELECT task, idx, {D.low('token')} AS term, count(*) AS n FROM t WHERE list_contains(own, {D.low('token')}) AND NOT ({D.isin(D.low('token'), X.RESIDUAL_STOPWORDS)} OR regexp_full_match(token, '[A-Z]+') OR regexp_full_match(token, '[A-Z][a-z]+')) GROUP BY ALL")
q("agg01_validation", lambda s, d: C.validation(chunks(s, d), "task"), f"WITH {CHUNKS_SQL} SELECT task, idx, 'UNTRANSLATED_CHUNK' AS code, 'error' AS level FROM chunks WHERE translated IS NULL UNION ALL SELECT task, idx, 'EMPTY_TRANSLATION', 'error' FROM chunks WHERE kind = 'body' AND trim(translated) = '' AND trim(source) <> '' UNION ALL SELECT task, idx, 'SOURCE_EQUALS_TRANSLATION', 'warning' FROM chunks WHERE kind = 'body' AND translated = source AND trim(source) <> '' UNION ALL SELECT task, idx, 'PDF_TABLE_SNAPSHOT_MISSING', 'error' FROM chunks WHERE kind = 'body' AND contains(translated, 'pdf-table:start') AND NOT contains(translated, 'pdf-table:end')")
q("agg01_validation_summary", lambda s, d: C.validation(chunks(s, d), "task").groupBy("code", "level").count().withColumnRenamed("count", "n"), f"WITH {CHUNKS_SQL} SELECT * FROM (SELECT 'UNTRANSLATED_CHUNK' AS code, 'error' AS level, count(*) AS n FROM chunks WHERE translated IS NULL UNION ALL SELECT 'SOURCE_EQUALS_TRANSLATION', 'warning', count(*) FROM chunks WHERE kind = 'body' AND translated = source AND trim(source) <> '') WHERE n > 0")
q("qa09_strict_hits", lambda s, d: G.mentioned(tl(s, d), chunks(s, d), "task").join(chunks(s, d).filter("translated IS NOT NULL"), ["task", "idx"]).select("task", "idx", "term", F.contains("translated", F.col("term")).alias("kept")), f"WITH {CHUNKS_SQL}, t AS (SELECT * FROM {values_sql([(t,) for t in _tl], 'term')}) SELECT task, idx, term, contains(translated, term) AS kept FROM chunks, t WHERE translated IS NOT NULL AND regexp_matches(' ' || source || ' ', '[^A-Za-z0-9_-]' || term || '[^A-Za-z0-9_-]')")
q("qa10_passthrough", lambda s, d: pairs(s, d).select("task", "idx", (X.near_passthrough(F.col("source"), F.col("target")) & X.english_prose(F.col("target"))).alias("rejected")))
q("qa11_purged", lambda s, d: C.purged(chunks(s, d)).groupBy("task").agg(F.count("translated").alias("kept")), f"WITH {CHUNKS_SQL} SELECT task, count(translated) AS kept FROM chunks GROUP BY task")
q("qa12_manifest", lambda s, d: C.manifest_contract(event_log(s, d).select("task", F.element_at(F.array(*[F.lit(x) for x in C.REQUIRED_ARTIFACTS]), (F.col("seq") % 7 + 1).cast("int")).alias("kind")), "task"), f"WITH {LOG_SQL}, r AS (SELECT ['sourceMarkdown', 'translatedMarkdown', 'translatedHtml', 'checkpoint', 'eventLog', 'validationReport', 'glossary', 'metrics'] AS req), k AS (SELECT task, list(DISTINCT req[seq % 7 + 1]) AS have FROM log, r GROUP BY task) SELECT task, array_to_string(list_sort(list_filter(req, lambda x: NOT list_contains(have, x))), ',') AS missing FROM k, r")
q("qa15_merged", lambda s, d: C.merged(chunks(s, d), "task").select("task", F.md5(F.col("text").cast("binary")).alias("md5"), "missing"), f"WITH {CHUNKS_SQL} SELECT task, md5(coalesce(string_agg(CASE WHEN kind = 'body' AND stage = 'translationFailed' THEN source ELSE translated END, chr(10) || chr(10) ORDER BY idx), '')) AS md5, count(*) FILTER ((CASE WHEN kind = 'body' AND stage = 'translationFailed' THEN source ELSE translated END) IS NULL) AS missing FROM chunks GROUP BY task")
q("srt07_budget", lambda s, d: C.budget(terms(s, d).groupBy("task", F.col("chunk").alias("idx")).agg(F.array_sort(F.collect_set("source")).alias("terms")), 48, "task").select("task", "idx", F.size("terms").cast("long").alias("n")), f"WITH {TERMS_SQL}, x AS (SELECT task, chunk AS idx, count(DISTINCT source) AS n FROM terms GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY task ORDER BY chunk) <= 64), t AS (SELECT task, sum(n) AS total, count(*) AS k FROM x GROUP BY task) SELECT task, idx, CASE WHEN total > 48 THEN least(n, greatest(48 // k, 8)) ELSE n END AS n FROM x JOIN t USING (task)")
q("agg22_running_cap", lambda s, d: C.running_cap(terms(s, d).groupBy("task", F.col("chunk").alias("idx")).agg(F.countDistinct("source").alias("n")), 48, "task"), f"WITH {TERMS_SQL}, x AS (SELECT task, chunk AS idx, count(DISTINCT source) AS n FROM terms GROUP BY 1, 2) SELECT task, idx, n, CAST(least(n, greatest(0, 48 - coalesce(sum(n) OVER (PARTITION BY task ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS counted FROM x")
q("srt10_style_sample", lambda s, d: pairs(s, d).groupBy("task").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "source"))), lambda x: x["source"]), "\n\n").alias("t")).select("task", F.length(C.style_sample(F.col("t"))).cast("long").alias("chars")))
q("jn26_patch_target", lambda s, d: pairs(s, d).withColumn("ss", sentences(F.col("source"))).withColumn("ts", sentences(F.col("target"))).withColumn("i", F.array_position(F.transform("ss", lambda x: F.contains(x, F.lit("the"))), True) - 1).filter("i >= 0").select("task", "idx", F.get("ss", F.col("i").cast("int")).alias("source_sentence"), F.coalesce(F.get("ts", F.col("i").cast("int")), F.get(F.reverse("ts"), F.lit(0))).alias("target_sentence")), f"WITH {PAIRS_SQL}, x AS (SELECT task, idx, {_sn} AS ss, {_sn.replace('(source,', '(target,')} AS ts FROM p), y AS (SELECT *, list_position(list_transform(ss, lambda z: contains(z, 'the')), true) AS i FROM x) SELECT task, idx, ss[i] AS source_sentence, coalesce(ts[i], ts[-1]) AS target_sentence FROM y WHERE i > 0")

# --- library and tables of contents
q("flt08_search", lambda s, d: L.search(books(s, d), " MACH ", "title", "category").select("id"), f"WITH {BOOKS_SQL} SELECT id FROM books WHERE contains(lower(concat_ws(' ', title, category)), 'mach')")
q("flt09_shelf", lambda s, d: L.shelf(books(s, d), ["auto", "build"]).select("id"), f"WITH {BOOKS_SQL} SELECT id FROM books WHERE contains(lower(category), 'auto') OR contains(lower(category), 'build')")
_fn = ["a.pdf", "b.EPUB", "c.docx", "d.md", "e.markdown", "f.TXT", "g.doc", "h", "x.pdf.zip"]
q("flt10_importable", lambda s, d: fixture(s, [(x,) for x in _fn], "name string").union(table(s, d, "pages").select("url")).select("name", L.importable(F.col("name")).alias("ok")), f"SELECT name, regexp_matches(lower(name), '\\.(pdf|epub|docx|md|markdown|txt)$') AS ok FROM (SELECT * FROM {values_sql([(x,) for x in _fn], 'name')} UNION ALL SELECT url FROM pages)")
q("src01_document_kind", lambda s, d: fixture(s, [(x,) for x in _fn], "name string").select("name", L.document_kind(F.col("name")).alias("kind")), f"SELECT name, CASE lower(regexp_extract(name, '\\.([^.]+)$', 1)) WHEN 'pdf' THEN 'Pdf' WHEN 'epub' THEN 'Epub' WHEN 'docx' THEN 'Docx' WHEN 'md' THEN 'Markdown' WHEN 'markdown' THEN 'Markdown' WHEN 'txt' THEN 'Text' END AS kind FROM {values_sql([(x,) for x in _fn], 'name')}")
_state = lambda s, d: reviews(s, d).groupBy("book").agg((F.max("quality") * 20).cast("double").alias("progress"), F.max("ts").alias("last_read"))
q("jn06_with_state", lambda s, d: L.with_state(books(s, d), _state(s, d)).select("id", "title", "progress", "last_read"), f"WITH {BOOKS_SQL}, {REVIEWS_SQL}, st AS (SELECT book, CAST(max(quality) * 20 AS DOUBLE) AS read, max(ts) AS last_read FROM reviews GROUP BY 1) SELECT id, title, coalesce(read, progress) AS progress, last_read FROM books LEFT JOIN st ON id = book")
_nt = lambda s, d, r: reviews(s, d).filter(f"quality = {r}").select((F.col("book") * 13).alias("book"), "seq", "ts")
_ns = f"WITH {BOOKS_SQL}, {REVIEWS_SQL}, n AS (SELECT book * 13 AS book, seq, ts, CASE quality WHEN 0 THEN 'anno' ELSE 'bookmark' END AS kind FROM reviews WHERE quality IN (0, 1)) SELECT book, seq, kind, coalesce(nullif(title, ''), 'Unknown book') AS title FROM n LEFT JOIN books ON id = book"
q("jn07_notes", lambda s, d: L.notes(_nt(s, d, 0), _nt(s, d, 1), books(s, d)).select("book", "seq", "kind", "title"), _ns)
q("set14_recent_notes", lambda s, d: L.newest(L.notes(_nt(s, d, 0), _nt(s, d, 1), books(s, d)), 3, "seq").select("book", "seq", "kind", "title"), f"{_ns} ORDER BY ts DESC, seq LIMIT 3")
q("srt05_title_order", lambda s, d: books(s, d).select("id", F.expr("1").alias("one"), L.numeric_key(F.concat(F.lit("Vol "), F.col("id") % 100, F.lit(" x"))).alias("key")).drop("one"), f"WITH {BOOKS_SQL} SELECT id, 'vol ' || lpad(CAST(id % 100 AS VARCHAR), 12, '0') || ' x' AS key FROM books")
q("srt12_shelf_slices", lambda s, d: books(s, d).orderBy(F.desc("progress"), "id").limit(6).withColumn("current", F.expr("row_number() OVER (ORDER BY progress DESC, id) = 1")).select("id", "current"), f"WITH {BOOKS_SQL}, t AS (SELECT id, row_number() OVER (ORDER BY progress DESC, id) AS r FROM books) SELECT id, r = 1 AS current FROM t WHERE r <= 6")
q("srt13_upper_median", lambda s, d: table(s, d, "supplier").filter("s_acctbal > 0").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_acctbal")).alias("w")).select("s_nationkey", F.element_at("w", F.floor(F.size("w") / 2).cast("int") + 1).alias("median")), "SELECT s_nationkey, list_sort(list(s_acctbal))[count(*) // 2 + 1] AS median FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey")
q("jn17_reader_toc", lambda s, d: T.reader_items(toc(s, d), translated_toc(s, d), "doc").select("doc", "ord", "title", "progress", "source_title"), f"WITH {TTOC_SQL}, n AS (SELECT doc, count(*) AS n FROM toc GROUP BY doc), x AS (SELECT t.doc, t.ord, trim(coalesce(nullif(trim(translated_title), ''), source_title)) AS title, greatest(1, least(100, (t.ord + 1) * 100 // n)) AS progress, source_title FROM toc t LEFT JOIN ttoc b ON b.doc = t.doc AND b.ord = t.ord JOIN n ON n.doc = t.doc) SELECT doc, ord, title, progress, CASE WHEN trim(source_title) <> title THEN source_title END AS source_title FROM x WHERE title <> ''")
_hs = lambda s, d: toc(s, d).select("doc", "ord", "level", F.col("source_title").alias("title"))
_ht = lambda s, d: toc(s, d).select("doc", "ord", F.upper("source_title").alias("title"))
HP = "hp AS (SELECT doc, level, lower(trim(source_title)) AS key, upper(any_value(source_title)) AS title FROM toc GROUP BY 1, 2, 3 HAVING count(*) = 1)"
q("jn25_heading_pairs", lambda s, d: T.heading_pairs(_hs(s, d), _ht(s, d), "doc"), f"WITH {TOC_SQL}, {HP} SELECT * FROM hp")
q("jn19_translated_titles", lambda s, d: T.translated_titles(toc(s, d), T.heading_pairs(_hs(s, d), _ht(s, d), "doc"), "doc").select("doc", "ord", "translated_title"), f"WITH {TOC_SQL}, {HP} SELECT t.doc, t.ord, hp.title AS translated_title FROM toc t LEFT JOIN hp ON hp.doc = t.doc AND hp.level = t.level AND hp.key = lower(trim(source_title))")
_tt = lambda s, d: toc(s, d).select("doc", "ord", F.col("source_title").alias("title"), F.col("level").cast("int").alias("level"))
q("win22_toc_edit", lambda s, d: T.edited(_tt(s, d), _tt(s, d).filter("ord = 2").select("doc", "ord", F.lit("renamed").alias("title")), _tt(s, d).filter("ord = 3").select("doc", "ord"), _tt(s, d).filter("ord = 1").select("doc", F.col("ord").alias("after"), F.lit(0).cast("long").alias("pos"), F.lit("added").alias("title"), F.lit(0).alias("level")), "doc").select("doc", "ord", "title", F.col("level").cast("long").alias("level")), f"WITH {TOC_SQL}, a AS (SELECT doc, ord AS place, 0 AS w, CASE WHEN ord = 2 THEN 'renamed' ELSE source_title END AS title, level FROM toc WHERE ord <> 3 UNION ALL SELECT doc, 1, 1, 'added', 1 FROM toc WHERE ord = 1) SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY place, w) - 1 AS ord, title, level FROM a")
