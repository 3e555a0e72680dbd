"""Relations that stand in for the library's inputs, from the driver's tables and literal rows.

Each comes twice, as a DataFrame and as DuckDB SQL (a common table expression), so that a query and its
SQL see the same rows. The driver's texts hold no headings, blank lines, Chinese or references; literal
rows supply those.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.sources.tables import table

SNIPPETS = [
    "# Chapter One", "## 第十二章 开始", "### References:", "Bibliography", "#Acknowledgments:", "   ", "", "![](img/a.png)", "![alt](b.png) ", "> quoted line", "- item one", "* item two", "1. first", "```code",
    "| a | b |", "[1] Smith, J. (1999). A study of things. Journal of Stuff, 12, 34-56.", "12. Doe, A., & Roe, B. (2004). On it. Cambridge: Press.", "Brown, K. L. (2010). Words and more. Nature, 5, 1-9. doi.org/10.1",
    "C++ and C# & R-D at 50% = x@y", "state-of-the-art -- or - not", "The Tale of Two Cities", "Queen Mary", "Temple of Heaven", "Lord of Rings", "Paris", "John Smith", "And The Old Man Before", "I", "Now Then", "USA",
    "他说“你好。”然后走了", "“没错。”她抬起下巴。你在找。”", "ひらがなとカタカナ", "漢字 and English mixed 漢字", "€™█ broken text", "bad � char", "12% of 34 in 1999 and 2050.5 or 7", "New 5 York, Old Town; (Table 1). All types",
    "3.2 Methods and data", "Appendix A: Extra", "IV", "twelve", "21", "第3章：起点", "第三章 起点", "title", "Heading 2 Char", "标题3", "Subtitle", "See [link](http://a.b/c) and [x](y", "one   two   three", "&amp;lt;b&gt; &quot;q&quot; &#39;s",
    "<p>Hello <b>World</b></p><script>x<y</script>", "a < b > c <unclosed", 'a/b\\c:d*e?"f<g>h|i', "elapsed_ms=120; stage=x; elapsed_ms=7", "stage=done;elapsed_ms= 33ms", '{"translatedText": "好 \\n text", "confirmedTerms": []}',
    'noise {"translatedText": "cut off \\"here\\" end", "conf', "running making skied bigger biggest cities boxes wolves stopped 's dog's", "words like \"foo\"", "Keep the tone plain.", "abstract", "Keywords  ", "参考文献", "致谢",
]
PAIRS = [
    ("“Please don’t go.”", "“请别走"), ("He said \"no\"", "“不”他说“"), ("12% of 34 in 1999", "34"), ("Chapter 1: Start", "第一章 开始"), ("One Two", "第3章：一二"), ("Chapter 2", "第二章："), ("第四章", "Chapter 4"),
    ("Alice Johnson met Bob", "Alice 见了鲍勃"), ("wonderland", "仙境 wonderland"), ("same text here", "same text here"), ("kitten", "sitting"), ("", ""), ("abc", ""), ("The quick brown fox", "the quick brown fix"),
    ("[[B000]] a [[B001]] b [[B002]] c", "[[B000]] x [[B002]] y [[B002]] z [[B009]]"), ("# T\n\nbody", "body"), ("# A\n\ntext\n\n## B", "# 甲\n\n文\n\n## 乙"),
    (" ".join(f"word{i} in the body of this text" for i in range(12)), " ".join(f"word{i} in the body of this text" for i in range(12))),
    (" ".join("alpha beta gamma delta epsilon" for _ in range(12)), " ".join("alpha beta gamma delta epsilom" for _ in range(12))),
    (" ".join("some english words to keep" for _ in range(14)), " ".join("some english words to keep" for _ in range(14)) + " 汉"),
]


def quote(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + v.replace("'", "''") + "'"


def values_sql(rows: list[tuple], names: str) -> str:
    """``(VALUES ...) t(names)`` of literal rows. Strings with control characters are joined by chr()."""

    def one(v) -> str:
        return quote(v) if not isinstance(v, str) or "\n" not in v and "\t" not in v else "(" + " || chr(10) || ".join(quote(x) for x in v.split("\n")).replace("\t", "' || chr(9) || '") + ")"

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") t({names})"


def fixture(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# Texts: lines of documents and literal snippets ----------------------------------------------------


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, n, t)."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")))
    own = fixture(spark, [(-1, i, t) for i, t in enumerate(SNIPPETS)], "id long, n int, t string")
    return lines.select(F.col("doc_id").alias("id"), F.col("pos").alias("n"), F.col("col").alias("t")).union(own)


SNIPPETS_SQL = (
    "s AS (SELECT doc_id AS id, unnest(generate_series(0, len(ls) - 1)) AS n, unnest(ls) AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) "
    f"UNION ALL SELECT * FROM {values_sql([(-1, i, t) for i, t in enumerate(SNIPPETS)], 'id, n, t')})"
)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, idx, source, target): a user's turn and the assistant's next one, and literal pairs."""
    turns = table(spark, sf_dir, "conversations")
    answers = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    own = fixture(spark, [(-1, i, *p) for i, p in enumerate(PAIRS)], "task long, idx long, source string, target string")
    both = turns.filter("role = 'user'").join(answers, ["conv_id", "turn"])
    return both.select(F.col("conv_id").alias("task"), F.col("turn").alias("idx"), F.col("text").alias("source"), "target").union(own)


PAIRS_SQL = (
    "p AS (SELECT u.conv_id AS task, u.turn AS idx, u.text AS source, a.text AS target FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 "
    f"WHERE u.role = 'user' AND a.role = 'assistant' UNION ALL SELECT * FROM {values_sql([(-1, i, *p) for i, p in enumerate(PAIRS)], 'task, idx, source, target')})"
)


# Words and the graded dictionary -------------------------------------------------------------------


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, pos, word): English words of documents (see ``segments.english_words``)."""
    return of_documents(table(spark, sf_dir, "documents"))


def of_documents(docs: DataFrame) -> DataFrame:
    from quire.functions.segments import english_words

    return docs.select("doc_id", "lang", F.posexplode(english_words(F.coalesce("text", F.lit("")))).alias("pos", "word"))


TOKENS_SQL = (
    "tok AS MATERIALIZED (SELECT doc_id, lang, unnest(generate_series(0, len(ws) - 1)) AS pos, unnest(ws) AS word FROM (SELECT doc_id, lang, list_filter(list_transform(list_filter("
    "regexp_split_to_array(coalesce(text, ''), '[^A-Za-z''-]+'), lambda w: length(w) >= 3), lambda w: trim(w, '''-')), lambda w: w <> '') AS ws FROM documents) WHERE len(ws) > 0)"
)


def staged_tokens(spark: SparkSession, sf_dir: str, *by: str, **more: Column) -> DataFrame:
    """(*by, word, n, *more): tokens in lower case, summed up and stored, for queries that read them several times."""
    from quire.streaming.state import shared_folder

    docs = table(spark, sf_dir, "documents")
    docs = docs.repartition("doc_id") if "doc_id" in by else docs  # their words are more than their texts
    path, rows = shared_folder(spark), of_documents(docs).groupBy(*by, F.lower("word").alias("word"))
    rows = rows.agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in more.items()])
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def vocabulary(spark: SparkSession, sf_dir: str, tok: DataFrame | None = None) -> DataFrame:
    """(word, n): distinct lower-case words and their numbers; of ``tok``, if that is staged."""
    if tok is not None:
        return tok.groupBy("word").agg(F.sum("n").alias("n"))
    return tokens(spark, sf_dir).groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))  # they are ASCII


def dictionary(spark: SparkSession, sf_dir: str, tok: DataFrame | None = None) -> DataFrame:
    """(word, rank): lower-case words in ten tiers by frequency; the commonest tenth has rank 0."""
    # ranks need one order over the vocabulary; frequencies are summed before it, so the window sees
    # a row for each word
    counts = vocabulary(spark, sf_dir, tok)
    return counts.select("word", (F.ntile(10).over(Window.orderBy(F.desc("n"), "word")) - 1).alias("rank"))


LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
DICT_SQL = f"{TOKENS_SQL}, dict AS MATERIALIZED (SELECT word, ntile(10) OVER (ORDER BY n DESC, word) - 1 AS rank FROM (SELECT {LOW.format('word')} AS word, count(*) AS n FROM tok GROUP BY 1))"


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# Chunks, event logs, terms, hints, cards, books ----------------------------------------------------


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, idx, source, translated, kind, stage, heading): turns as units of work."""
    rows = pairs(spark, sf_dir).filter("task >= 0")
    rows = rows.withColumn("idx", F.row_number().over(Window.partitionBy("task").orderBy("idx")) - 1)
    mix = F.col("task") + F.col("idx")
    kind = F.when(mix % 10 == 7, "reference").when(mix % 10 == 8, "protectedMetadata").when(mix % 10 == 9, "pdfTable").otherwise("body")
    done = (F.col("task") + 2 * F.col("idx")) % 7 != 0
    stages = F.array(*[F.lit(x) for x in ("translated", "termConsistencyApplied", "residualReviewed", "mergeReady")])
    stage = (
        F.when(~done & (F.col("task") % 3 == 0), "translationFailed").when(~done, "pending").when(kind != "body", "protectedPassthrough")
        .otherwise(F.element_at(stages, (mix % 4 + 1).cast("int")))
    )
    heading = F.when(F.col("idx") % 3 == 0, F.concat(F.lit("Heading "), F.col("task") % 5, F.lit("."), F.col("idx")))
    return rows.select("task", F.col("idx").cast("long").alias("idx"), "source", F.when(done, F.col("target")).alias("translated"), kind.alias("kind"), stage.alias("stage"), heading.alias("heading"))


CHUNKS_SQL = (
    f"{PAIRS_SQL}, c0 AS (SELECT task, row_number() OVER (PARTITION BY task ORDER BY idx) - 1 AS idx, source, target FROM p WHERE task >= 0), c1 AS (SELECT *, (task + 2 * idx) % 7 <> 0 AS done, "
    "CASE (task + idx) % 10 WHEN 7 THEN 'reference' WHEN 8 THEN 'protectedMetadata' WHEN 9 THEN 'pdfTable' ELSE 'body' END AS kind FROM c0), "
    "chunks AS (SELECT task, idx, source, CASE WHEN done THEN target END AS translated, kind, CASE WHEN NOT done AND task % 3 = 0 THEN 'translationFailed' WHEN NOT done THEN 'pending' WHEN kind <> 'body' THEN 'protectedPassthrough' "
    "ELSE ['translated', 'termConsistencyApplied', 'residualReviewed', 'mergeReady'][(task + idx) % 4 + 1] END AS stage, CASE WHEN idx % 3 = 0 THEN 'Heading ' || task % 5 || '.' || idx END AS heading FROM c1)"
)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, seq, ts, stage, message, progress)."""
    k = F.get_json_object("props", "$.k").cast("long")
    stage = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "chunk_translated").when(F.col("event_type") == "click", "pipeline_stage").when(F.col("event_type") == "purchase", "chunk_structure_check").otherwise("error")
    ms = F.floor(F.col("value") * 2000).cast("long")
    message = F.concat(F.lit("index="), F.col("event_id") % 97, F.lit("; elapsed_ms="), ms, F.lit("; llm_elapsed_ms="), F.floor(ms / 2), F.lit("; wait_ms="), k, F.lit("; mismatch="), k % 2, F.lit("; stage=s"), k % 4)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), F.col("event_id").alias("seq"), "ts", stage.alias("stage"), message.alias("message"), (F.col("event_id") % 101).alias("progress"))


LOG_SQL = (
    "log AS (SELECT user_id AS task, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'chunk_translated' WHEN 'click' THEN 'pipeline_stage' WHEN 'purchase' THEN 'chunk_structure_check' ELSE 'error' END AS stage, "
    "'index=' || event_id % 97 || '; elapsed_ms=' || ms || '; llm_elapsed_ms=' || ms // 2 || '; wait_ms=' || k || '; mismatch=' || k % 2 || '; stage=s' || k % 4 AS message, event_id % 101 AS progress "
    "FROM (SELECT *, CAST(floor(value * 2000) AS BIGINT) AS ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"
)


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, chunk, pos, source, translation, confidence): confirmed terms."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 200).alias("task"), F.col("l_linenumber").cast("long").alias("chunk"), F.col("l_orderkey").alias("pos"), F.concat(F.when(F.col("l_suppkey") % 2 == 0, "Term ").otherwise("term "), F.col("l_partkey") % 50).alias("source"),
        F.concat(F.lit("T"), F.col("l_suppkey") % 4).alias("translation"), (F.col("l_quantity").cast("long") + 60).alias("confidence"),
    )


TERMS_SQL = "terms AS (SELECT l_orderkey % 200 AS task, CAST(l_linenumber AS BIGINT) AS chunk, l_orderkey AS pos, CASE WHEN l_suppkey % 2 = 0 THEN 'Term ' ELSE 'term ' END || l_partkey % 50 AS source, 'T' || l_suppkey % 4 AS translation, CAST(l_quantity AS BIGINT) + 60 AS confidence FROM lineitem)"


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, id, source, target, enforcement, occurrences, first_chunk, n_chunks): proper nouns."""
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 20).alias("task"), F.col("p_partkey").alias("id"), F.col("p_name").alias("source"), F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("T"), F.col("p_partkey") % 50)).alias("target"),
        F.when(F.col("p_size") % 3 == 0, "contextual").otherwise("strict").alias("enforcement"), F.col("p_size").cast("long").alias("occurrences"), (F.col("p_size") % 7).cast("long").alias("first_chunk"), (F.col("p_size") % 5).cast("long").alias("n_chunks"),
    )


HINTS_SQL = "hints AS (SELECT p_partkey % 20 AS task, p_partkey AS id, p_name AS source, CASE WHEN p_partkey % 4 <> 0 THEN 'T' || p_partkey % 50 END AS target, CASE WHEN p_size % 3 = 0 THEN 'contextual' ELSE 'strict' END AS enforcement, CAST(p_size AS BIGINT) AS occurrences, CAST(p_size % 7 AS BIGINT) AS first_chunk, CAST(p_size % 5 AS BIGINT) AS n_chunks FROM part)"


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, word, quality, minutes, ts, seq): reviews of cards, which are readings too."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("book"), F.concat("event_type", F.get_json_object("props", "$.k").cast("long") % 5).alias("word"), (F.col("event_id") % 6).alias("quality"), F.col("value").alias("minutes"), "ts", F.col("event_id").alias("seq"))


REVIEWS_SQL = "reviews AS (SELECT user_id AS book, event_type || CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS word, event_id % 6 AS quality, value AS minutes, ts, event_id AS seq FROM events)"


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, category, progress)."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).otherwise("").alias("category"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(F.col("c_acctbal") / 80).cast("double"))).alias("progress")
    )


BOOKS_SQL = "books AS (SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment ELSE '' END AS category, greatest(0.0, least(100.0, CAST(floor(c_acctbal / 80) AS DOUBLE))) AS progress FROM customer)"
TODAY, NOW = "2024-01-30", "2024-01-31 00:00:00"
