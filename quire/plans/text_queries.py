"""Text functions, one query each, over lines of documents, pages, turns and literal snippets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import segments as G
from quire.functions import text as X
from quire.registry import query
from quire.sources.tables import table

from . import duck as D
from .standins import PAIRS_SQL, SNIPPETS_SQL, TOKENS_SQL, pairs, snippets, tokens


def one(name: str, f: Callable[[Column], Column], sql: str | None) -> None:
    """A function of one text: (id, n, out)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return snippets(spark, sf_dir).select("id", F.col("n").cast("long").alias("n"), f(F.col("t")).alias("out"))

    query(name, None if sql is None else f"WITH {SNIPPETS_SQL} SELECT id, n, {sql} AS out FROM s")(run)


def two(name: str, f: Callable[[Column, Column], Column], sql: str | None) -> None:
    """A function of a source and its target: (task, idx, out)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pairs(spark, sf_dir).select("task", "idx", f(F.col("source"), F.col("target")).alias("out"))

    query(name, None if sql is None else f"WITH {PAIRS_SQL} SELECT task, idx, {sql} AS out FROM p")(run)


def page(name: str, f: Callable[[Column], Column], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "pages").select("page_id", f(F.col("html")).alias("out"))

    query(name, f"SELECT page_id, {sql} AS out FROM pages")(run)


def joined(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: F.array_join(f(c), "|")


long = lambda f: lambda *c: f(*c).cast("long")

# --- terms
_key = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(^|[^A-Za-z0-9])-', '\\1minus', 'g'), '(^|[^A-Za-z0-9])-', '\\1minus', 'g'), '-([^A-Za-z0-9]|$)', 'minus\\1', 'g'), '-([^A-Za-z0-9]|$)', 'minus\\1', 'g')"


def key_sql(x: str) -> str:
    x = _key.format(x)
    for s, n in X.SYMBOLS.items():
        x = f"replace({x}, '{s}', '{n}')"
    return D.low(f"regexp_replace({x}, '[^A-Za-z0-9]', '', 'g')")


one("txt01_term_key", X.term_key, key_sql("t"))
_doc = "CASE WHEN n = 0 THEN 'unknown' WHEN kana / n > 0.05 THEN 'ja' WHEN cjk / n > 0.3 THEN 'zh' WHEN latin / n > 0.4 THEN 'en' ELSE 'unknown' END"


@query("txt02_language", f"WITH {SNIPPETS_SQL}, a AS (SELECT id AS doc_id, n AS pos, substr(t, 1, 2000) AS t FROM s), b AS (SELECT doc_id, pos, CAST(length(t) AS DOUBLE) AS n, {D.count('t', '[぀-ヿ]')} AS kana, {D.count('t', '[一-鿿]')} AS cjk, {D.count('t', '[A-Za-z]')} AS latin FROM a) SELECT doc_id, CAST(pos AS BIGINT) AS pos, {_doc} AS language FROM b")
def txt02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snippets(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("pos"), X.language(F.col("t")).alias("language"))


_ent = "replace(replace(replace(replace(replace({}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')"
_dec = lambda x: f"replace(replace({_ent.format(f"replace({x}, '&nbsp;', ' ')")}, '&apos;', ''''), '&#x27;', '''')"
_text = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</?(p|div|section|article|h1|h2|h3|h4|h5|h6|li|blockquote|tr|td|th)>', chr(10), 'g'), '(?is)<[^>]+>', ' ', 'g')"
_para = lambda x: f"array_to_string(list_filter(list_transform({D.lines(x)}, lambda y: {D.trim('y')}), lambda y: y <> ''), chr(10) || chr(10))"
page("txt03_html_text", X.html_text, _para(_dec(_text.format("html"))))
page("txt04_html_heading", X.html_heading, f"nullif({D.collapse(_dec("regexp_replace(regexp_extract(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1), '(?is)<[^>]+>', ' ', 'g')"))}, '')")
_kind = (
    "CASE WHEN starts_with(b, '#') THEN 'heading' WHEN starts_with(b, '![') THEN 'image' WHEN starts_with(b, '>') THEN 'blockquote' WHEN starts_with(b, '- ') OR starts_with(b, '* ') OR starts_with(b, '1. ') THEN 'list' "
    f"WHEN starts_with(b, '```') THEN 'code' WHEN b = '' OR len(list_filter({D.lines('b')}, lambda x: NOT starts_with({D.ltrim('x')}, '|'))) = 0 THEN 'table' ELSE 'paragraph' END"
)
kind_sql = lambda x: _kind.replace("(b,", f"({x},").replace("b = ''", f"{x} = ''").replace("(b, chr", f"({x}, chr").replace("replace(b,", f"replace({x},")
one("txt05_block_kind", X.block_kind, kind_sql(D.trim("t")))
_plain = lambda x: D.trim(f"array_to_string(list_transform({D.lines(x)}, lambda y: {D.trim(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({D.trim('y')}, '^#+', ''), '^>+', ''), '^(?:- )+', ''), '^(?:\\* )+', '')")}), ' ')")
one("txt06_plain_text", X.plain_text, _plain("t"))
one("txt07_translatable", X.translatable, f"{kind_sql(D.trim('t'))} NOT IN ('image', 'code')")
page("txt08_article", X.article_html, "coalesce(nullif(regexp_extract(html, '(?is)<article[\\s>].*?</article>', 0), ''), nullif(regexp_extract(html, '(?is)<main[\\s>].*?</main>', 0), ''), nullif(regexp_extract(html, '(?is)<body[\\s>].*?</body>', 0), ''), html)")
page("txt10_page_title", X.html_title, _ent.format(f"nullif({D.trim("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '')"))
page("txt11_strip_tags", X.strip_tags, "regexp_replace(html, '(?s)<[^>]*>?|>', '', 'g')")
one("txt12_entities", X.decode_entities, _ent.format("t"))
one("txt13_file_component", X.file_component, f"CASE WHEN {D.trim("substr(regexp_replace(t, '[/\\\\:*?\"<>|]', '_', 'g'), 1, 60)")} = '' THEN 'web-article' ELSE {D.trim("substr(regexp_replace(t, '[/\\\\:*?\"<>|]', '_', 'g'), 1, 60)")} END")
_strong = D.count("t", r"[\x{E000}-\x{F8FF}€™█\x{FFFD}]")
one("txt15_mojibake", lambda c: F.concat_ws("/", X.mojibake(c)["polluted"].cast("string"), X.mojibake(c)["score"]), f"CASE WHEN length(t) < 4 THEN 'false/0' ELSE CAST(({_strong} >= 2 AND ({_strong} + {D.count('t', f'[{X.MOJIBAKE_CJK}]')}) * 100 // length(t) >= 2) OR contains(t, '�') AS VARCHAR) || '/' || ({_strong} + {D.count('t', f'[{X.MOJIBAKE_CJK}]')}) END")
two("txt16_untranslated_body", X.untranslated_body, None)
_aw = lambda x: f"len(list_filter({D.words(x)}, lambda w: regexp_matches(w, '[A-Za-z]')))"
two("txt17_half_translated", lambda a, b: X.half_translated(b), f"len(list_filter(string_split(target, chr(10)), lambda x: {_aw('x')} > 30 AND {_aw('x')} > 3 * {D.count('x', '[一-鿿㐀-䶿豈-﫿]')})) > 0")
two("txt18_near_passthrough", X.near_passthrough, None)
one("txt19_english_prose", X.english_prose, f"strlen({D.trim('t')}) >= 160 AND {D.count('t', '[A-Za-z]')} >= 120 AND {D.count('t', '[A-Za-z]')} > 4 * {D.count('t', '[一-鿿]')}")
_pub, _yr = D.has(D.low("t"), *X.PUBLICATION), D.has(D.low("t"), "(19", "(20", " 19", " 20", "(forthcoming)", "(in press)")
_pos = lambda s: f"CASE WHEN strpos(substr({D.ltrim('t')}, 1, 96), '{s}') = 0 THEN 1000000 ELSE strpos(substr({D.ltrim('t')}, 1, 96), '{s}') - 1 END"
_refline = f"CASE WHEN strlen(t) < 24 THEN false WHEN regexp_matches(t, '^\\s*(?:\\[[0-9]+\\]|[0-9]+[.)] )') THEN {_yr} OR {_pub} ELSE {_pos(',')} <= 40 AND (CASE WHEN strpos(substr({D.ltrim('t')}, 1, 96), '(19') > 0 THEN strpos(substr({D.ltrim('t')}, 1, 96), '(19') - 1 ELSE {_pos('(20')} END) <= 72 AND {_pos('.')} <= 90 AND {_yr} AND contains(t, ', ') AND contains(t, '.') AND {_pub} END"
one("txt20_reference_line", X.is_reference_line, _refline)
one("txt21_reference_chunk", X.is_reference_chunk, None)
_label = D.low(f"regexp_replace({D.trim(f"regexp_replace({D.trim('t')}, '^#+', '')")}, ':+$', '')")
one("txt22_reference_heading", X.is_reference_heading, D.isin(_label, X.REFERENCE_HEADINGS))
one("txt23_back_matter", X.is_back_matter, D.isin(_label, X.BACK_MATTER))
_img = f"list_filter(list_transform({D.lines('t')}, lambda x: {D.trim('x')}), lambda x: x <> '')"
one("txt25_image_chunk", X.is_image_chunk, f"len({_img}) > 0 AND len(list_filter({_img}, lambda x: NOT (starts_with(x, '![') AND contains(x, '](') AND ends_with(x, ')')))) = 0")


@query("txt26_academic", f"SELECT doc_id, {D.has(D.low("text"), *X.ACADEMIC)} AS academic FROM documents")
def txt26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.is_academic(F.col("text")).alias("academic"))


_policy = f"CASE WHEN {D.low(D.trim('t'))} = 'academic' THEN 'Academic' WHEN {D.isin(D.low(D.trim('t')), ['business', 'legal', 'tech_doc', 'textbook', 'nonfiction'])} THEN 'Specialized' ELSE 'Narrative' END"
_types = ["academic", " Business", "LEGAL", "tech_doc", "textbook", "nonfiction", "novel", ""]


def typed(name: str, f: Callable[[Column], Column], sql: str) -> None:
    """A function of an article type: event types and the known ones."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = spark.createDataFrame([(t,) for t in _types], "t string")
        return table(spark, sf_dir, "events").select(F.col("event_type").alias("t")).distinct().union(own).select("t", f(F.col("t")).alias("out"))

    query(name, f"WITH s AS (SELECT DISTINCT event_type AS t FROM events UNION ALL SELECT * FROM (VALUES {', '.join(f"({D.lit(t)})" for t in _types)}) v(t)) SELECT t, {sql} AS out FROM s")(run)


typed("txt27_article_policy", X.article_policy, _policy)
typed("txt28_accepts_persons", X.accepts_persons, f"{_policy} = 'Narrative' OR {D.isin(D.low(D.trim('t')), ['business', 'nonfiction'])}")
one("txt29_heading_key", X.heading_key, f"lower({D.collapse('t')})")
_num = f"regexp_replace(lower({D.collapse('t')}), '^[0-9.)(\\-:\\s]+', '')"
one("txt30_numberless_key", X.numberless_key, f"CASE WHEN {_num} = '' THEN lower({D.collapse('t')}) ELSE {_num} END")
HAN_NUMERALS = ["十", "二十一", "一百零五", "三千二百", "两千", "九九", "〇", "一二三", "百", "四十x", "", "千零一", "第十"]


def literal(name: str, rows: list, kind: str, f: Callable[[Column], Column], sql: str | None) -> None:
    """A function of literal rows, for values that the driver's tables lack."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(r,) for r in rows], f"t {kind}").select("t", f(F.col("t")).alias("out"))

    from .standins import values_sql

    query(name, None if sql is None else f"SELECT t, {sql} AS out FROM {values_sql([(r,) for r in rows], 't')}")(run)


literal("txt31_chinese_value", HAN_NUMERALS, "string", X.chinese_value, None)
LONG_NUMERALS = [0, 1, 10, 11, 19, 20, 101, 110, 111, 999, 1000, 1001, 1010, 1100, 2345, 9999, 10000]
literal("txt32_chinese_numeral_long", LONG_NUMERALS, "long", X.chinese_numeral_long, None)
_d = lambda e: f"substr('{X.HAN_DIGITS}', CAST({e} AS BIGINT) + 1, 1)"
literal("txt33_chinese_numeral", list(range(0, 120, 3)), "long", X.chinese_numeral, f"CASE WHEN t < 10 THEN {_d('t')} WHEN t = 10 THEN '十' WHEN t < 20 THEN '十' || {_d('t % 10')} WHEN t < 100 THEN {_d('t // 10')} || '十' || CASE WHEN t % 10 = 0 THEN '' ELSE {_d('t % 10')} END ELSE CAST(t AS VARCHAR) END")
_words = f"list_position({[*X.NUMBER_WORDS]}, {D.low('t')})"
one("txt34_english_number", long(X.english_number), f"coalesce(list_position({[*X.NUMBER_WORDS]}, {D.low('t')}), list_position({[*X.ROMAN]}, {D.low('t')}), CASE WHEN regexp_full_match(t, '\\+?[0-9]{{1,9}}') THEN TRY_CAST(t AS BIGINT) END)")
_q = f"(length(target) - length(replace(target, '“', '')) = length(target) - length(replace(target, '”', '')) + 1 AND NOT ends_with({D.rtrim('target')}, '”') AND regexp_matches({D.rtrim('source')}, '[\"”]$'))"
two("txt37_repair_quote", lambda a, b: X.repair_quote(a, b)["text"], f"CASE WHEN {_q} THEN {D.rtrim('target')} || '”' ELSE target END")
one("txt38_compact", lambda c: X.compact(c, 40), f"substr({D.collapse('t')}, 1, 40)")
two("txt40_untranslated_token", lambda a, b: X.untranslated_token(a, b, F.lit(False)), f"len(list_filter(list_filter(regexp_split_to_array({D.low('source')}, '[^a-z]+'), lambda t: length(t) >= 4), lambda t: list_contains(regexp_split_to_array({D.low('target')}, '[^a-z]+'), t))) > 0")
_a, _b = "source", "target"
two("txt41_levenshtein", long(F.levenshtein), None)
two("txt42_similarity", lambda a, b: F.round(X.similarity(a, b).cast("double"), 5), None)
two("txt44_common_prefix", lambda a, b: F.round(X.common_prefix_ratio(a, b).cast("double"), 5), f"CASE WHEN greatest(length({_a}), length({_b})) = 0 THEN 1.0 ELSE round(CAST(CAST(len(list_filter(generate_series(1, least(length({_a}), length({_b}))), lambda i: substr({_a}, 1, CAST(i AS BIGINT)) = substr({_b}, 1, CAST(i AS BIGINT)))) / greatest(length({_a}), length({_b})) AS FLOAT) AS DOUBLE), 5) END")
_phr = lambda w: f"list_contains(string_split(regexp_replace(t, '[^A-Za-z0-9_-]+', ' ', 'g'), ' '), '{w}')"
one("txt47_mentions", lambda c: X.mentions(c, F.lit("the")), _phr("the"))
one("txt48_canonical_phrase", X.canonical_phrase, f"regexp_replace(regexp_replace({D.collapse('t')}, '^(?:(?:{'|'.join(X.LEADING_NOISE)}) )+', ''), '(?: (?:[\\x00-\\x7F]|{'|'.join(X.TRAILING_NOISE)}))+$', '')")
one("txt49_noise_phrase", X.is_noise_phrase, f"strlen(t) < 3 OR strlen(t) > 64 OR {D.isin('t', X.NOISE_WORDS)} OR (len({D.words('t')}) >= 2 AND len(list_filter(list_transform({D.words('t')}, lambda w: regexp_replace(w, '^[^A-Za-z]+|[^A-Za-z]+$', '', 'g')), lambda w: w <> '' AND NOT {D.isin('w', X.NOISE_WORDS)})) = 0) OR regexp_full_match(t, '[A-Z]*')")


@query("txt50_keep_proper_noun", f"WITH {TOKENS_SQL} SELECT word, count(*) AS n, CASE WHEN contains(word, ' ') THEN count(*) >= 1 ELSE count(*) >= 2 AND strlen(word) >= 6 END AS keep FROM tok WHERE regexp_matches(word, '^[A-Z]') GROUP BY word")
def txt50(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens(spark, sf_dir).filter(F.regexp_like("word", F.lit("^[A-Z]"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("keep", X.keep_proper_noun(F.col("word"), F.col("n"), F.lit(0), F.lit(False)))


one("txt52_mask_links", X.mask_links, None)
one("txt53_multi_column", X.is_multi_column, f"len(list_filter(list_transform(regexp_split_to_array(t, '\\s{{2,}}'), lambda x: {D.trim('x')}), lambda x: x <> '')) >= 3 AND len(list_filter(list_filter(list_transform(regexp_split_to_array(t, '\\s{{2,}}'), lambda x: {D.trim('x')}), lambda x: x <> ''), lambda x: len({D.words('x')}) > 6)) = 0")
_s = D.trim("t")
one("txt54_strict_role", lambda c: X.strict_role(c)["role"], f"CASE WHEN starts_with({_s}, 'The Tale of ') THEN 'book_title' WHEN regexp_matches({_s}, '^(?:Queen|King|Prince|Princess|Lord|Lady) ') THEN 'person_name' WHEN regexp_matches({_s}, '^(?:Temple of|Church of|University of) ') THEN 'organization_name' WHEN contains({_s}, ' of ') THEN 'other' WHEN len({D.words('t')}) >= 2 THEN 'person_name' ELSE 'place_name' END")


@query("txt57_ignored_residual", f"WITH {TOKENS_SQL} SELECT DISTINCT word, {D.isin(D.low('word'), X.RESIDUAL_STOPWORDS)} OR regexp_full_match(word, '[A-Z]+') OR regexp_full_match(word, '[A-Z][a-z]+') AS ignored FROM tok")
def txt57(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).select("word").distinct().withColumn("ignored", X.ignored_residual(F.col("word"), F.lit(True)))


_at = f"strpos({D.low('t')}, 'the')"
one("txt58_excerpt", lambda c: X.excerpt_around(c, F.lit("the")), f"CASE WHEN {_at} = 0 THEN substr(t, 1, 160) ELSE {D.trim(f'substr(t, greatest({_at} - 33, 0) + 1, {_at} - 1 + 96 - greatest({_at} - 33, 0))')} END")
one("txt60_replace_term", lambda c: X.replace_term(c, F.lit("the"), F.lit("DER")), None)
two("txt63_marker_report", lambda a, b: F.array_join(F.array_except(G.marker_numbers(a), G.marker_numbers(b)).cast("array<string>"), ","), "array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(source, '\\[\\[B([0-9]{1,6})\\]\\]', 1), lambda x: CAST(x AS INT)), lambda x: NOT list_contains(list_transform(regexp_extract_all(target, '\\[\\[B([0-9]{1,6})\\]\\]', 1), lambda y: CAST(y AS INT)), x)))), ',')")
_hl = lambda x: f"len(list_filter({D.lines(x)}, lambda y: regexp_matches(y, '^\\s*#{{1,6}} ') AND NOT regexp_full_match(y, '\\s*#{{1,6}}\\s*')))"
two("txt64_heading_loss", lambda a, b: F.size(G.headings(b)) < F.size(G.headings(a)), f"{_hl('target')} < {_hl('source')}")


@query("txt66_metric", "SELECT event_id, coalesce(TRY_CAST(nullif(regexp_extract('type=' || event_type || '; k=' || json_extract_string(props, '$.k') || ' ms', '(?:^|;)\\s*k\\s*=\\s*([0-9]*)', 1), '') AS BIGINT), 0) AS k FROM events")
def txt66(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.lit("type="), "event_type", F.lit("; k="), F.get_json_object("props", "$.k"), F.lit(" ms"))
    return table(spark, sf_dir, "events").select("event_id", X.metric(message, "k").alias("k"))


one("txt68_structured_text", X.structured_text, None)
one("txt88_salvage", X.structured_text, None)
_ex = ["d:ran/p:run/i:running/3:runs/x:no", "s:boxes/0:box", "", "d:/r:bigger", "r:big/t:biggest", None]
literal("txt69_exchange", _ex, "string", lambda c: F.array_join(F.transform(X.decode_exchange(c, F.lit("run")), lambda x: F.concat_ws("=", x["code"], x["value"])), ","), "coalesce(array_to_string(list_filter(list_transform(string_split(t, '/'), lambda p: CASE WHEN list_contains(['d','p','i','3','s','r','t'], split_part(p, ':', 1)) AND trim(regexp_replace(p, '^[^:]*:?', '')) NOT IN ('', 'run') THEN split_part(p, ':', 1) || '=' || trim(regexp_replace(p, '^[^:]*:?', '')) END), lambda x: x IS NOT NULL), ','), '')")
literal("txt70_tag_labels", ["zk gk", "cet4 cet6 ky", "gre sat unknown", "", None, " toefl  ielts "], "string", joined(X.tag_labels), f"coalesce(array_to_string(list_transform({D.words("coalesce(t, '')")}, lambda x: coalesce(map_extract_value(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in X.TAG_LABELS.items())}}}, x), x)), '|'), '')")


@query("txt71_frequency", "SELECT o_orderkey, concat_ws(' · ', CASE WHEN o_orderkey > 0 THEN 'BNC #' || format('{:,}', o_orderkey) END, CASE WHEN o_custkey > 0 THEN 'COCA #' || format('{:,}', o_custkey) END) AS text FROM orders")
def txt71(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", X.frequency_text(F.col("o_orderkey"), F.col("o_custkey")).alias("text"))


def _lemma_sql(w: str) -> str:
    """The lemma rules for DuckDB: one list a rule, in their order."""
    end = lambda s: f"ends_with({w}, '{s}')"
    c = lambda n, s="": f"substr({w}, 1, length({w}) - {n})" + (f" || '{s}'" if s else "")
    rules = [(f"{end("''s")} OR {end('’s')}", [c(2)]), (end("es"), [c(2), c(2, "e")]), (end("ies"), [c(3, "y")]), (end("ves"), [c(3, "fe"), c(3, "f")]), (end("s"), [c(1), c(1, "e")]), (end("ing"), [c(3), c(3), c(3, "e")])]
    dbl = lambda n, k=0: f"length({w}) - {n} >= 3 AND substr({w}, length({w}) - {n}, 1) = substr({w}, length({w}) - {n} - 1, 1) AND NOT list_contains(['a','e','i','o','u'], substr({w}, length({w}) - {n}, 1))"
    rules += [(f"{end('ing')} AND {dbl(3)}", [c(4)]), (f"{end('ing')} AND {dbl(3)} AND {end('lling')}", [c(3)]), (end("ied"), [c(3, "y")]), (end("ed"), [c(2), c(2), c(2, "e")]), (f"{end('ed')} AND {dbl(2)}", [c(3)]), (end("iest"), [c(4, "y")])]
    rules += [(f"{end('er')} OR {end('est')}", [c(2)]), (end("er"), [c(2), c(2, "e")]), (end("est"), [c(3), c(3), c(3, "e")]), (f"{end('er')} AND {dbl(2)}", [c(3)]), (f"NOT {end('er')} AND {end('est')} AND {dbl(3)}", [c(4)])]
    return f"CASE WHEN length({w}) < 4 THEN [] ELSE list_filter(flatten([{', '.join(f"CASE WHEN {k} THEN [{', '.join(v)}] ELSE [] END" for k, v in rules)}]), lambda x: strlen(x) >= 2 AND x <> {w}) END"


LEMMA_SQL = _lemma_sql


@query("txt73_lemmas", f"WITH {TOKENS_SQL}, v AS (SELECT DISTINCT {D.low('word')} AS word FROM tok) SELECT word, array_to_string({_lemma_sql('word')}, '|') AS lemmas FROM v")
def txt73(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokens(spark, sf_dir).select(X.ascii_lower(F.col("word")).alias("word")).distinct()
    return words.select("word", F.array_join(X.lemma_candidates(F.col("word")), "|").alias("lemmas"))


literal("txt74_user_level", [*X.LEVEL_LABELS, " cet4 ", "none", ""], "string", long(X.user_level), f"map_extract_value(MAP {{{', '.join(f"'{k}': {v}" for k, v in X.LEVEL_LABELS.items())}}}, trim(t))")
_w = "regexp_extract(' ' || translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || ' ', '(^(?:.|\\n)*?[^a-z])the[^a-z]', 1)"
_wi = f"CASE WHEN regexp_matches(' ' || {D.low('t')} || ' ', '[^a-z]the[^a-z]') THEN length({_w}) - 1 ELSE -1 END"
one("txt75_context", lambda c: X.context_around(c, F.lit("the")), f"CASE WHEN {D.trim('t')} = '' THEN '' WHEN {_wi} < 0 THEN substr(t, 1, 240) ELSE {D.trim(f'substr(t, greatest({_wi} - 60, 0) + 1, {_wi} + 183 - greatest({_wi} - 60, 0))')} END")
_h = f"(strpos({D.low('t')}, 'and') - 1)"
_hs, _he = f"greatest({_h} - 81, 0)", f"least({_h} + 123, length(t))"
one("txt77_snippet", lambda c: X.search_snippet(c, F.lit("and")), f"CASE WHEN {_h} >= 0 THEN CASE WHEN {_hs} > 0 THEN '…' ELSE '' END || {D.collapse(f'substr(t, {_hs} + 1, {_he} - {_hs})')} || CASE WHEN {_he} < length(t) THEN '…' ELSE '' END END")
one("txt82_style_lint", X.lint_style_rule, f"NOT ({D.has('t', '\"', '“', '”', "'")} OR {D.has(D.low('t'), 'such as', 'e.g.', 'for example', 'words like', 'use words')} OR contains(t, '词汇'))")
one("txt84_replace_once", lambda c: X.replace_once(c, F.lit("the"), F.lit("DER")), "CASE WHEN strpos(t, 'the') > 0 THEN substr(t, 1, strpos(t, 'the') - 1) || 'DER' || substr(t, strpos(t, 'the') + 3) END")
two("txt85_toc_colon", X.toc_colon, None)
_nk = D.low(D.collapse("t"))
one("txt86_semantic_heading", X.semantic_heading, f"CASE WHEN {_nk} IN ('abstract', '摘要', '摘 要') THEN 'abstract' WHEN {_nk} IN ('keywords', '关键字', '关键词') THEN 'keywords' WHEN {_nk} IN ('references', '参考文献') THEN 'references' WHEN {_nk} IN ('acknowledgments', 'acknowledgements', '致谢') THEN 'acknowledgments' ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_nk}, '^(?:abstract )+', ''), '^(?:keywords )+', ''), '^(?:acknowledgments )+', ''), '^(?:acknowledgements )+', ''), '^(?:references )+', '') END")
_ds = f"replace({D.low(D.trim('t'))}, ' ', '')"
one("txt87_docx_level", long(X.docx_heading_level), f"coalesce(TRY_CAST(nullif(regexp_extract({_ds}, '^heading([1-6])(?:char)?$', 1), '') AS BIGINT), TRY_CAST(nullif(regexp_extract({_ds}, '^标题([1-6])$', 1), '') AS BIGINT), CASE WHEN {_ds} IN ('title', '标题') THEN 1 WHEN {_ds} IN ('subtitle', '副标题') THEN 2 END)")
TAGS = [("nav", 'epub:type="toc"'), ("nav", 'class="menu"'), ("footer", ""), ("div", 'class="sharedaddy x"'), ("div", "id='post-nav'"), ("p", "hidden"), ("p", 'class="text"'), ("div", 'style="display:none"')]


@query("txt90_boilerplate")
def txt90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(TAGS, "name string, attrs string").withColumn("boilerplate", X.is_boilerplate(F.col("name"), F.col("attrs")))


@query("txt80_epub_path", "SELECT page_id, regexp_replace(regexp_replace('OEBPS/text/' || split_part('../img/' || page_id || '.png#x', '#', 1), '[^/]+/\\.\\./', ''), '//+', '/', 'g') AS path FROM pages")
def txt80(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.epub_path(F.lit("OEBPS/text"), F.concat(F.lit("../img/"), "page_id", F.lit(".png#x"))).alias("path"))


# --- segmentation
docs = lambda spark, sf_dir: table(spark, sf_dir, "documents")


def over_docs(name: str, f: Callable[[Column], Column], sql: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return docs(spark, sf_dir).select("doc_id", f(F.coalesce("text", F.lit(""))).alias("out"))

    query(name, None if sql is None else f"SELECT doc_id, {sql} AS out FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")(run)


over_docs("chk01_pack_lines", lambda c: F.array_join(F.transform(G.pack_lines(c, 3000), lambda x: F.octet_length(x).cast("string")), ","), "array_to_string(list_transform(list_filter(list_reduce(list_transform(string_split(regexp_replace(t, chr(10) || '$', ''), chr(10)), lambda x: {'done': CAST([] AS BIGINT[]), 'now': strlen(x) + 1}), lambda a, x: CASE WHEN a.now + x.now - 1 > 3000 THEN {'done': list_append(a.done, a.now), 'now': x.now} ELSE {'done': a.done, 'now': a.now + x.now} END).done || [list_reduce(list_transform(string_split(regexp_replace(t, chr(10) || '$', ''), chr(10)), lambda x: {'done': CAST([] AS BIGINT[]), 'now': strlen(x) + 1}), lambda a, x: CASE WHEN a.now + x.now - 1 > 3000 THEN {'done': list_append(a.done, a.now), 'now': x.now} ELSE {'done': a.done, 'now': a.now + x.now} END).now], lambda x: t <> ''), lambda x: CAST(x AS VARCHAR)), ',')")
two("chk04_reference_start", lambda a, b: G.reference_start(F.concat(a, F.lit("\n# References\n"), b)).cast("long"), "strlen(source) + 1")
two("chk05_reference_tail", lambda a, b: G.reference_tail(F.concat(F.lit("References\n"), a, F.lit("\n# Tail\n"), b))["tail"], None)
two("chk06_blocks", lambda a, b: F.array_join(G.blocks(F.concat(a, F.lit("\n\n"), b)), "|"), f"array_to_string(list_filter(list_transform(string_split(source || chr(10) || chr(10) || target, chr(10) || chr(10)), lambda x: {D.trim('x')}), lambda x: x <> ''), '|')")
over_docs("chk08_sentences", lambda c: F.size(G.sentences(c)).cast("long"), f"len(list_filter(list_transform(regexp_extract_all(t, '[^.!?。！？\\n]*[.!?。！？\\n]|[^.!?。！？\\n]+'), lambda x: {D.trim('x')}), lambda x: x <> ''))")
two("chk09_marked_blocks", lambda a, b: F.array_join(G.marked_blocks(b), "|"), None)
over_docs("chk10_english_words", lambda c: F.array_join(G.english_words(c), "|"), "array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(t, '[^A-Za-z''-]+'), lambda w: length(w) >= 3), lambda w: trim(w, '''-')), lambda w: w <> ''), '|')")
over_docs("chk11_ascii_tokens", lambda c: F.size(G.ascii_tokens(c)).cast("long"), "len(regexp_extract_all(t, '[A-Za-z]{2,}'))")
one("chk12_capital_phrases", joined(G.capital_phrases), None)
one("chk13_han_runs", joined(G.han_runs), "array_to_string(regexp_extract_all(t, '[一-鿿]+'), '|')")
one("chk14_first_names", joined(G.first_names), None)
two("chk16_markers", lambda a, b: G.with_markers(G.blocks(F.concat(a, F.lit("\n\n"), b))), "array_to_string(list_transform(list_zip(bs, generate_series(0, len(bs) - 1)), lambda x: '[[B' || lpad(CAST(x[2] AS VARCHAR), 3, '0') || ']]' || chr(10) || x[1]), chr(10) || chr(10))".replace("bs", f"list_filter(list_transform(string_split(source || chr(10) || chr(10) || target, chr(10) || chr(10)), lambda y: {D.trim('y')}), lambda y: y <> '')"))
two("chk17_by_markers", lambda a, b: F.array_join(G.by_markers(b), "|"), f"array_to_string(list_transform(regexp_split_to_array(target, '\\[\\[B[0-9]{{1,6}}\\]\\]')[2:], lambda x: {D.trim('x')}), '|')")
two("chk18_retry_slice", lambda a, b: F.array_join(G.retry_slice(G.sentences(a), F.lit(4)), "|"), None)
one("chk19_numbers", joined(X.numbers), None)
one("chk20_headings", lambda c: F.array_join(F.transform(G.headings(c), lambda h: F.concat_ws(":", h["level"], h["title"])), "|"), f"CASE WHEN regexp_matches(t, '^\\s*#{{1,6}} ') AND {D.trim("regexp_replace(regexp_replace(trim(t), '^#{1,6} ', ''), '#+$', '')")} <> '' THEN length(regexp_extract(trim(t), '^(#{{1,6}}) ', 1)) || ':' || {D.trim("regexp_replace(regexp_replace(trim(t), '^#{1,6} ', ''), '#+$', '')")} ELSE '' END")
one("chk21_distinctive", joined(G.distinctive_tokens), "array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(t, '[^A-Za-z0-9.''-]+'), lambda x: " + D.low("regexp_replace(x, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')") + "), lambda x: length(x) >= 4 AND regexp_matches(x, '[a-z]')))), '|')")
two("chk23_paragraphs", lambda a, b: F.array_join(G.paragraphs(F.concat(a, F.lit("\n  \n"), b)), "|"), None)
