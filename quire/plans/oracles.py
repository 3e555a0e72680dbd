"""SQL of queries whose rule takes more than one expression, restated over the same rows.

Everything here is DuckDB SQL; names stand for pieces of it. ``snippet`` and ``pair`` make the SQL of a function of
one text ``t`` and of a ``source`` and its ``target``.
"""

from __future__ import annotations

from quire.functions import text as X
from quire.registry import oracle

from . import duck as D
from .standins import CHUNKS_SQL, LOG_SQL, PAIRS_SQL, REVIEWS_SQL, SNIPPETS_SQL, quote, values_sql
from .text_queries import HAN_NUMERALS, LONG_NUMERALS, TAGS, key_sql, kind_sql

HAN_DIGITS = "零一二三四五六七八九"
HAN_NUMERAL = "[0-9〇零一二两三四五六七八九十百千]+"
SENTENCE = r"[^.!?。！？\n]*[.!?。！？\n]|[^.!?。！？\n]+"
BREAK = "chr(10) || chr(10)"


def snippet(name: str, out: str, *steps: str, rows: str = "s") -> None:
    oracle(name, f"WITH {', '.join([SNIPPETS_SQL, *steps])} SELECT id, n, {out} AS out FROM {rows}")


def pair(name: str, out: str, *steps: str, rows: str = "p", named: str = "out") -> None:
    oracle(name, f"WITH {', '.join([PAIRS_SQL, *steps])} SELECT task, idx, {out} AS {named} FROM {rows}")


def trimmed(parts: str) -> str:
    """The parts trimmed, without empty ones."""
    return f"list_filter(list_transform({parts}, lambda raw: {D.trim('raw')}), lambda part: part <> '')"


def blocks(x: str) -> str:
    return trimmed(f"string_split({x}, {BREAK})")


def sentences(x: str) -> str:
    return trimmed(f"regexp_extract_all({x}, '{SENTENCE}')")


def joined(parts: str, by: str = "'|'") -> str:
    return f"coalesce(array_to_string({parts}, {by}), '')"


def first_seen(parts: str) -> str:
    return f"list_filter({parts}, lambda e, i: list_position({parts}, e) = i)"


# --- references and back matter --------------------------------------------------------------------
def label(x: str) -> str:
    return D.low(f"regexp_replace({D.trim(f"regexp_replace({D.trim(x)}, '^#+', '')")}, ':+$', '')")


def numbered(x: str) -> str:
    return rf"regexp_matches({x}, '^\s*(?:\[[0-9]+\]|[0-9]+[.)] )')"


def reference_line(x: str) -> str:
    head = f"substr({D.ltrim(x)}, 1, 96)"
    place = lambda mark: f"CASE WHEN strpos({head}, '{mark}') = 0 THEN 1000000 ELSE strpos({head}, '{mark}') - 1 END"
    year = D.has(D.low(x), "(19", "(20", " 19", " 20", "(forthcoming)", "(in press)")
    publication = D.has(D.low(x), *X.PUBLICATION)
    return f"""CASE WHEN strlen({x}) < 24 THEN false
        WHEN {numbered(x)} THEN {year} OR {publication}
        ELSE {place(',')} <= 40 AND {place('.')} <= 90 AND {year} AND {publication} AND contains({x}, ', ') AND contains({x}, '.')
            AND (CASE WHEN strpos({head}, '(19') > 0 THEN strpos({head}, '(19') - 1 ELSE {place('(20')} END) <= 72 END"""


def english_words(x: str) -> str:
    return f"len(list_filter({D.words(x)}, lambda ew: regexp_matches(ew, '[A-Za-z]')))"


def reference_chunk(full: str) -> str:
    """Of the list of a chunk's full lines."""
    marks = " + ".join(f"CAST(contains(line, '{m}') AS INT)" for m in ".?!;:")
    prose = f"strlen(line) >= 120 AND NOT starts_with(line, '#') AND NOT ({reference_line('line')}) AND NOT {numbered('line')} AND {marks} >= 2 AND {english_words('line')} >= 20"
    return f"""(len(list_filter({full}[1:3], lambda line: {D.isin(label('line'), X.REFERENCE_HEADINGS)})) > 0
        OR coalesce({reference_line(f'{full}[1]')}, false) AND len(list_filter({full}, lambda line: {prose})) = 0)"""


skips = f"({reference_chunk('full_lines')} OR coalesce({D.isin(label('full_lines[1]'), X.BACK_MATTER)}, false))"
full = lambda x: f"{trimmed(D.lines(x))} AS full_lines"
snippet("txt21_reference_chunk", reference_chunk("full_lines"), f"f AS (SELECT *, {full('t')} FROM s)", rows="f")
pair("flt06_skips_review", skips, f"f AS (SELECT *, {full('source')} FROM p)", rows="f", named="skips")
oracle(
    "flt05_reviewable",
    f"""WITH {CHUNKS_SQL}, f AS (SELECT *, {full('source')} FROM chunks)
    SELECT task, idx FROM f WHERE kind = 'body' AND translated IS NOT NULL AND stage = 'termConsistencyApplied' AND NOT {skips}""",
)
_token = D.low("token")
oracle(
    "qa07_residual_issues",
    f"""WITH {CHUNKS_SQL}, f AS (SELECT *, {full('source')} FROM chunks),
    w AS (SELECT task, idx, list_transform(regexp_extract_all(source, '[A-Za-z]{{2,}}'), lambda w: {D.low('w')}) AS own, unnest(regexp_extract_all(translated, '[A-Za-z]{{2,}}')) AS token
        FROM f WHERE kind = 'body' AND NOT {skips})
    SELECT task, idx, count(DISTINCT {_token}) AS terms FROM w
    WHERE list_contains(own, {_token}) AND NOT ({D.isin(_token, X.RESIDUAL_STOPWORDS)} OR regexp_full_match(token, '[A-Z]+') OR regexp_full_match(token, '[A-Z][a-z]+'))
    GROUP BY ALL""",
)

# --- distances; levenshtein compares bytes, so other letters become control characters, row by row ---
CONTROLS = "||".join(f"chr({k})" for k in [*range(1, 9), 11, 12, *range(14, 32)])


def one_byte(x: str, both: str) -> str:
    wide = f"array_to_string(list_sort(list_distinct(regexp_extract_all({both}, '[^\\x00-\\x7F]'))), '')"
    return f"translate({x}, {wide}, substr({CONTROLS}, 1, length({wide})))"


def distance(a: str, b: str) -> str:
    return f"levenshtein({one_byte(a, f'{a} || {b}')}, {one_byte(b, f'{a} || {b}')})"


def similarity(a: str, b: str, steps: str | None = None) -> str:
    longest = f"greatest(length({a}), length({b}))"
    return f"CAST(CASE WHEN {longest} = 0 THEN 1 ELSE 1 - {steps or distance(a, b)} / {longest} END AS FLOAT)"


pair("txt41_levenshtein", distance("source", "target"))
pair("txt42_similarity", f"round(CAST({similarity('source', 'target')} AS DOUBLE), 5)")
_letters = lambda x, cls: D.low(f"regexp_replace({x}, '[^{cls}]', '', 'g')")
_passes = f"l AS (SELECT *, {_letters('source', 'A-Za-z')} AS a, {_letters('target', 'A-Za-z')} AS b FROM p)"
_middle = "least(40, length(a) - length(a) // 2, length(b) - length(b) // 2)"
_near = f"""CASE WHEN length(a) < 80 OR length(b) < 80 THEN false WHEN a = b THEN true
    WHEN CAST(abs(length(a) - length(b)) / greatest(length(a), length(b)) AS FLOAT) > CAST(0.06 AS FLOAT) THEN false
    WHEN left(a, 80) <> left(b, 80) AND {_middle} > 0 AND substr(a, length(a) // 2 + 1, {_middle}) <> substr(b, length(b) // 2 + 1, {_middle}) THEN false
    ELSE {similarity('a', 'b', 'levenshtein(a, b)')} >= CAST(0.94 AS FLOAT) END"""
pair("txt18_near_passthrough", _near, _passes, rows="l")
_prose = f"strlen({D.trim('target')}) >= 160 AND {D.count('target', '[A-Za-z]')} >= 120 AND {D.count('target', '[A-Za-z]')} > 4 * {D.count('target', '[一-鿿]')}"
pair("qa10_passthrough", f"({_near}) AND {_prose}", _passes, rows="l", named="rejected")
_same = lambda a, b: f"coalesce(list_min(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, i, 1) <> substr({b}, i, 1))) - 1, least(length({a}), length({b})))"
_ideographs = "[一-鿿㐀-䶿豈-﫿]"
_half = f"len(list_filter(string_split(target, chr(10)), lambda x: {english_words('x')} > 30 AND {english_words('x')} > 3 * {D.count('x', _ideographs)})) > 0"
pair(
    "txt16_untranslated_body",
    f"""CASE WHEN regexp_matches(target, '{_ideographs}') THEN {_half}
    WHEN {english_words('source')} < 8 OR length(source) < 48 OR a = '' OR b = '' THEN false WHEN a = b THEN true
    ELSE {_same('a', 'b')} + {_same('reverse(a)', 'reverse(b)')} >= floor(least(length(a), length(b)) * 9 / 10) END""",
    f"l AS (SELECT *, {_letters('source', 'A-Za-z0-9')} AS a, {_letters('target', 'A-Za-z0-9')} AS b FROM p)",
    rows="l",
)

# --- numbers: word runs are marked, so that a boundary is a mark, of all letters and not of ASCII alone
_marked = lambda x: rf"regexp_replace({x}, '([\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]+)', chr(1) || chr(1) || '\1' || chr(2), 'g')"
_bare = lambda x: f"replace(replace({x}, chr(1), ''), chr(2), '')"


def numbers(x: str) -> str:
    found = rf"regexp_extract_all({_marked(x)}, '\x01\p{{Nd}}+\x02(?:\.\x01\x01\p{{Nd}}+\x02)?(?:%\x01)?')"
    year = "regexp_full_match(num, '[0-9]{1,9}%*') AND coalesce(TRY_CAST(rtrim(num, '%') AS BIGINT) BETWEEN 1900 AND 2099, false)"
    return f"list_filter(list_transform({found}, lambda hit: {_bare('hit')}), lambda num: length(num) > 1 AND NOT ({year}))"


snippet("chk19_numbers", joined(numbers("t")))
_numbers = f"v AS (SELECT *, {numbers('source')} AS wanted, {numbers('target')} AS found FROM p)"
_missing = "list_filter(wanted, lambda w: NOT list_contains(found, w))"
pair("qa04_numbers", joined(_missing, "','"), _numbers, rows="v", named="missing")
_half_heading = r"(?m)^\s*(?:(?:Book|Volume|Part|Section)\s+\w+[,:：]?\s+)?Chapter\s+(\d+)\s*[:：]\s*[^\n]*[一-鿿]"
oracle(
    "qa02_drift",
    f"""WITH {PAIRS_SQL}, {_numbers}
    SELECT task, idx, 'QUOTE_IMBALANCE' AS code FROM p WHERE length(replace(target, '“', '')) <> length(replace(target, '”', ''))
    UNION ALL SELECT task, idx, 'HEADING_BILINGUAL_RESIDUE' FROM p WHERE regexp_matches(target, '{_half_heading}')
    UNION ALL SELECT task, idx, 'NUMBER_CONSERVATION' FROM v WHERE len({_missing}) > 0""",
)


# --- Chinese numerals and chapter titles -----------------------------------------------------------
def han_value(x: str) -> str:
    """The number a Chinese numeral names; null for anything else."""
    start = "{'ch': '', 'total': CAST(0 AS BIGINT), 'now': CAST(0 AS BIGINT)}"
    chars = f"list_transform(range(1, length({x}) + 1), lambda i: {{'ch': substr({x}, i, 1), 'total': CAST(0 AS BIGINT), 'now': CAST(0 AS BIGINT)}})"
    unit = "CASE e.ch WHEN '十' THEN 10 WHEN '百' THEN 100 WHEN '千' THEN 1000 END"
    digit = f"CASE WHEN e.ch IN ('〇', '零') THEN 0 WHEN e.ch = '两' THEN 2 ELSE strpos('{HAN_DIGITS}', e.ch) - 1 END"
    fold = f"""list_reduce(list_prepend({start}, {chars}), lambda a, e: CASE WHEN e.ch IN ('十', '百', '千')
        THEN {{'ch': '', 'total': a.total + greatest(a.now, 1) * {unit}, 'now': CAST(0 AS BIGINT)}}
        ELSE {{'ch': '', 'total': a.total, 'now': CAST(a.now * 10 + {digit} AS BIGINT)}} END)"""
    return f"CASE WHEN regexp_full_match({x}, '[〇零一二两三四五六七八九十百千]{{1,12}}') THEN {fold}.total + {fold}.now END"


def han_numeral(n: str) -> str:
    """1 to 9999 in Chinese: digits with units, runs of zeros as one filler, no leading one of ten."""
    full = " || ".join(f"'{unit}' || substr('{HAN_DIGITS}', {n} // {size} % 10 + 1, 1) || '{name}'" for unit, size, name in (("", 1000, "千"), ("", 100, "百"), ("", 10, "十"), ("", 1, "")))
    steps = [("零[千百十]", "零"), ("零+", "零"), ("^零|零$", ""), ("^一十", "十")]
    for pattern, by in steps:
        full = f"regexp_replace({full}, '{pattern}', '{by}', 'g')"
    return f"CASE WHEN {n} BETWEEN 1 AND 9999 THEN {full} END"


oracle("txt31_chinese_value", f"SELECT t, {han_value('t')} AS out FROM {values_sql([(x,) for x in HAN_NUMERALS], 't')}")
oracle("txt32_chinese_numeral_long", f"SELECT t, {han_numeral('t')} AS out FROM {values_sql([(x,) for x in LONG_NUMERALS], 't')}")
_chapter = rf"^第\s*{HAN_NUMERAL}\s*[章节篇部卷回]"
_wide = lambda x: rf"regexp_replace(replace({x}, ':', '：'), '：\s+', '：', 'g')"
_behind = lambda x: f"substr({x}, length(regexp_extract({x}, '{_chapter}')) + 1)"
_has_number = lambda x: f"regexp_matches({x}, '{_chapter}')"
_colon = f"""CASE WHEN contains(wide, '：') OR NOT {_has_number('wide')} OR {D.ltrim(_behind('wide'))} = '' THEN wide
    ELSE regexp_extract(wide, '{_chapter}') || '：' || {D.ltrim(_behind('wide'))} END"""
_plain = D.ltrim(f"regexp_replace({D.ltrim(_behind('title'))}, '^[：:]', '')")
_no_colon = f"""CASE WHEN NOT {_has_number('title')} OR NOT regexp_matches({_behind('title')}, '^\\s*[：:]') THEN title
    WHEN {_plain} = '' THEN {D.rtrim(f"regexp_extract(title, '{_chapter}')")} ELSE regexp_extract(title, '{_chapter}') || ' ' || {_plain} END"""
_styled = f"CASE WHEN regexp_matches(source, '[:：]') THEN {_colon} ELSE {_no_colon} END"
pair("txt85_toc_colon", _styled, f"w AS (SELECT task, idx, source, target AS title, {_wide('target')} AS wide FROM p)", rows="w")
_number = rf"regexp_extract(target, '^第\s*({HAN_NUMERAL})\s*[章节篇部卷回]', 1)"
_renumber = lambda value: rf"regexp_replace(target, '^(第\s*){HAN_NUMERAL}(\s*[章节篇部卷回])', '\1' || {value} || '\2')"
pair(
    "txt35_toc_title",
    _styled,
    f"""d AS (SELECT *, {_number} AS number FROM p),
    r AS (SELECT task, idx, source, CASE WHEN number = '' THEN target
        WHEN regexp_matches(source, '(?i)\\bchapter\\s+\\d|第\\s*\\d|^\\s*\\d+[.:\\s]') AND NOT regexp_full_match(number, '[0-9]+') AND {han_value('number')} IS NOT NULL
            THEN {_renumber(f"CAST({han_value('number')} AS VARCHAR)")}
        WHEN regexp_matches(source, '第\\s*[〇零一二两三四五六七八九十百千]') AND regexp_full_match(number, '[0-9]+') AND {han_numeral("TRY_CAST(number AS BIGINT)")} IS NOT NULL
            THEN {_renumber(han_numeral("TRY_CAST(number AS BIGINT)"))}
        ELSE target END AS title FROM d),
    w AS (SELECT *, {_wide('title')} AS wide FROM r)""",
    rows="w",
)

# --- replacements at boundaries; applied twice, since two neighbours share the sign between them ------
_sign = "[^A-Za-z0-9_-]"


def swapped(x: str, term: str, by: str) -> str:
    for _ in range(2):
        x = rf"regexp_replace({x}, '(^|{_sign}){term}($|{_sign})', '\1{by}\2', 'g')"
    return x


snippet("txt60_replace_term", swapped("t", "the", "DER"))
snippet("txt61_replace_terms", swapped(swapped("t", "the and", "X"), "the", "DER"))
snippet("txt62_replace_aliases", "replace(replace(t, 'onon', 'B'), 'on', 'AN')")
oracle("str04_late_patch", f"WITH {CHUNKS_SQL} SELECT task, count(*) FILTER (regexp_matches(translated, '(^|{_sign})the($|{_sign})')) AS patched FROM chunks WHERE translated IS NOT NULL GROUP BY task")
_links = r"regexp_extract_all(t, '\]\([^)]*\)?')"
snippet("txt52_mask_links", f"list_reduce(list_prepend(t, {_links}), lambda masked, link: replace(masked, link, ']' || repeat(' ', length(link) - 1)))")

# --- what is left of a source term ------------------------------------------------------------------
_longest = lambda x: f"coalesce({D.words(x)}[list_position(list_transform({D.words(x)}, lambda w: length(w)), list_max(list_transform({D.words(x)}, lambda w: length(w))))], '')"
_stands = "regexp_matches(target, '(^|[^A-Za-z0-9])' || regexp_escape(term) || '($|[^A-Za-z0-9])')"
_left = lambda wanted: f"CASE WHEN NOT contains(target, '{wanted}') AND length(term) >= 4 AND NOT regexp_matches(term, '[^\\x00-\\x7F]') AND {_stands} THEN term END"
_terms = f"x AS (SELECT *, {_longest('source')} AS term FROM p)"
pair("txt78_source_residual", _left("目标"), f"x AS (SELECT *, {D.trim('source')} AS term FROM p)", rows="x")
oracle("jn22_patch_residuals", f"WITH {PAIRS_SQL}, {_terms} SELECT task, idx, {_left('译')} AS residual FROM x WHERE residual IS NOT NULL")
_edge = lambda w: f"'(?i)(^|[^A-Za-z])' || {w} || '($|[^A-Za-z])'"
pair(
    "txt83_replace_residual",
    rf"""CASE WHEN term = '' THEN '目标' || regexp_replace(target, '(?s)(.)', '\1目标', 'g') WHEN contains(target, term) THEN replace(target, term, '目标')
    WHEN word IS NULL THEN target ELSE regexp_replace(target, {_edge('word')}, '\1目标\2') END""",
    _terms,
    f"y AS (SELECT *, list_filter(regexp_extract_all(lower(term), '[a-z]+'), lambda w: regexp_matches(target, {_edge('w')}))[1] AS word FROM x)",
    rows="y",
)

# --- JSON answers -----------------------------------------------------------------------------------
_whole = f"CASE WHEN json_valid({D.trim('t')}) THEN json_extract_string({D.trim('t')}, '$.translatedText') END"
_cut = r"""json_extract_string('{"t":"' || regexp_extract(t, '"translated(?:T|_t)ext"[^"]*"((?:[^"\\]|\\.)*)"', 1) || '"}', '$.t')"""
for _name in ("txt68_structured_text", "txt88_salvage"):
    snippet(_name, f"nullif({D.trim(f'coalesce({_whole}, {_cut})')}, '')")
_objects = "list_filter(list_transform(range(i, length(t) + 1), lambda j: substr(t, i, j - i + 1)), lambda o: ends_with(o, '}') AND json_valid(o))[1]"
snippet(
    "txt67_json_object",
    f"""CASE WHEN contains(t, '{{') THEN list_filter(list_transform(list_filter(range(1, length(t) + 1), lambda k: substr(t, k, 1) = '{{'), lambda i: {_objects}),
    lambda o: o IS NOT NULL AND regexp_matches(o, '"translated(?:Text|_text)"'))[1] END""",
)

# --- sentences, snippets, single functions ----------------------------------------------------------
_flat = D.collapse("t")
snippet(
    "txt76_sentence_context",
    f"CASE WHEN hit <> '' THEN CASE WHEN length({D.trim('found')}) <= 240 THEN {D.trim('found')} ELSE {D.trim('substr(flat, greatest(place - 118, 0) + 1, 240)')} END END",
    rf"h AS (SELECT *, {_flat} AS flat, regexp_extract(' ' || {_flat} || ' ', '(?is)^(.*?[^A-Za-z])the[^A-Za-z]', 1) AS hit FROM s)",
    "k AS (SELECT *, length(hit) - 1 AS place, regexp_extract(substr(flat, 1, length(hit) - 1), '[^.!?。！？]*$') AS before, substr(flat, length(hit) + 3) AS behind FROM h)",
    "c AS (SELECT *, before || substr(flat, place + 1, 3) || regexp_extract(behind, '^[^.!?。！？]*[.!?。！？]?') AS found FROM k)",
    rows="c",
)
snippet("txt24_protected_metadata", f"{D.trim('t')} <> '' AND {D.has('lower(t)', '@', 'department of ', 'university of ', 'corresponding author')} AND length(t) < 400")
_title = "lower(array_to_string(" + D.words("ltrim({}, '#')") + ", ' '))"
pair(
    "txt59_repeated_title",
    f"array_to_string(list_filter(parts, lambda b, i: place IS NULL OR i <= place OR i >= stop OR {_title.format('b')} <> {_title.format('parts[place]')}), {BREAK})",
    f"b AS (SELECT task, idx, {blocks(f"'# ' || source || {BREAK} || source || {BREAK} || target")} AS parts FROM p)",
    "f AS (SELECT *, list_filter(range(1, len(parts) + 1), lambda i: starts_with(parts[i], '# '))[1] AS place FROM b)",
    f"e AS (SELECT *, coalesce(list_filter(range(place + 1, len(parts) + 1), lambda i: length(parts[i]) > 80 AND {_title.format('parts[i]')} <> {_title.format('parts[place]')})[1], len(parts) + 1) AS stop FROM f)",
    rows="e",
)
_attr = "lower(attrs)"
_names = f"""flatten(list_transform(regexp_extract_all({_attr}, '(?:class|id)=(?:"[^"]*"|''[^'']*'')'), lambda v: regexp_split_to_array(regexp_replace(v, '^[a-z]+=|["'']', '', 'g'), '\\s+')))"""
oracle(
    "txt90_boilerplate",
    f"""SELECT name, attrs, CASE WHEN name IN ('footer', 'script', 'style') THEN true
    WHEN name = 'nav' THEN NOT {D.has('attrs', 'epub:type="toc', "epub:type='toc", 'landmarks', 'page-list', 'doc-toc')}
    WHEN {D.has(_attr, 'hidden', 'display:none', 'display: none')} THEN true
    ELSE list_has_any({_names}, [{', '.join(map(quote, X.FURNITURE))}]) END AS boilerplate FROM {values_sql(TAGS, 'name, attrs')}""",
)


def fnv(x: str) -> str:
    """FNV-1a of the UTF-8 bytes, 64 bits in hexadecimal."""
    code = lambda at: f"strpos('0123456789ABCDEF', substr(hex(encode({x})), {at}, 1)) - 1"
    octets = f"list_transform(range(0, strlen({x})), lambda i: CAST(16 * ({code('2 * i + 1')}) + {code('2 * i + 2')} AS UHUGEINT))"
    step = "(xor(h, o) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT"
    return f"lpad(lower(hex(CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, {octets}), lambda h, o: {step}) AS UBIGINT))), 16, '0')"


oracle("txt65_fnv1a", f"SELECT p_partkey, {fnv('p_name')} AS hash FROM part")
oracle("str19_cache_key", f"SELECT page_id, {fnv("url || chr(31) || 'contract-1'")} AS key FROM pages")
oracle("src02_texts", f"WITH t AS (SELECT string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS text FROM nation) SELECT text, {fnv('text')} AS hash FROM t")

_safe = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def inline(x: str) -> str:
    x = _safe(x)
    for pattern, by in (
        (r"!\[([^\]]*)\]\(([^)]*)\)", r'<img alt="\1" src="\2">'), (r"\[([^\]]*)\]\(([^)]*)\)", r'<a href="\2">\1</a>'),
        (r"\*\*([^*]+)\*\*", r"<strong>\1</strong>"), (r"\*([^*]+)\*", r"<em>\1</em>"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


snippet(  # of single lines
    "snk12_markdown_html",
    f"""CASE WHEN m = '' THEN '' WHEN regexp_matches(m, '^#{{1,6}} ') THEN '<h' || level || '>' || {inline("rtrim(substr(m, level + 2), '# ')")} || '</h' || level || '>'
    WHEN starts_with(m, '```') THEN '<pre><code></code></pre>' WHEN regexp_matches(m, '^[-*] ') THEN '<ul><li>' || {inline('substr(m, 3)')} || '</li></ul>'
    WHEN starts_with(m, '>') THEN '<blockquote>' || {inline("ltrim(m, '> ')")} || '</blockquote>' ELSE '<p>' || {inline('m')} || '</p>' END""",
    f"m AS (SELECT id, n, {D.trim('t')} AS m, length(regexp_extract({D.trim('t')}, '^#+')) AS level FROM s)",
    rows="m",
)
_text = "t || chr(10) || ' 12 ' || repeat(chr(10), 4) || 'end'"
_words = rf"regexp_replace({_text}, '([a-z])-\n([a-z])', '\1\2', 'g')"
_pages = rf"regexp_replace({_words}, '(?m)^\s*(?:\d{{1,4}}|[Pp]age \d{{1,4}}(?: of \d{{1,4}})?)\s*$', '', 'g')"
snippet("udf10_normalised", D.trim(rf"regexp_replace({_pages}, '\n\s*\n(?:\s*\n)+', {BREAK}, 'g')"))

# --- segmentation -----------------------------------------------------------------------------------
_rows = "string_split('References' || chr(10) || source || chr(10) || '# Tail' || chr(10) || target, chr(10))"
_other = f"starts_with({D.trim('l[i]')}, '#') AND NOT {D.isin(label('l[i]'), X.REFERENCE_HEADINGS)}"
pair(
    "chk05_reference_tail",
    joined("l[place:]", "chr(10)"),
    f"r AS (SELECT task, idx, {_rows} AS l FROM p)",
    f"a AS (SELECT *, list_filter(range(2, len(l) + 1), lambda i: {_other})[1] AS place FROM r)",
    rows="a",
)
_mark = r"\[\[B[0-9]{3}\]\]"
pair("chk09_marked_blocks", joined(f"CASE WHEN regexp_matches(target, '{_mark}') THEN {trimmed(f"regexp_split_to_array(target, '{_mark}')[2:]")} ELSE {blocks('target')} END"))
_spoken = "regexp_extract_all({}, '[A-Za-z][A-Za-z''’-]*')"
_capitals = lambda span: f"array_to_string(list_transform({_spoken.format(span)}, lambda w: CASE WHEN regexp_matches(w, '^[A-Z]') THEN w ELSE '' END), ' ')"


def phrases(x: str) -> str:
    each = f"list_filter(list_transform(regexp_split_to_array({_capitals('span')}, ' {{2,}}'), lambda f: {D.trim('f')}), lambda f: f <> '')"
    return rf"flatten(list_transform(regexp_split_to_array({x}, '[.!?;:,()\[\]{{}}]'), lambda span: {each}))"


snippet("chk12_capital_phrases", joined(phrases("t")))
_named = f"flatten(list_transform(phrases, lambda p: list_transform({D.words('p')}, lambda w: regexp_replace(w, '^[^A-Za-z]+|[^A-Za-z]+$', '', 'g'))))"
snippet(
    "chk14_first_names",
    joined(f"list_sort(list_distinct(list_filter({_named}, lambda w: strlen(w) >= 2 AND regexp_matches(w, '^[A-Z]') AND regexp_matches(w, '[^A-Z]'))))"),
    f"f AS (SELECT *, {phrases('t')} AS phrases FROM s)",
    rows="f",
)
_near_hint = " OR ".join(f"phrase <> '{h}' AND CAST({similarity('phrase', quote(h))} AS DOUBLE) >= 0.82" for h in ("Thent", "Andon"))
oracle("agg21_potential_variants", f"WITH {PAIRS_SQL}, f AS (SELECT task, unnest({phrases('source')}) AS phrase FROM p) SELECT task, count(*) FILTER ({_near_hint}) AS variants FROM f GROUP BY task")
pair(
    "chk18_retry_slice",
    joined("CASE WHEN len(l) < 2 THEN l ELSE l[start + 1:least(start + size, len(l))] END"),
    f"c AS (SELECT task, idx, {sentences('source')} AS l FROM p)",
    "w AS (SELECT *, greatest(len(l) // 4, 1) AS size, greatest(len(l) // 4, 1) % greatest(len(l), 1) AS start FROM c)",
    rows="w",
)
pair("chk23_paragraphs", joined(trimmed(r"regexp_split_to_array(source || chr(10) || '  ' || chr(10) || target, '\n(?:[ \t\r]*\n)+')")))
oracle("chk24_markdown_blocks", f"WITH {SNIPPETS_SQL} SELECT {kind_sql(D.trim('t'))} AS kind, count(*) AS n FROM s GROUP BY 1")


# --- heading stacks: a heading cuts the stack at its level if the stack is that deep ------------------
def stacks(text: str) -> str:
    """Common table expression k (task, idx, ord, block, path)."""
    level, title = "greatest(length(regexp_extract(e[1], '^#*')), 1)", D.trim("regexp_replace(e[1], '^#+', '')")
    push = f"CASE WHEN starts_with(e[1], '#') AND {title} <> '' THEN list_concat(CASE WHEN len(a) >= {level} THEN a[1:{level} - 1] ELSE a END, [{title}]) ELSE a END"
    return f"""b AS (SELECT task, idx, {blocks(text)} AS l FROM p), o AS (SELECT *, unnest(range(0, len(l))) AS ord FROM b),
    k AS (SELECT task, idx, ord, l[ord + 1] AS block, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(l[1:ord + 1], lambda x: [x])), lambda a, e: {push}) AS path FROM o)"""


_chk07 = stacks(f"'# A' || {BREAK} || source || {BREAK} || '### B' || {BREAK} || '- x' || {BREAK} || '### C' || {BREAK} || target")
oracle("chk07_source_blocks", f"WITH {PAIRS_SQL}, {_chk07} SELECT task, idx, ord, {kind_sql('block')} AS kind, {kind_sql('block')} NOT IN ('image', 'code') AS translate, {joined('path', "'/'")} AS path FROM k")
_win05 = stacks(f"'# A' || {BREAK} || source || {BREAK} || '### B' || {BREAK} || '### C' || {BREAK} || target")
oracle("win05_heading_path", f"WITH {PAIRS_SQL}, {_win05} SELECT task, idx, max(len(path)) AS depth FROM k WHERE starts_with(block, '#') GROUP BY ALL")
_heads = lambda x: rf"len(list_filter({D.lines(x)}, lambda x: regexp_matches(x, '^\s*#{{1,6}} ') AND {D.trim("regexp_replace(regexp_replace(trim(x), '^#{1,6} ', ''), '#+$', '')")} <> ''))"
oracle(
    "agg19_structure_stats",
    f"""WITH {PAIRS_SQL}, c AS (SELECT task, idx, len({blocks('source')}) AS source_blocks, len({blocks('target')}) AS target_blocks, {_heads('source')} AS source_headings, {_heads('target')} AS target_headings FROM p)
    SELECT *, abs(source_blocks - target_blocks) AS block_delta, source_blocks <> target_blocks OR source_headings <> target_headings AS mismatch FROM c""",
)
oracle(
    "srt10_style_sample",
    f"""WITH {PAIRS_SQL}, j AS (SELECT task, string_agg(source, {BREAK} ORDER BY idx, source) AS t FROM p GROUP BY task),
    f AS (SELECT task, list_filter({blocks('t')}, lambda b: NOT starts_with(b, '#') AND NOT starts_with(b, '<!--') AND length(b) >= 80) AS l FROM j),
    g AS (SELECT *, greatest(len(l) // 6, 1) AS step FROM f)
    SELECT task, length(substr({joined("list_filter(l, lambda b, i: (i - 1) % step = 0 AND (i - 1) / step < 6)", BREAK)}, 1, 4000)) AS chars FROM g""",
)

# --- rows of several texts --------------------------------------------------------------------------
oracle("set17_unique", f"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents) SELECT doc_id, array_to_string({first_seen('l')}, '|') AS lines FROM l")
_both = "list_concat(terms, coalesce(more, []))"
oracle(
    "set16_merged_excerpts",
    f"""WITH {PAIRS_SQL}, w AS (SELECT task, idx, source, {D.words('source')} AS terms FROM p),
    x AS (SELECT *, lead(source) OVER (PARTITION BY task ORDER BY idx) AS after, lead(terms) OVER (PARTITION BY task ORDER BY idx) AS more FROM w),
    y AS (SELECT *, {_both} AS united FROM x)
    SELECT task, idx, source || coalesce({BREAK} || after, '') AS excerpt, {joined(first_seen('united'), "','")} AS terms FROM y""",
)
_split = lambda c: f"(SELECT task, idx, unnest(range(0, len(l))) AS ord, unnest(l) AS text FROM (SELECT task, idx, {sentences(c)} AS l FROM p))"
oracle(
    "jn21_chunk_alignment",
    f"""WITH {PAIRS_SQL}, a AS {_split('source')}, b AS {_split('target')}, n AS (SELECT task, idx, max(ord) AS last FROM a GROUP BY ALL),
    t AS (SELECT task, idx, least(ord, last) AS ord, string_agg(text, chr(10) ORDER BY text) AS target FROM b JOIN n USING (task, idx) GROUP BY ALL)
    SELECT task, idx, CAST(ord AS INTEGER) AS ord, text, target FROM a LEFT JOIN t USING (task, idx, ord)""",
)
# blocks that share distinctive words; the best target of a source block, if there is only one
_distinctive = f"""list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[^A-Za-z0-9.''-]+'), lambda x: {D.low("regexp_replace(x, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')")}),
    lambda x: length(x) >= 4 AND regexp_matches(x, '[a-z]')))"""
_anchors = f"""a AS {_split('source')}, b AS {_split('target')},
    aw AS (SELECT task, idx, ord AS s, unnest({_distinctive}) AS w FROM a), bw AS (SELECT task, idx, ord AS t, unnest({_distinctive}) AS w FROM b),
    hits AS (SELECT task, idx, s, t, count(*) AS score FROM aw JOIN bw USING (task, idx, w) GROUP BY ALL HAVING count(*) >= 2 OR max(length(w)) >= 8),
    anchors AS (SELECT * FROM hits QUALIFY score = max(score) OVER (PARTITION BY task, idx, s)),
    single AS (SELECT task, idx, CAST(s AS INTEGER) AS s, CAST(min(t) AS INTEGER) AS t, min(score) AS score FROM anchors GROUP BY task, idx, anchors.s HAVING count(*) = 1)"""
oracle("jn28_unique_anchor", f"WITH {PAIRS_SQL}, {_anchors} SELECT task, idx, s, t, score FROM single")
oracle(
    "jn18_heading_pairs",
    f"""WITH {PAIRS_SQL}, {_anchors},
    even AS (SELECT task, idx FROM (SELECT task, idx, count(*) AS n FROM a GROUP BY ALL) JOIN (SELECT task, idx, count(*) AS n FROM b GROUP BY ALL) USING (task, idx, n))
    SELECT task, idx, CAST(ord AS INTEGER) AS s, CAST(ord AS INTEGER) AS t FROM a SEMI JOIN even USING (task, idx)
    UNION ALL SELECT task, idx, s, t FROM single ANTI JOIN even USING (task, idx)""",
)


def fit(a: str, b: str) -> str:
    """How well two paragraphs fit."""
    a, b = (f"lower({D.collapse(x)})" for x in (a, b))
    return f"""CASE WHEN {b} = '' THEN 0 ELSE 3 + CASE WHEN {a} = {b} THEN 12 ELSE 0 END + CASE WHEN {a} <> '' AND (contains({b}, {a}) OR contains({a}, {b})) THEN 8 ELSE 0 END
        + CASE WHEN regexp_matches({a}, '[a-z0-9]') AND starts_with({b}, regexp_extract({a}, '[a-z0-9]+')) THEN 4 ELSE 0 END END"""


pair("txt79_alignment_score", fit("source", "target"))
_tokens = "list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z0-9.''-]{{4,}}'), lambda w: lower(trim(w, '''.-'))))"
oracle(
    "jn20_alignment",
    f"""WITH {PAIRS_SQL}, a AS {_split('source')}, b AS {_split('target')},
    n AS (SELECT task, idx, count(*) AS sources FROM a GROUP BY ALL), m AS (SELECT task, idx, count(*) AS targets FROM b GROUP BY ALL),
    x AS (SELECT task, idx, a.ord AS i, b.ord AS j, least(a.ord * targets // sources, targets - 1) AS even,
            len(list_intersect({_tokens.format('a.text')}, {_tokens.format('b.text')})) AS shared, {fit('a.text', 'b.text')} AS score
        FROM a JOIN b USING (task, idx) JOIN n USING (task, idx) JOIN m USING (task, idx)),
    y AS (SELECT *, max(shared) OVER (PARTITION BY task, idx, i) AS most FROM x),
    z AS (SELECT *, CASE WHEN most >= 2 AND count(*) FILTER (shared = most) OVER w = 1 THEN min(j) FILTER (shared = most) OVER w ELSE even END AS start
        FROM y WINDOW w AS (PARTITION BY task, idx, i)),
    c AS (SELECT task, idx, i, start, min(score) FILTER (j = start) AS own, max(score) AS best, min_by(j, struct_pack(s := -score, j := j)) AS top
        FROM z WHERE j BETWEEN start - 2 AND start + 2 GROUP BY ALL)
    SELECT a.task, a.idx, CAST(ord AS INTEGER) AS ord, coalesce(CASE WHEN best > own THEN top ELSE start END, 0) AS target
    FROM a LEFT JOIN c ON a.task = c.task AND a.idx = c.idx AND a.ord = c.i""",
)
_bare_words = f"list_transform({D.words('phrase')}, lambda w: regexp_replace(w, '^[^A-Za-z]+|[^A-Za-z]+$', '', 'g'))"
_noise = f"""(strlen(phrase) < 3 OR strlen(phrase) > 64 OR {D.isin('phrase', X.NOISE_WORDS)} OR regexp_full_match(phrase, '[A-Z]*')
    OR len({D.words('phrase')}) >= 2 AND len(list_filter({_bare_words}, lambda w: w <> '' AND NOT {D.isin('w', X.NOISE_WORDS)})) = 0)"""
_canonical = rf"regexp_replace(regexp_replace({D.collapse('f')}, '^(?:(?:{'|'.join(X.LEADING_NOISE)}) )+', ''), '(?: (?:[\x00-\x7F]|{'|'.join(X.TRAILING_NOISE)}))+$', '')"
oracle(
    "agg23_hint_build",
    f"""WITH {PAIRS_SQL}, c AS (SELECT task, idx, {_canonical} AS phrase FROM (SELECT task, idx, unnest({phrases('source')}) AS f FROM p))
    SELECT task, phrase, count(*) AS occurrences, min(idx) AS first_chunk, array_to_string(list_sort(list_distinct(list(idx))), ',') AS chunks FROM c WHERE NOT {_noise}
    GROUP BY task, phrase HAVING contains(phrase, ' ') OR count(*) >= 2 AND strlen(phrase) >= 6""",
)


def mentioned(asked: str, found: str) -> str:
    """Common table expression ``found`` (task, idx): the rows of ``asked`` (task, idx, hay, term; terms of one word) that speak of the term."""
    boundary = "regexp_matches(hay, '(^|[^A-Za-z0-9_-])' || regexp_escape(term) || '($|[^A-Za-z0-9_-])')"
    owner = key_sql("regexp_replace(term, '[''’]s$', '')")
    size = "greatest(length(k), length(key))"
    close = f"length(k) >= 4 AND abs(length(k) - length(key)) / {size} <= 0.3 AND 1 - levenshtein(k, key) / {size} >= 0.85"
    by_owner = f"length({owner}) >= 4 AND (contains(run, '''') OR contains(run, '’')) AND k IN ({owner}, {owner} || 's')"
    wide = "regexp_matches(term, '[^\\x00-\\x7F]')"
    return f"""{found}_k AS (SELECT DISTINCT task, idx, hay, term, {key_sql('term')} AS key FROM {asked} WHERE term <> ''),
    {found}_r AS (SELECT task, idx, unnest(regexp_extract_all(hay, '[A-Za-z0-9''’+&@#%=-]+')) AS run FROM (SELECT DISTINCT task, idx, hay FROM {asked})),
    {found}_w AS (SELECT DISTINCT task, idx, run, {key_sql('run')} AS k FROM {found}_r),
    {found} AS (SELECT task, idx FROM {found}_k WHERE contains(hay, term) AND ({wide} OR {boundary})
        UNION SELECT task, idx FROM {found}_k JOIN {found}_w USING (task, idx) WHERE NOT {wide} AND length(key) >= 4 AND (k = key OR {close} OR {by_owner}))"""


oracle(
    "txt46_mentions",
    f"""WITH {PAIRS_SQL}, q AS (SELECT task, idx, source AS hay, unnest({D.words('target')}) AS term FROM p), {mentioned('q', 'm')}
    SELECT task, idx, (task, idx) IN (SELECT (task, idx) FROM m) AS out FROM p""",
)
oracle(
    "jn27_local_cover",
    f"""WITH {PAIRS_SQL}, q AS (SELECT task, idx, source AS hay, {_longest('target')} AS term FROM p), r AS (SELECT task, idx, target AS hay, {_longest('source')} AS term FROM p),
    {mentioned('q', 'm')}, {mentioned('r', 'o')}, both_ways AS (SELECT task, idx FROM m UNION SELECT task, idx FROM o)
    SELECT task, idx, (task, idx) IN (SELECT (task, idx) FROM both_ways) AS covered FROM p""",
)
_before, _after = "substr(source, 1, strpos(source, w) - 1)", "substr(source, strpos(source, w) + length(w))"
_opens = f"({D.trim(_before)} = '' OR right({D.rtrim(_before)}, 1) IN ('.', '!', '?', ':'))"
_sign_of_name = rf"""contains(source, w) AND (length(replace({_before}, '(', '')) < length(replace({_before}, ')', '')) OR regexp_matches({_after}, '^\s*(?:,\s*\d|\(\d{{4}}|et al)')
    OR NOT {_opens} AND left({D.ltrim(_after)}, 1) IN ('''', '’', ',', ';', ')'))"""
pair("txt51_structural_evidence", f"len(list_filter(list_distinct({D.words('target')}), lambda w: {_sign_of_name})) > 0")
_fields = ", ".join(f"CASE WHEN json_type(o, '$.{k}') = 'VARCHAR' THEN json_extract_string(o, '$.{k}') END" for k in ("patchedSentence", "patched_sentence", "repairedText", "repaired_text"))
snippet(
    "txt81_residual_decision",
    f"nullif({D.trim(f'coalesce({_fields})')}, '')",
    f"""j AS (SELECT id, n, CASE WHEN contains(t, '{{') THEN list_filter(list_transform(list_filter(range(1, length(t) + 1), lambda k: substr(t, k, 1) = '{{'), lambda i: {_objects}),
        lambda o: o IS NOT NULL AND json_extract_string(o, '$.decision') IN ('repair', 'patch', 'keep', 'correct'))[1] END AS o FROM s)""",
    rows="j",
)
oracle(
    "qa14_shared_clusters",
    """WITH RECURSIVE held AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(p_name, ' ')) AS part FROM part),
    near AS (SELECT DISTINCT a.part AS a, b.part AS b FROM held a JOIN held b USING (id)),
    reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
    label AS (SELECT a AS part, min(id) AS cluster FROM reach JOIN held ON b = part GROUP BY a)
    SELECT cluster, count(DISTINCT id) AS n FROM held JOIN label USING (part) GROUP BY cluster""",
)
oracle(
    "str06_flush_policy",
    f"""WITH {LOG_SQL}, k AS (SELECT task, row_number() OVER (PARTITION BY task ORDER BY seq) AS k FROM log)
    SELECT task, count(*) FILTER (CASE WHEN k < 3 THEN true WHEN k < 20 THEN k % 2 = 0 ELSE k % 4 = 0 END) AS flushes FROM k GROUP BY task""",
)
# spaced repetition in single precision, one review a step
_f = lambda x: f"CAST({x} AS FLOAT)"
_miss = "(5 - least(quality, 5))"
_ease = _f(f"ease + {_f(f"{_f('0.1')} - {_f(f'{_f(_miss)} * {_f(f"{_f('0.08')} + {_f(f'{_f(_miss)} * {_f("0.02")}')}")}')}")}")
oracle(
    "str16_sm2",
    f"""WITH RECURSIVE {REVIEWS_SQL}, r AS (SELECT book, word, quality, row_number() OVER (PARTITION BY book, word ORDER BY seq) AS k, count(*) OVER (PARTITION BY book, word) AS reviews FROM reviews),
    f AS (SELECT book, word, reviews, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS repetitions, {_f('0')} AS interval, {_f('2.5')} AS ease FROM r WHERE k = 1
        UNION ALL SELECT book, word, f.reviews, r.k, CASE WHEN quality >= 3 THEN repetitions + 1 ELSE 0 END,
            CASE WHEN quality < 3 THEN {_f('0.007')} WHEN repetitions = 0 THEN {_f('1')} WHEN repetitions = 1 THEN {_f('6')} ELSE greatest({_f('interval * ease')}, {_f('1')}) END,
            greatest({_f('1.3')}, {_ease})
        FROM f JOIN r USING (book, word) WHERE r.k = f.k + 1)
    SELECT book, word, reviews, repetitions, round(CAST(interval AS DOUBLE), 2) AS interval, round(CAST(ease AS DOUBLE), 3) AS ease FROM f WHERE k = reviews""",
)

# --- pages, whose elements of one name are not nested in each other -----------------------------------
_strip = lambda x: f"regexp_replace({x}, '(?s)<[^>]*>?|>', '', 'g')"
_tags_of = lambda names: "(?is)" + "|".join(rf"<{n}\b[^>]*>.*?</{n}>" for n in names)


def cleaned(x: str) -> str:
    for name in ("style", "script", "nav", "footer"):
        x = rf"regexp_replace({x}, '(?is)<{name}\b[^>]*>.*?(?:</{name}\b[^>]*>|$)', '', 'g')"
    return x


def plain(x: str) -> str:
    """The text of a piece of HTML, on one line."""
    x = _strip(x)
    for entity, sign in (("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{sign}')"
    return D.collapse(x)


_name = lambda x: rf"lower(regexp_extract({x}, '^<([A-Za-z0-9]+)', 1))"
_pieces = [f"h{k}" for k in range(1, 7)]
oracle("txt14_boilerplate", f"SELECT page_id, {cleaned('html')} AS out FROM pages")
oracle(
    "txt09_densest_block",
    f"""WITH e AS (SELECT page_id, regexp_extract_all(html, '{_tags_of(('div', 'section'))}') AS l FROM pages),
    m AS (SELECT page_id, l, list_transform(l, lambda x: length({_strip('x')})) AS sizes FROM e)
    SELECT page_id, CASE WHEN list_max(sizes) >= 400 THEN l[list_position(sizes, list_max(sizes))] END AS out FROM m""",
)
_line = f"""CASE WHEN regexp_matches({_name('x')}, '^h[1-6]$') THEN repeat('#', CAST(substr({_name('x')}, 2) AS BIGINT)) || ' '
    WHEN {_name('x')} = 'li' THEN '- ' WHEN {_name('x')} = 'blockquote' THEN '> ' ELSE '' END || {plain('x')}"""
oracle(
    "src22_page_markdown",
    rf"""WITH c AS (SELECT page_id, {cleaned('html')} AS page FROM pages),
    b AS (SELECT page_id, coalesce(nullif(regexp_extract(page, '(?is)<article\b[^>]*>.*?</article>'), ''), nullif(regexp_extract(page, '(?is)<main\b[^>]*>.*?</main>'), ''), page) AS body FROM c),
    l AS (SELECT page_id, body, list_filter(regexp_extract_all(body, '{_tags_of((*_pieces, 'p', 'li', 'blockquote', 'pre', 'td', 'th'))}'), lambda x: {plain('x')} <> '') AS l FROM b)
    SELECT page_id, CASE WHEN len(l) = 0 THEN {plain('body')} ELSE array_to_string(list_transform(l, lambda x: {_line}), {BREAK}) END AS out FROM l""",
)
_kinds = {"p": "paragraph", "li": "listItem", "blockquote": "blockquote", "pre": "code", "figcaption": "caption", "caption": "caption", "td": "tableCell", "th": "tableCell", "dt": "definition", "dd": "definition", "figure": "image"}
_kind_of = " ".join(f"WHEN {_name('x')} = '{name}' THEN '{kind}'" for name, kind in _kinds.items())
oracle(
    "chk22_html_blocks",
    f"""WITH l AS (SELECT page_id, html, list_filter(regexp_extract_all(html, '{_tags_of((*_pieces, *_kinds))}'), lambda x: {plain('x')} <> '' OR contains(lower(x), '<img')) AS l FROM pages),
    k AS (SELECT page_id, unnest(CASE WHEN len(l) > 0 THEN list_transform(l, lambda x: CASE WHEN regexp_matches({_name('x')}, '^h[1-6]$') THEN 'heading' WHEN {plain('x')} = '' THEN 'image' {_kind_of} END)
        WHEN {plain('html')} <> '' THEN ['chapterText'] ELSE [] END) AS kind FROM l)
    SELECT kind, count(*) AS n FROM k GROUP BY kind""",
)
