"""Books, packages and scanned pages: EPUBs are packed from the pages table and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import fuzzy as Z
from quire.functions import text as X
from quire.operators import layout as Y
from quire.registry import query
from quire.sources import artifacts as S
from quire.sources import books as B
from quire.sources.tables import table
from quire.streaming import state as T

from . import duck as D
from .custom_queries import _csv, round_trip
from .standins import LOG_SQL, TERMS_SQL, event_log, fixture, snippets, terms


def q(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(f)


def chapters(s: SparkSession, d: str) -> DataFrame:
    """Ten pages a book; every thirteenth chapter is empty."""
    return table(s, d, "pages").select(
        F.concat(F.lit("b"), F.floor(F.col("page_id") / 10), F.lit(".epub")).alias("path"), (F.col("page_id") % 10).cast("int").alias("ord"), F.concat(F.lit("T"), "page_id").alias("title"),
        F.when(F.col("page_id") % 13 == 0, " ").otherwise(F.concat(F.lit("<h1>T"), "page_id", F.lit("</h1><p>"), "url", F.lit("</p>"))).alias("html"),
    )


CH = "ch AS (SELECT 'b' || page_id // 10 || '.epub' AS path, page_id % 10 AS ord, 'T' || page_id AS title, page_id % 13 = 0 AS blank, url, page_id FROM pages)"
epubs = lambda s, d: B.pack_epub(chapters(s, d))
_full = f"WITH {CH} SELECT path, row_number() OVER (PARTITION BY path ORDER BY ord) - 1 AS ord, title FROM ch WHERE NOT blank"
q("src03_epub_blocks", lambda s, d: B.epub_blocks(epubs(s, d)).select("path", "chapter_title", "kind", "text"), f"WITH {CH} SELECT path, title AS chapter_title, 'heading' AS kind, title AS text FROM ch WHERE NOT blank UNION ALL SELECT path, title, 'paragraph', trim(url) FROM ch WHERE NOT blank")
q("src04_epub_chapters", lambda s, d: B.epub_chapters(epubs(s, d)).select("path", F.col("ord").cast("long").alias("ord"), "title"), _full)
q("src05_spine", lambda s, d: B.epub_chapters(epubs(s, d)).groupBy("path").agg(F.count(F.lit(1)).alias("chapters")), f"WITH {CH} SELECT path, count(*) AS chapters FROM ch WHERE NOT blank GROUP BY path")
q("src06_ncx_titles", lambda s, d: B.epub_chapters(epubs(s, d)).filter("title_source = 'EpubNcx'").select("path", "title"), f"WITH {CH} SELECT path, title FROM ch WHERE NOT blank")
q("src07_title_sources", lambda s, d: B.epub_chapters(epubs(s, d)).groupBy("title_source").agg(F.count(F.lit(1)).alias("n")), f"WITH {CH} SELECT 'EpubNcx' AS title_source, count(*) AS n FROM ch WHERE NOT blank")
q("src08_archive_files", lambda s, d: B.bundle_files(epubs(s, d)).groupBy("path").agg(F.count(F.lit(1)).alias("files")), f"WITH {CH} SELECT path, count(*) + 4 AS files FROM ch GROUP BY path")
q("src23_sections", lambda s, d: B.epub_chapters(epubs(s, d)).select("path", "title", F.regexp_replace("html", Z.TAG, "").alias("text")), f"WITH {CH} SELECT path, title, title || url AS text FROM ch WHERE NOT blank")
q("src25_epub_probe", lambda s, d: B.epub_probe(B.epub_blocks(epubs(s, d))).select("path", "chars", "paragraphs"), f"WITH {CH} SELECT path, CAST(sum(length(title) + length(trim(url))) AS BIGINT) AS chars, count(*) AS paragraphs FROM ch WHERE NOT blank GROUP BY path")
q("src26_one_chapter", lambda s, d: B.epub_chapters(epubs(s, d)).filter("title = 'T7'").select("path", "title"), f"WITH {CH} SELECT path, title FROM ch WHERE title = 'T7' AND NOT blank")
q("src27_bundle", lambda s, d: B.bundle_files(epubs(s, d)).filter(F.endswith("name", F.lit(".xhtml"))).select("path", "name"), f"WITH {CH} SELECT path, 'OEBPS/c' || (row_number() OVER (PARTITION BY path ORDER BY ord) - 1) || '.xhtml' AS name FROM ch")
q("src28_backup", lambda s, d: B.bundle_files(epubs(s, d)).groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("name = 'mimetype'"), f"WITH {CH} SELECT 'mimetype' AS name, count(DISTINCT path) AS n FROM ch")
q("src29_book_kind", lambda s, d: B.is_bilingual(B.epub_chapters(epubs(s, d))), f"WITH {CH} SELECT path, 'monolingual' AS kind FROM ch WHERE NOT blank GROUP BY path")
q("snk11_epub_packer", lambda s, d: epubs(s, d).select("path", (F.length("content") > 0).alias("packed")), f"WITH {CH} SELECT DISTINCT path, true AS packed FROM ch")
q("src24_source_artifacts", lambda s, d: round_trip(lambda df, p: df.write.parquet(p), lambda s_, p: s_.read.parquet(p), lambda s_, d_: chapters(s_, d_))(s, d).select("path", F.col("ord").cast("long").alias("ord"), "title"), f"WITH {CH} SELECT path, ord, title FROM ch")
q("src16_optional_artifact", lambda s, d: S.optional_artifact(s, T.shared_folder(s), S.EVENTS).select("seq"), "SELECT CAST(0 AS BIGINT) AS seq WHERE false")
q("src19_dictionary_csv", lambda s, d: round_trip(S.write_text, S.csv_pack, lambda s_, d_: s_.createDataFrame([(x,) for x in _csv.strip().split("\n")], "value string").coalesce(1))(s, d).select("word", F.col("rank").cast("long").alias("rank")), "SELECT * FROM (VALUES ('abandon', 1), ('knife', 1)) t(word, rank)")
q("src21_csv_quotes", lambda s, d: round_trip(S.write_text, lambda s_, p: s_.read.option("multiLine", True).option("quote", '"').option("escape", '"').csv(p), lambda s_, d_: s_.createDataFrame([('a,"b, ""c""\nd",e',), ("",), ("f,g,h",)], "value string").coalesce(1))(s, d).select(F.col("_c0").alias("x"), F.col("_c1").alias("y"), F.col("_c2").alias("z")), "SELECT * FROM (VALUES ('a', 'b, \"c\"' || chr(10) || 'd', 'e'), ('f', 'g', 'h')) t(x, y, z)")
q("src09_docx", lambda s, d: B.docx_texts(docx_files(s, d)).select("path", "text"), "SELECT 'd' || n_nationkey || '.docx' AS path, '## ' || n_name || chr(10) || chr(10) || '- item ' || n_nationkey AS text FROM nation")


def docx_files(s: SparkSession, d: str) -> DataFrame:
    """A document for each nation: a heading and a list item."""

    def pack(name: str, number: str) -> bytes:
        import io
        import zipfile

        w, out = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"', io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="heading 2"/></w:pPr><w:r><w:t>{name}</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t><w:tab/><w:t>{number}</w:t></w:r></w:p></w:body></w:document>')
        return out.getvalue()

    n = F.col("n_nationkey").cast("string")
    return table(s, d, "nation").select(F.concat(F.lit("d"), n, F.lit(".docx")).alias("path"), Z.column(pack, "binary")(F.col("n_name"), n).alias("content"))


_wal = lambda s, d: event_log(s, d).select("seq", F.when(F.col("stage") == "queued", "flush_committed").otherwise(F.col("stage")).alias("stage"), F.col("message").alias("payload"))
q("snk05_wal", lambda s, d: round_trip(S.append_wal, lambda s_, p: s_.read.schema("seq bigint, stage string, payload string").json(p), _wal)(s, d).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count("payload").alias("snapshots")), f"WITH {LOG_SQL} SELECT CASE stage WHEN 'queued' THEN 'flush_committed' ELSE stage END AS stage, count(*) AS n, count(*) FILTER (stage = 'queued') AS snapshots FROM log GROUP BY 1")
q("snk02_text_artifact", lambda s, d: round_trip(S.write_text, lambda s_, p: s_.read.text(p), lambda s_, d_: table(s_, d_, "part").select("p_name"))(s, d), "SELECT p_name AS value FROM part")
q("snk03_atomic_write", lambda s, d: round_trip(lambda df, p: (S.write_json(df.limit(0), p), S.write_json(df, p)), lambda s_, p: s_.read.schema("n_name string").json(p), lambda s_, d_: table(s_, d_, "nation").select("n_name"))(s, d), "SELECT n_name FROM nation")
q("snk13_markdown_pages", lambda s, d: table(s, d, "part").select("p_partkey", Z.column(S.markdown_html, "string")(F.concat(F.lit("# "), "p_name", F.lit("\n\n"), "p_type")).alias("html")), "SELECT p_partkey, '<h1>' || p_name || '</h1>' || chr(10) || '<p>' || p_type || '</p>' AS html FROM part")
q("str13_emitted_events", lambda s, d: T.run_to_table(T.table_stream(s, d, "events").select("event_id", "event_type")), "SELECT event_id, event_type FROM events")
q("txt39_accepted_terms", lambda s, d: terms(s, d).select("task", "chunk", "pos", "source", "translation", "confidence", X.accepts_term(F.col("source"), F.col("translation"), F.when(F.col("pos") % 3 == 0, "person").otherwise("technical"), F.lit("x"), F.col("confidence"), F.concat(F.lit("text T1 "), F.col("translation")), F.when(F.col("task") % 2 == 0, "academic").otherwise("novel")).alias("ok")), f"WITH {TERMS_SQL} SELECT task, chunk, pos, source, translation, confidence, confidence >= 85 AND NOT (pos % 3 = 0 AND task % 2 = 0) AS ok FROM terms")
_t2s = ("國語漢書學", "国语汉书学")
q("txt72_variants", lambda s, d: fixture(s, [("中國語文",), ("漢書",), ("plain",)], "t string").select("t", F.translate("t", *_t2s).alias("out")), "SELECT t, translate(t, '國語漢書學', '国语汉书学') AS out FROM (VALUES ('中國語文'), ('漢書'), ('plain')) v(t)")


def blocks(s: SparkSession, d: str) -> DataFrame:
    """Parts as layout blocks of scanned documents."""
    label = F.element_at(F.array(*[F.lit(x) for x in ("text", "table", "table", "paragraph_title", "text", "page_number", "figure")]), (F.col("p_size") % 7 + 1).cast("int"))
    return table(s, d, "part").select((F.col("p_partkey") % 30).alias("doc"), F.floor(F.col("p_partkey") / 300).cast("int").alias("page"), F.col("p_partkey").cast("int").alias("ord"), F.when(F.col("p_partkey") < 30, "doc_title").otherwise(label).alias("label"), F.col("p_name").alias("content"))


BL = "bl AS (SELECT p_partkey % 30 AS doc, p_partkey // 300 AS page, p_partkey AS ord, CASE WHEN p_partkey < 30 THEN 'doc_title' ELSE ['text', 'table', 'table', 'paragraph_title', 'text', 'page_number', 'figure'][p_size % 7 + 1] END AS label, p_name AS content FROM part)"
q("udf09_layout_markdown", lambda s, d: Y.layout_markdown(blocks(s, d), "doc").select("doc", F.md5(F.col("markdown").cast("binary")).alias("md5")), f"WITH {BL}, x AS (SELECT *, label = 'table' AND coalesce(lag(label) OVER w, '') <> 'table' AS first, label = 'table' AND coalesce(lead(label) OVER w, '') <> 'table' AS last FROM bl WINDOW w AS (PARTITION BY doc ORDER BY page, ord)) SELECT doc, md5(string_agg(CASE WHEN first THEN '{Y.START}' || chr(10) ELSE '' END || CASE label WHEN 'doc_title' THEN '# ' || content WHEN 'paragraph_title' THEN '## ' || content WHEN 'figure' THEN '![](' || content || ')' ELSE content END || CASE WHEN last THEN chr(10) || '{Y.END}' ELSE '' END, chr(10) || chr(10) ORDER BY page, ord)) AS md5 FROM x WHERE label <> 'page_number' GROUP BY doc")
q("udf10_normalised", lambda s, d: snippets(s, d).select("id", F.col("n").cast("long").alias("n"), Y.normalised(F.concat(F.col("t"), F.lit("\n 12 \n\n\n\nend"))).alias("out")))
q("udf11_table_groups", lambda s, d: Y.table_groups(blocks(s, d), "doc").groupBy("doc").agg(F.max("table").cast("long").alias("tables"), F.count("table").alias("rows")), f"WITH {BL}, x AS (SELECT *, label = 'table' AND coalesce(lag(label) OVER (PARTITION BY doc ORDER BY page, ord), '') <> 'table' AS first FROM bl) SELECT doc, nullif(count(*) FILTER (first), 0) AS tables, count(*) FILTER (label = 'table') AS rows FROM x GROUP BY doc")
_para = lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "content")).withColumns({"page": F.lit(0), "label": F.when(F.col("ord") == 0, "title").otherwise("text")})
PARA = f"pa AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS ord, unnest(ls) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
q("udf12_header_boundary", lambda s, d: Y.header_boundary(_para(s, d), "doc_id"), f"WITH {PARA} SELECT doc_id, coalesce(min(ord) FILTER (len({D.words('content')}) >= 40 OR regexp_matches(content, '(?i)^\\s*#*\\s*(?:abstract|introduction|1\\.?\\s+introduction|摘要|引言)\\b')), count(*)) AS boundary FROM pa GROUP BY doc_id")
q("udf13_front_matter", lambda s, d: Y.front_matter(_para(s, d), "doc_id"), f"WITH {PARA} SELECT doc_id, max({D.trim('content')}) FILTER (ord = 0) AS title, max({D.trim('content')}) FILTER (ord = 1) AS authors FROM pa GROUP BY doc_id")
_au = [("Ann Lee1*, Bob Q. Ray† and Cy Doe, PhD", "Ann Lee|Bob Q. Ray|Cy Doe"), ("J. Smith; K. O'Neil & L. M. Zhao", "J. Smith|K. O'Neil|L. M. Zhao"), ("Department", "")]
q("udf14_authors", lambda s, d: fixture(s, [(a,) for a, _ in _au], "line string").select("line", F.array_join(Y.authors(F.col("line")), "|").alias("names")), "SELECT * FROM (VALUES " + ", ".join(f"({D.lit(a)}, {D.lit(b)})" for a, b in _au) + ") t(line, names)")
