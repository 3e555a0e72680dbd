"""Readers of books: EPUB, DOCX, Markdown and text files, bundles, by Spark's binary file source.

Files are read whole, one at a time in a task; a row of output is a chapter or a block. No service or
file system is used but the source's own, so a table of (path, content) from anywhere works as well.
"""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.fuzzy import html_blocks, strip_tags
from quire.operators.library import document_kind

CHAPTERS = "path string, ord int, href string, title string, title_source string, html string"
BLOCKS = "path string, chapter int, chapter_title string, ord int, kind string, text string"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, kind) of files of known kinds; an unknown kind is an error only when read."""
    return spark.read.format("binaryFile").load(path).select("path", "content", document_kind(F.col("path")).alias("kind"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, hash) of Markdown and text files, without a byte-order mark."""
    from quire.functions.fuzzy import column, fnv1a64

    rows = spark.read.text(path, wholetext=True).select("_metadata.file_path", F.regexp_replace("value", "^﻿", "").alias("text"))
    return rows.select(F.col("file_path").alias("path"), "text", column(fnv1a64, "string")(F.col("text")).alias("hash"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def open_archive(content: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(content))


def package(book: zipfile.ZipFile) -> tuple[str, list[str], str | None, str | None]:
    """(folder, spine, NCX, navigation): paths inside the archive, in reading order."""
    container = ET.fromstring(book.read("META-INF/container.xml"))
    opf = next(e.attrib["full-path"] for e in container.iter() if _local(e.tag) == "rootfile")
    base = posixpath.dirname(opf)
    root = ET.fromstring(book.read(opf))
    items = {e.attrib["id"]: e.attrib for e in root.iter() if _local(e.tag) == "item"}
    join = lambda href: posixpath.normpath(posixpath.join(base, href.split("#")[0]))
    spine = [join(items[e.attrib["idref"]]["href"]) for e in root.iter() if _local(e.tag) == "itemref" and e.attrib["idref"] in items]
    ncx = next((join(a["href"]) for a in items.values() if a.get("media-type") == "application/x-dtbncx+xml"), None)
    nav = next((join(a["href"]) for a in items.values() if "nav" in a.get("properties", "").split()), None)
    return base, spine, ncx, nav


def ncx_titles(book: zipfile.ZipFile, path: str | None) -> dict[str, str]:
    if path is None or path not in book.namelist():
        return {}
    out: dict[str, str] = {}
    for point in ET.fromstring(book.read(path)).iter():
        if _local(point.tag) == "navPoint":
            label = next(("".join(e.itertext()).strip() for e in point.iter() if _local(e.tag) == "navLabel"), "")
            src = next((e.attrib.get("src", "") for e in point.iter() if _local(e.tag) == "content"), "")
            if label and src:
                out.setdefault(posixpath.normpath(posixpath.join(posixpath.dirname(path), src.split("#")[0])), " ".join(label.split()))
    return out


def nav_titles(book: zipfile.ZipFile, path: str | None) -> dict[str, str]:
    if path is None or path not in book.namelist():
        return {}
    text = book.read(path).decode("utf-8", "replace")
    out: dict[str, str] = {}
    for m in re.finditer(r"(?is)<a\b[^>]*href=[\"']([^\"'#]+)[^\"']*[\"'][^>]*>(.*?)</a>", text):
        title = " ".join(strip_tags(m[2]).split())
        if title:
            out.setdefault(posixpath.normpath(posixpath.join(posixpath.dirname(path), m[1])), title)
    return out


def chapters(content: bytes) -> Iterator[dict]:
    """Chapters in reading order, without empty ones; titles by NCX, navigation, heading, head, number."""
    with open_archive(content) as book:
        _, spine, ncx, nav = package(book)
        by_ncx, by_nav = ncx_titles(book, ncx), nav_titles(book, nav)
        ord_ = 0
        for href in spine:
            if href not in book.namelist():
                continue
            text = book.read(href).decode("utf-8", "replace")
            body = (re.search(r"(?is)<body[^>]*>(.*)</body>", text) or [None, text])[1]
            if not strip_tags(body).strip() and "<img" not in body:
                continue
            clean = lambda m: " ".join(strip_tags(m[1]).split()) if m else ""
            heading = clean(re.search(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", text))
            head = clean(re.search(r"(?is)<title[^>]*>(.*?)</title>", text))
            title, source = next((t, s) for t, s in ((by_ncx.get(href), "EpubNcx"), (by_nav.get(href), "EpubNav"), (heading, "EpubHtmlTitle"), (head, "EpubHtmlTitle"), (f"Chapter {ord_ + 1}", "EpubSpineFallback")) if t)
            yield {"ord": ord_, "href": href, "title": title, "title_source": source, "html": body}
            ord_ += 1


#: Bytes of rows that leave a reader together.
SENT = 1 << 20


def of_each(books: DataFrame, kind: str, rows: Callable[[str, bytes], Iterable[dict]]) -> DataFrame:
    """The rows of each of (path, content); one file is opened at a time, and rows leave in portions."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DataType

    made = to_arrow_schema(DataType.fromDDL(kind))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            out, size = [], 0
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                for row in rows(path.as_py(), content.as_py()):
                    out.append(row)
                    size += sum(len(v) for v in row.values() if isinstance(v, (str, bytes)))
                    if size >= SENT:
                        yield pa.RecordBatch.from_pylist(out, made)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, made)

    return books.select("path", "content").mapInArrow(read, kind)


def epub_chapters(books: DataFrame) -> DataFrame:
    """Chapters of (path, content)."""
    return of_each(books, CHAPTERS, lambda path, content: ({"path": path, **c} for c in chapters(content)))


def epub_blocks(books: DataFrame) -> DataFrame:
    """Typed blocks of all chapters of (path, content)."""
    return of_each(books, BLOCKS, lambda path, content: ({"path": path, "chapter": c["ord"], "chapter_title": c["title"], **b} for c in chapters(content) for b in html_blocks(c["html"])))


def epub_probe(blocks: DataFrame) -> DataFrame:
    """Characters, paragraphs and a preview of each book."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter", "ord", "text"))), lambda x: x["text"]), " ")
    return blocks.groupBy("path").agg(F.sum(F.length("text")).alias("chars"), F.count_if(F.col("kind") == "paragraph").alias("paragraphs"), F.substring(joined, 1, 320).alias("preview"))


WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_markdown(content: bytes) -> str:
    """Paragraphs as Markdown: headings by style, list items, tabs and breaks as blanks, deletions left out."""
    with open_archive(content) as doc:
        root = ET.fromstring(doc.read("word/document.xml"))
        names = {}
        if "word/styles.xml" in doc.namelist():
            for s in ET.fromstring(doc.read("word/styles.xml")).iter(f"{WORD}style"):
                name = s.find(f"{WORD}name")
                names[s.attrib.get(f"{WORD}styleId")] = name.attrib.get(f"{WORD}val", "") if name is not None else ""
    out = []
    for p in root.iter(f"{WORD}p"):
        gone = {t for d in p.iter(f"{WORD}del") for t in d.iter()}
        text = "".join(e.text or "" if e.tag == f"{WORD}t" else " " for e in p.iter() if e.tag in (f"{WORD}t", f"{WORD}tab", f"{WORD}br") and e not in gone)
        text = " ".join(text.split())
        if not text:
            continue
        style = next((s.attrib.get(f"{WORD}val", "") for s in p.iter(f"{WORD}pStyle")), "")
        key = (names.get(style) or style).strip().lower().replace(" ", "")
        m = re.fullmatch(r"(?:heading|标题)([1-6])(?:char)?", key)
        level = int(m[1]) if m else {"title": 1, "标题": 1, "subtitle": 2, "副标题": 2}.get(key)
        out.append("#" * level + " " + text if level else "- " + text if p.find(f"{WORD}pPr/{WORD}numPr") is not None else text)
    return "\n\n".join(out)


def docx_texts(books: DataFrame) -> DataFrame:
    return of_each(books, "path string, text string", lambda path, content: [{"path": path, "text": docx_markdown(content)}])


def bundle_files(bundles: DataFrame) -> DataFrame:
    """(path, name, content) of the files in ZIP bundles and backups; folders and unsafe names go."""

    def inside(path: str, content: bytes) -> Iterator[dict]:
        with open_archive(content) as z:
            for name in z.namelist():
                if not name.endswith("/") and ".." not in name.split("/") and not name.startswith("/"):
                    yield {"path": path, "name": name, "content": z.read(name)}

    return of_each(bundles, "path string, name string, content binary", inside)


def is_bilingual(chapters_: DataFrame) -> DataFrame:
    """(path, kind): bilingual if a book's text has both Chinese and English in good measure."""
    text = F.regexp_replace("html", "(?s)<[^>]*>?", "")
    han, latin = (F.sum(F.length(text) - F.length(F.regexp_replace(text, p, ""))) for p in ("[一-鿿]", "[A-Za-z]"))
    return chapters_.groupBy("path").agg(F.when((han > 0) & (latin > 0) & (F.least(han * 3, latin) * 4 >= F.greatest(han * 3, latin)), "bilingual").otherwise("monolingual").alias("kind"))


def pack_epub(chapters_: DataFrame) -> DataFrame:
    """(path, content): an EPUB of each book's chapters (path, ord, title, html)."""

    def pack(key, pdf):
        import html

        import pandas as pd

        out = io.BytesIO()
        rows = pdf.sort_values("ord")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            stamp = lambda name: zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))  # noqa: E731  equal books have equal bytes
            z.writestr(stamp("mimetype"), "application/epub+zip")
            z.writestr(stamp("META-INF/container.xml"), '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
            items = "".join(f'<item id="c{i}" href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(rows)))
            spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(rows)))
            z.writestr(stamp("OEBPS/content.opf"), f'<package><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine>{spine}</spine></package>')
            points = "".join(f'<navPoint><navLabel><text>{html.escape(t)}</text></navLabel><content src="c{i}.xhtml"/></navPoint>' for i, t in enumerate(rows["title"]))
            z.writestr(stamp("OEBPS/toc.ncx"), f"<ncx><navMap>{points}</navMap></ncx>")
            for i, body in enumerate(rows["html"]):
                z.writestr(stamp(f"OEBPS/c{i}.xhtml"), f"<html><body>{body}</body></html>")
        return pd.DataFrame({"path": [key[0]], "content": [out.getvalue()]})

    return chapters_.groupBy("path").applyInPandas(pack, "path string, content binary")
