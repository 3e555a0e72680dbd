"""JSON artifacts, event logs, OCR layouts, word packs; and the library's sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import LEVELS, ascii_lower, lowest_level, trim_ws, user_level
from quire.operators.vocab import valid_word

PACK = "word string, level string, phonetic string, definition string, translation string, tag string, exchange string, root string, collins smallint, oxford smallint, bnc bigint, frq bigint"
EVENTS = "seq bigint, timestamp string, stage string, message string, progress smallint, level string"
LAYOUT = "pages array<struct<page:int,blocks:array<struct<label:string,content:string,bbox:array<int>,`order`:int>>>>"
WORDS, DEFINITION = 800_000, 600


def json_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A required artifact: one JSON value a file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def optional_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The artifact, or no rows if there is none."""
    try:
        return json_artifact(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def event_lines(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """A log of JSON lines. A missing file has no rows; a malformed line is an error."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def ocr_blocks(raw: DataFrame, column: str = "json") -> DataFrame:
    """(page, ord, label, content, bbox) of OCR layouts as JSON, whole or a page a line."""
    value = F.coalesce(F.from_json(column, LAYOUT)["pages"], F.array(F.from_json(column, "page int, blocks array<struct<label:string,content:string,bbox:array<int>,`order`:int>>")))
    pages = raw.select(F.explode(value).alias("p"))
    return pages.select("p.page", F.explode("p.blocks").alias("b")).select("page", F.col("b.order").alias("ord"), "b.label", "b.content", "b.bbox")


# Word packs ----------------------------------------------------------------------------------------


def pack_kind(first_line: str) -> str:
    """json, csv (a dictionary with a header that starts with ``word``) or list."""
    head = first_line.lstrip("\ufeff \t")
    return "json" if head[:1] in "[{" and head else "csv" if head.lower().startswith("word,") else "list"


def import_pack(spark: SparkSession, path: str, default_level: str = "cet4") -> DataFrame:
    """Words of a pack of any of the three formats: (pos, word, rank, definition ...), invalid ones
    left out, at most WORDS."""
    first = spark.read.text(path).filter("trim(value) <> ''").limit(1).collect()
    kind = pack_kind(first[0][0]) if first else "list"
    return {"json": json_pack, "csv": csv_pack, "list": list_pack}[kind](spark, path, default_level)


def _numbered(rows: DataFrame) -> DataFrame:
    """Positions in file order; a pack is at most a few hundred thousand rows."""
    return rows.withColumn("pos", F.monotonically_increasing_id())


def _capped(rows: DataFrame) -> DataFrame:
    return rows.filter(valid_word(F.col("word")) & F.col("rank").isNotNull()).withColumns({"word": trim_ws(F.col("word")), "definition": F.substring(F.coalesce("definition", F.lit("")), 1, DEFINITION)}).orderBy("pos").limit(WORDS)


def json_pack(spark: SparkSession, path: str, default_level: str = "cet4") -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    value = F.coalesce(F.from_json("value", f"words array<struct<{_struct()}>>")["words"], F.from_json("value", f"array<struct<{_struct()}>>"))
    rows = whole.select(F.posexplode(value).alias("pos", "e")).select("pos", "e.*")
    return _capped(rows.withColumn("rank", user_level(F.col("level"))))


def _struct() -> str:
    return ",".join(f"{n}:{t}" for n, t in (x.strip().split(" ") for x in PACK.split(",")))


def csv_pack(spark: SparkSession, path: str, default_level: str = "cet4") -> DataFrame:
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = {c.lower(): c for c in rows.columns}
    get = lambda n: F.col(f"`{have[n]}`") if n in have else F.lit(None).cast("string")
    out = _numbered(rows.select(*[get(n).alias(n) for n in ("word", "phonetic", "definition", "translation", "tag", "exchange", "collins", "oxford", "bnc", "frq")]))
    out = out.withColumns({n: F.coalesce(F.col(n).try_cast("bigint"), F.lit(0)) for n in ("collins", "oxford", "bnc", "frq")})
    return _capped(out.withColumn("rank", lowest_level(F.coalesce("tag", F.lit("")))))


def list_pack(spark: SparkSession, path: str, default_level: str = "cet4") -> DataFrame:
    """Lines of word and definition, parted by the tab, semicolon or comma of the first full line;
    comments and a header on the first line are skipped."""
    rows = _numbered(spark.read.text(path)).filter("trim(value) <> '' AND NOT startswith(ltrim(value), '#')")
    first = rows.orderBy("pos").limit(1).collect()
    sep = next((s for s in "\t;," if first and s in first[0]["value"]), "\t")
    parts = F.split("value", f"[{sep}]", 2)
    out = rows.select("pos", trim_ws(F.get(parts, F.lit(0))).alias("word"), trim_ws(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("definition"))
    head = first[0]["pos"] if first else -1
    out = out.filter((F.col("pos") != head) | ~F.lower("word").isin("word", "words", "单词"))
    return _capped(out.withColumn("rank", F.lit(LEVELS.index(default_level))))


def merged_packs(entries: DataFrame) -> DataFrame:
    """One entry a word from packs in order (pack, pos): the lowest level; definition of the last entry
    that lowered the level and has one, else the first's; other fields of the first."""
    w = Window.partitionBy("key").orderBy("pack", "pos")
    rows = entries.withColumn("key", ascii_lower(F.col("word")))
    before = F.min("rank").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("lowers", before.isNull() | (F.col("rank") < before)).withColumn("place", F.row_number().over(w))
    better = F.col("lowers") & (F.col("definition") != "") & (F.col("place") > 1)
    return rows.groupBy("key").agg(
        F.min_by("word", "place").alias("word"), F.min("rank").alias("rank"),
        F.coalesce(F.max_by(F.when(better, F.col("definition")), F.when(better, F.col("place"))), F.min_by("definition", "place")).alias("definition"),
    )


# Sinks ---------------------------------------------------------------------------------------------


def write_json(df: DataFrame, path: str) -> None:
    """Overwrites an artifact; the commit protocol makes it appear whole or not at all."""
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_checkpoint(df: DataFrame, path: str, run: str) -> None:
    df.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def manifest(files: DataFrame, *task: str) -> DataFrame:
    """One row a task: kinds, paths and bytes of its artifacts."""
    return files.groupBy(*task).agg(F.array_sort(F.collect_list(F.struct("kind", "path", "bytes"))).alias("files"), F.sum("bytes").alias("bytes"))


def anki_lines(cards: DataFrame, front: str, back: str, tags: str) -> DataFrame:
    """Tab-separated cards: tabs and returns become blanks, line ends ``<br>``."""
    clean = lambda c: F.replace(F.translate(F.coalesce(c, F.lit("")), "\t\r", "  "), F.lit("\n"), F.lit("<br>"))
    return cards.select(F.concat_ws("\t", *[clean(F.col(c)) for c in (front, back, tags)]).alias("value"))


def reviewed_markdown(segments: DataFrame, *task: str) -> DataFrame:
    """The reviewed text of each task, a heading where the chapter changes."""
    w = Window.partitionBy(*task).orderBy("ord")
    new = F.col("chapter").isNotNull() & ~F.col("chapter").eqNullSafe(F.lag("chapter").over(w))
    rows = segments.withColumn("part", F.concat(F.when(new, F.concat(F.lit("## "), "chapter", F.lit("\n\n"))).otherwise(""), "target"))
    return rows.groupBy(*task).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "part"))), lambda x: x["part"]), "\n\n").alias("markdown"))


def finalize(frames: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes artifacts in their order and returns the manifest's rows (kind, path)."""
    for kind, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{kind}")
    spark = next(iter(frames.values())).sparkSession
    return spark.createDataFrame([(k, f"{folder}/{k}") for k in frames], "kind string, path string")


def markdown_html(markdown: str) -> str:
    """HTML of simple Markdown: headings, lists, quotes, code, images, paragraphs."""
    import html
    import re

    def inline(t: str) -> str:
        t = html.escape(t, quote=False)
        t = re.sub(r"!\[([^\]]*)\]\(([^)]*)\)", r'<img alt="\1" src="\2">', t)
        t = re.sub(r"\[([^\]]*)\]\(([^)]*)\)", r'<a href="\2">\1</a>', t)
        return re.sub(r"\*([^*]+)\*", r"<em>\1</em>", re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", t))

    out = []
    for block in re.split(r"\n\s*\n", markdown.strip()):
        rows = block.strip().split("\n")
        m = re.match(r"(#{1,6}) (.*)", rows[0])
        if m and len(rows) == 1:
            out.append(f"<h{len(m[1])}>{inline(m[2].rstrip('# '))}</h{len(m[1])}>")
        elif rows[0].startswith("```"):
            out.append("<pre><code>" + html.escape("\n".join(r for r in rows[1:] if not r.startswith("```"))) + "</code></pre>")
        elif all(re.match(r"\s*[-*] ", r) for r in rows):
            out.append("<ul>" + "".join(f"<li>{inline(r.strip()[2:])}</li>" for r in rows) + "</ul>")
        elif all(r.startswith(">") for r in rows):
            out.append("<blockquote>" + inline(" ".join(r.lstrip("> ") for r in rows)) + "</blockquote>")
        elif block.strip():
            out.append("<p>" + inline(" ".join(rows)) + "</p>")
    return "\n".join(out)


def append_wal(events: DataFrame, path: str) -> None:
    """Appends to the write-ahead log; only events of a commit carry their snapshot."""
    committed = F.endswith("stage", F.lit("_committed"))
    events.withColumn("payload", F.when(committed, F.col("payload"))).write.mode("append").json(path)
