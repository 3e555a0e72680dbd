"""Queries against their SQL on rows that the smallest tables do not hold."""

import re

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from quire import registry
from quire.functions import fuzzy as Z
from quire.functions import text as X
from quire.operators import align as A
from quire.operators import glossary as GL
from quire.operators import vocab as V
from quire.plans.standins import staged_tokens
from quire.sources import books as B
from quire.streaming import state as T


def both(spark, folder, name, **tables):
    """The query's rows and those of its SQL over tables, each a DataFrame."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    cur = con.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    rows = [tuple(r) for r in registry.queries()[name](spark, str(folder)).select(*cols).collect()]
    return sorted(rows, key=str), sorted(cur.fetchall(), key=str)


def test_unique_lines_keep_their_digits(spark, tmp_path):
    texts = ["0 a\n1 b 1\n1 b 1\n22", "  x \nx\n\tx\n x　\n x\r", "", " \n ", "10\n10\n01"]
    got, want = both(spark, tmp_path, "set17_unique", documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got == want and got[0][1] == "0 a|1 b 1|22"


def test_pages_with_broken_references(spark, tmp_path):
    pages = ["<h1>A &amp; B&amp</h1><p>&amp;lt; &lt;b&gt; &quo &copy &copy; &ampfoo; &#39;s &quot;</p>", "<body>C&amp D&am</body>", "<article><h2>&amp</h2><li>&nbsp</li><td>&nbsp;</td></article>"]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    for name in ("src22_page_markdown", "chk22_html_blocks"):
        got, want = both(spark, tmp_path / name, name, pages=rows)
        assert got == want
    assert Z.unescape("&eacute;&#233;&#xE9;&eacute &nosuch;") == "ééé&eacute &nosuch;"


def test_capitals_one_for_one(spark, tmp_path):
    letters = "".join(chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000)
    assert duckdb.execute("SELECT upper(?)", [letters]).fetchone()[0] == Z.upper(letters)
    turns = [(7 * k + 1, turn, role, f"{k} straße ﬁn ᾳ ŉ é") for k in range(3) for turn, role in enumerate(["user", "assistant"] * 7)]
    got, want = both(spark, tmp_path, "str01_schedule", conversations=spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert got == want and any("STRAẞE" in r[2] for r in got)


def test_long_texts_are_taken_in_pieces(spark):
    text = "<p>" + "long " * 2000 + "</p>"
    rows = [None if i == 7 else f"{i} {text}" for i in range(2000)]
    seen, blocks = [], pa.list_(pa.struct([("ord", pa.int32()), ("kind", pa.string()), ("text", pa.string())]))
    sizes = [(len(x), x.nbytes) for x in Z.in_pieces(lambda t: seen.append(t) or Z.html_blocks(t), blocks, iter([(pa.array(rows),), (pa.array([], pa.string()),)]))]
    assert sum(n for n, _ in sizes) == 2000 and len(seen) == 1999 and len(sizes) > 5 and max(b for _, b in sizes) < Z.SENT + 2 * Z.PIECE
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, t string").coalesce(1)
    got = df.select("i", Z.column(lambda t: t[:6], "string")("t").alias("a"), Z.column(lambda a, b: {"n": len(a), "same": a == b}, "struct<n:int,same:boolean>")("t", "t").alias("b")).collect()
    assert [(r.i, r.a, r.b and tuple(r.b)) for r in got] == [(i, t and t[:6], t and (len(t), True)) for i, t in enumerate(rows)]


def test_files_of_an_archive_leave_in_portions():
    class Frame:
        select = lambda self, *_: self
        mapInArrow = lambda self, read, kind: read

    batch = pa.RecordBatch.from_pylist([{"path": str(i), "content": b"x"} for i in range(5)])
    rows = lambda path, content: ({"path": path, "name": str(k), "content": bytes(B.SENT // 4)} for k in range(10))
    sent = [(b.num_rows, b.nbytes) for b in B.of_each(Frame(), "path string, name string, content binary", rows)([batch, batch])]
    assert sum(n for n, _ in sent) == 100 and max(size for _, size in sent) < 2 * B.SENT


def test_reviews_of_several_waves_are_folded_onto_the_cards(spark, tmp_path):
    rows = [((None, 1, 2)[i % 3], f"w{i % 7}", i, i * i * 5 % 7) for i in range(400)]
    kind = "book long, word string, seq long, quality long"
    for k in range(4):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/reviews.parquet")
    cards = T.sm2_cards(T.table_stream(spark, str(tmp_path), "reviews", bytes_a_batch=1))
    whole = V.sm2_history(spark.createDataFrame(rows, kind).withColumn("ts", F.lit("2024-01-01")), "book", "word")
    get = lambda df: sorted(map(str, df.select("book", "word", "reviews", "repetitions", "interval", "ease").collect()))
    assert get(cards) == get(whole) and len(get(cards)) == 21
    assert "Python" not in cards._jdf.queryExecution().toString()


def test_first_delta_terms_are_those_of_all_delta_terms(spark):
    rows = [(i % 3, i * 7 % 60, i % 4, f"{'Tt'[i % 2]}erm {i % 5}") for i in range(300)] + [(9, 1, 1, "x")]
    terms = spark.createDataFrame(rows, "task int, seq int, chunk int, source string")
    chunks = spark.createDataFrame([(t, c, 13 * c, 10 * (t % 2)) for t in range(4) for c in range(5)], "task int, idx int, started int, patched int")
    first = GL.first_delta_terms(terms, chunks, "task")
    want = GL.first_per(GL.delta_terms(terms, chunks, "task"), X.ascii_lower(F.col("source")), ["seq", "source"], "task", "idx")
    assert sorted(first.select(*want.columns).collect()) == sorted(want.collect()) and want.count() > 20


def test_clusters_send_no_items_through_the_driver(spark, monkeypatch):
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or write(self, *a, **b))
    items = spark.createDataFrame([(i, [f"p{i}", f"p{i + (i % 5 < 4)}"]) for i in range(40)], "id long, parts array<string>")
    got = {r.id: r.cluster for r in A.clusters(items).collect()}
    assert got == {i: i // 5 * 5 for i in range(40)}
    assert plans and not any("Broadcast" in p for p in plans)


def test_words_of_odd_documents(spark, tmp_path):
    texts = ["'a' -- It's --well-known-- ab 'ab' x-y --- ''' éABC Tess'", "", "Running ran RUNS wolves don't.  Yes!?　 No。a", "Wolf run runs the the The sitting sit sits"] * 2
    docs = spark.createDataFrame([(i % 7, ("en", "de")[i % 2], t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    for name in ("jn02_annotate", "jn04_difficult_words", "jn05_word_info", "chk25_lookup_tokens", "set15_book_seeds", "chk08_sentences"):
        got, want = both(spark, tmp_path / name, name, documents=docs)
        assert list(map(str, got)) == list(map(str, want)), name


def test_words_are_not_stored_one_by_one(spark, tmp_path):
    docs = spark.createDataFrame([(i, "en", "same words again and again " * 50) for i in range(20)], "doc_id long, lang string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert (staged_tokens(spark, str(tmp_path), "lang").count(), staged_tokens(spark, str(tmp_path), "doc_id").count()) == (4, 80)
    plan = registry.queries()["chk25_lookup_tokens"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == plan.count("hashpartitioning(doc_id") == 1


def test_trims_take_all_blanks(spark):
    blank = [chr(c) for c in range(1, 0x3100) if re.match(X.WS, chr(c), re.ASCII)]
    df = spark.createDataFrame([(f"{b}a{b}b{b}{b}",) for b in blank], "t string").select(X.trim_ws(F.col("t")), X.trim_start(F.col("t")), X.trim_end(F.col("t")))
    assert sorted(map(tuple, df.collect())) == sorted((f"a{b}b", f"a{b}b{b}{b}", f"{b}a{b}b") for b in blank) and set(blank) == set(X.BLANKS)
