"""Literal rows with expected values."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import fuzzy as Z
from quire.functions import segments as G
from quire.functions import text as X
from quire.operators import chunks as C
from quire.operators import glossary as GL
from quire.operators import metrics as M
from quire.operators import vocab as V
from quire.sources import artifacts as S
from quire.sources import books as B


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("word", "has"), [("running", "run"), ("making", "make"), ("cities", "city"), ("wolves", "wolf"), ("bigger", "big"), ("stopped", "stop"), ("happiest", "happy"), ("travelling", "travel"), ("dog's", "dog")]
)
def test_lemmas(spark, word, has):
    assert has in value(spark, X.lemma_candidates(F.lit(word)))


def test_short_words_have_no_lemma(spark):
    assert value(spark, X.lemma_candidates(F.lit("ran"))) == []


def test_tokens(spark):
    got = value(spark, G.english_words(F.lit("It's a well-known fact, isn't it? 'a' --")))
    assert got == ["It's", "well-known", "fact", "isn't", "a"]


def test_capital_phrases(spark):
    got = value(spark, G.capital_phrases(F.lit("labels (Table 1). All types were tested; William Brady, Ziv Epstein replied. New 5 York")))
    assert {"Table", "All", "William Brady", "Ziv Epstein", "New York"} <= set(got) and "All Table" not in got


@pytest.fixture(scope="module")
def dictionary(spark):
    return spark.createDataFrame([("the", 0), ("abandon", 1), ("thing", 0), ("serendipity", 9)], "word string, rank int")


def marks(spark, *words):
    return spark.createDataFrame([(w,) for w in words], "word string")


@pytest.mark.parametrize(
    ("words", "level", "mastered", "learning", "want"),
    [
        (["abandon", "serendipity", "the"], 2, [], [], [("serendipity", 9, "")]),
        (["abandon", "serendipity"], 9, ["serendipity"], ["abandon"], [("abandon", 1, "")]),
        (["abandoned"], 9, [], ["abandon"], [("abandon", 1, "abandoned")]),
        (["zzzqqq"], 0, [], ["zzzqqq"], [("zzzqqq", None, "")]),
        (["abandoned", "Abandoned"], 0, [], [], [("abandon", 1, "abandoned")] * 2),
        (["abandoned"], 0, ["abandon"], ["abandon"], []),
    ],
)
def test_annotate(spark, dictionary, words, level, mastered, learning, want):
    rows = V.annotate(marks(spark, *words), dictionary, level, marks(spark, *mastered), marks(spark, *learning)).collect()
    assert [(r.word, r["rank"], r.surface) for r in rows] == want


def test_word_info(spark, dictionary):
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(["The", "abandon", "ABANDON", "  ", "zzzznotaword"])], "pos int, word string")
    assert [(r.word, r["rank"]) for r in V.word_info(rows, dictionary).orderBy("pos").collect()] == [("the", 0), ("abandon", 1)]


def sm2(spark, *grades):
    rows = spark.createDataFrame([("c", i, q, "2024-01-01 00:00:00") for i, q in enumerate(grades)], "card string, seq int, quality int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    return V.sm2_history(rows, "card").first()


def test_sm2(spark):
    good = sm2(spark, 5, 5)
    assert (good.repetitions, good.interval) == (2, 6.0)
    lost = sm2(spark, 5, 5, 0)
    assert lost.repetitions == 0 and lost.interval < 0.01
    assert 5 * 60 < (lost.due - lost["last"]).total_seconds() < 11 * 60
    assert sm2(spark, 5, 5, 5).interval > 6 and sm2(spark, *[0] * 20).ease == pytest.approx(1.3)
    hard, easy = sm2(spark, 3, 3, 3), sm2(spark, 5, 5, 5)
    assert hard.interval < easy.interval and hard.ease < easy.ease


def test_seeds_are_idempotent(spark):
    cards = spark.createDataFrame([("b", "abandon")], "book string, word string")
    seeds = spark.createDataFrame([("b", "Abandon", "c", "1", 0), ("b", "serendipity", "c", "1", 1), ("b", " ", "c", "1", 2), ("b", "Serendipity", "d", "1", 3)], "book string, word string, context string, chapter string, pos int")
    added = V.seed_cards(cards, seeds)
    assert [(r.word, r.context) for r in added.collect()] == [("serendipity", "c")]
    assert V.seed_cards(cards.union(added.select("book", "word")), seeds).count() == 0
    assert V.seed_cards(cards, seeds, capacity=1).count() == 0


def test_retention_keeps_stale_rows_behind_fresh_ones(spark):
    rows = spark.createDataFrame([("b", i, t) for i, t in enumerate(["2023-01-01", "2024-01-20", "2023-02-01"])], "book string, seq int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.seq for r in V.trim_log(rows, "2024-01-31 00:00:00", 90).collect()) == [1, 2]


def test_quotes(spark):
    assert value(spark, C.quote_imbalance(F.lit("“没错。”她抬起下巴。你在找。”"))) and not value(spark, C.quote_imbalance(F.lit("“a”")))
    fixed = value(spark, X.repair_quote(F.lit("“Please don’t go.”"), F.lit("“请别走")))
    assert (fixed.text, fixed.repairs) == ("“请别走”", 1)
    assert value(spark, X.repair_quote(F.lit("no quote"), F.lit("“请别走"))).repairs == 0


def test_numbers(spark):
    assert value(spark, C.missing_numbers(F.lit("12% of 34 in 1999"), F.lit("34"))) == ["12"]
    assert value(spark, X.numbers(F.lit("1999.5 and 7 and 12%的 12章"))) == ["1999.5", "12%"]


def test_review_rules(spark):
    rows = spark.createDataFrame([("b1", "text", ""), ("b2", "3 points", "4 分"), ("b3", "a\nb", "译文")], "id string, source string, target string")
    assert {(r.id, r.rule) for r in C.review_checks(rows, "id").collect()} == {("b1", "untranslated"), ("b2", "digits"), ("b3", "newlines")}


def test_first_seen(spark):
    rows = spark.createDataFrame([("t", 0, 0, "Alice Johnson", "爱丽丝"), ("t", 1, 0, "alice johnson", "艾丽斯"), ("t", 1, 1, "Bob", "鲍勃")], "task string, chunk int, pos int, source string, translation string")
    assert {(r.chunk, r.pos): r.anchor for r in GL.first_seen(rows, "task").collect()} == {(0, 0): "爱丽丝", (1, 0): "爱丽丝", (1, 1): "鲍勃"}


def test_heading_path_stacks(spark):
    parts = F.array(*[F.lit(x) for x in ("# A", "### B", "### C", "text", "## D")])
    assert value(spark, G.heading_paths(parts)) == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "B", "C"], ["A", "D"]]


def test_packed_lines(spark):
    got = value(spark, G.pack_lines(F.lit("aaaa\nbbbb\n![](i.png)\ncccc\n<!-- x:pdf-table:start -->\n| a |\n<!-- x:pdf-table:end -->\ndd"), 8))
    assert got == ["aaaa\n", "bbbb\n", "![](i.png)\n", "cccc\n", "<!-- x:pdf-table:start -->\n| a |\n<!-- x:pdf-table:end -->\n", "dd\n"]


def test_contracts(spark):
    log = spark.createDataFrame([("t", 0, "queued", 5), ("t", 1, "translating", 40), ("t", 2, "x", 30)], "task string, seq int, stage string, progress int")
    r = C.log_contract(log, ["queued", "translating", "finalized"], "task").first()
    assert (r.drops, r.starts_queued, r.missing) == (1, True, "finalized")
    gap = spark.createDataFrame([("t", 0), ("t", 2)], "task string, idx int")
    assert not C.contiguous(gap, "task").first().contiguous


def test_health_and_cost(spark):
    assert value(spark, M.route_health(F.lit(0), F.lit(3), F.lit(0))) == 1.0
    assert value(spark, M.route_health(F.lit(1), F.lit(100), F.lit(0))) == 0.05
    assert value(spark, M.cost_usd(F.lit(1e6), F.lit(1e6), F.lit(1e6), F.lit(1))) == pytest.approx(0.448)
    assert value(spark, M.cost_usd(F.lit(1), F.lit(1), F.lit(1), F.lit(0))) is None


def test_mojibake(spark):
    assert value(spark, X.mojibake(F.lit("bad � char"))).polluted and not value(spark, X.mojibake(F.lit("�"))).polluted
    assert value(spark, X.mojibake(F.lit("€™█ x"))).polluted and not value(spark, X.mojibake(F.lit("clean text"))).polluted


def test_merged_packs(spark):
    rows = spark.createDataFrame([("a", 0, "abandon", 9, "GRE 释义"), ("b", 0, "Abandon", 1, ""), ("b", 1, "zeal", 5, "z")], "pack string, pos int, word string, rank int, definition string")
    got = {r.key: (r.word, r["rank"], r.definition) for r in S.merged_packs(rows).collect()}
    assert got == {"abandon": ("abandon", 1, "GRE 释义"), "zeal": ("zeal", 5, "z")}


@pytest.mark.parametrize(("line", "kind"), [("[{}", "json"), ("word,phonetic,definition", "csv"), ("bare", "list"), ("", "list")])
def test_pack_kind(line, kind):
    assert S.pack_kind(line) == kind


def test_glossary_overlay(spark):
    entries = spark.createDataFrame([("Hero", "英雄", 3, "static"), ("Old", "旧", 1, "static")], "source string, translation string, occurrences long, origin string")
    over = spark.createDataFrame([("hero", "勇者", None), ("New", "新", "old"), ("Extra", "额外", None)], "source string, translation string, rename_from string")
    got = {(r.source, r.translation, r.origin) for r in GL.overlay(entries, over).collect()}
    assert got == {("Hero", "勇者", "static"), ("New", "新", "user"), ("Extra", "额外", "user")}


def epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        z.writestr(
            "OEBPS/c.opf",
            '<package><manifest><item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="a.html"/><item id="b" href="t/b.html"/><item id="e" href="e.html"/></manifest>'
            '<spine><itemref idref="a"/><itemref idref="e"/><itemref idref="b"/></spine></package>',
        )
        z.writestr("OEBPS/toc.ncx", '<ncx><navMap><navPoint><navLabel><text>First</text></navLabel><content src="a.html#x"/></navPoint></navMap></ncx>')
        z.writestr("OEBPS/a.html", "<html><body><h1>Other</h1><p>Hello <b>you</b></p><ul><li>one</li></ul></body></html>")
        z.writestr("OEBPS/e.html", "<html><body>  </body></html>")
        z.writestr("OEBPS/t/b.html", "<html><head><title>Head</title></head><body><p>Text</p></body></html>")
    return out.getvalue()


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>')
        z.writestr(
            "word/document.xml",
            f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="H2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>'
            "<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t><w:tab/><w:t>x</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p></w:body></w:document>",
        )
    return out.getvalue()


def test_books(spark, tmp_path):
    (tmp_path / "x.epub").write_bytes(epub())
    (tmp_path / "y.docx").write_bytes(docx())
    found = B.files(spark, str(tmp_path))
    chapters = B.epub_chapters(found.filter("kind = 'Epub'")).orderBy("ord").collect()
    assert [(c.title, c.title_source) for c in chapters] == [("First", "EpubNcx"), ("Head", "EpubHtmlTitle")]
    blocks = B.epub_blocks(found.filter("kind = 'Epub'"))
    assert [(b.kind, b.text) for b in blocks.orderBy("chapter", "ord").collect()] == [("heading", "Other"), ("paragraph", "Hello you"), ("listItem", "one"), ("paragraph", "Text")]
    assert B.epub_probe(blocks).first().paragraphs == 2
    assert B.docx_texts(found.filter("kind = 'Docx'")).first().text == "## Title\n\n- item x"
    assert B.bundle_files(found.filter("kind = 'Docx'")).count() == 2


def test_fuzzy():
    assert Z.fnv1a64("a") == "af63dc4c8601ec8c" and Z.lcs_length("kitten", "sitting") == 4
    assert Z.match_level("Johnson", "Jonson") == "High" and Z.match_level("Anna", "Zorro") == "None" and Z.match_level("R-D", "RD") == "Exact"
    assert Z.mentions("He met Alice Jonson.", "Alice Johnson") and not Z.mentions("He met Bob.", "Alice Johnson")
    assert Z.repair_chapter_heading("Book Two Chapter 3: 名字") == "第二卷 第三章：名字" and Z.repair_chapter_heading("Chapter 3: Name") == "Chapter 3: Name"
    assert Z.toc_title("Chapter 3: X", "第三章 开始") == "第3章：开始" and Z.toc_title("Chapter 2", "第2章：") == "第2章"
    assert [Z.long_chinese(n) for n in (10, 19, 101, 1001, 1010, 0, 10_000)] == ["十", "十九", "一百零一", "一千零一", "一千零一十", None, None]
    assert Z.chinese_value("三千二百") == 3200 and Z.chinese_value("百") == 100 and Z.chinese_value("九九") == 99 and Z.chinese_value("x") is None
    assert all(len(x.encode()) <= 1800 for x in Z.speech_chunks("你好。" * 700)) and "".join(Z.speech_chunks("你好。" * 700)) == "你好。" * 700
    assert Z.json_object('x {"a": 1} {"translatedText": "b } c"} y') == '{"translatedText": "b } c"}'
    masked = Z.mask("see `code` http://x.y/z (Smith 2001) end")
    assert "code" not in masked and "Smith" not in masked and masked.startswith("see") and masked.endswith("end")
    assert Z.densest_block("<div>short</div><section><div>" + "x" * 500 + "</div></section>").startswith("<section>")
    assert "menu" not in Z.without_boilerplate('<nav class="m">menu</nav><p>text</p><div class="sharedaddy"><div>a</div>b</div>')
    assert Z.source_residual("他去了 Hogwarts 城堡", "Hogwarts", "霍格沃茨") == "Hogwarts"


def test_numerals(spark):
    assert [value(spark, X.chinese_numeral_long(F.lit(n))) for n in (10, 101, 1001, 1010, 2345)] == ["十", "一百零一", "一千零一", "一千零一十", "二千三百四十五"]
    assert [value(spark, X.chinese_value(F.lit(t))) for t in ("三千二百", "百", "九九", "第十")] == [3200, 100, 99, None]
    assert value(spark, X.english_number(F.lit("XII"))) == 12


def test_word_packs(spark, tmp_path):
    (tmp_path / "l.txt").write_text("word;meaning\ngood;ok\nbad word;x\n3d;y\n--;z\nokay-ish;w\n")
    assert [r.word for r in S.import_pack(spark, str(tmp_path / "l.txt")).collect()] == ["good", "okay-ish"]
    with pytest.raises(Exception):
        (tmp_path / "e.json").write_text('{"seq": 1}\nnot json\n')
        S.event_lines(spark, str(tmp_path / "e.json")).collect()
    assert S.event_lines(spark, str(tmp_path / "none.json")).count() == 0


def test_every_hint_has_a_place(spark, sf_dir):
    from quire import registry

    rows = registry.queries()["srt06_hint_places"](spark, sf_dir).collect()
    assert len(rows) > 100 and sorted(r.place for r in rows) == list(range(1, len(rows) + 1))
    first = registry.queries()["srt06_hint_order"](spark, sf_dir).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.place)] == [r.id for r in first]


def test_page_furniture_is_matched_by_whole_names(spark):
    from quire.functions import fuzzy, text

    page = '<div class="pagination wide">gone</div><p class="unshared-pagination-note">Keep</p><p id="sr-only">gone</p><p class=\'post-nav-title x\'>Keep too</p>'
    assert fuzzy.without_boilerplate(page) == '<p class="unshared-pagination-note">Keep</p><p class=\'post-nav-title x\'>Keep too</p>'
    rows = [("div", 'class="a sharedaddy"'), ("div", 'class="sharedaddy-not"'), ("p", "id='addtoany'"), ("footer", ""), ("nav", "epub:type='toc'"), ("p", "")]
    d = spark.createDataFrame(rows, "name string, attrs string")
    assert [r.b for r in d.select(text.is_boilerplate(F.col("name"), F.col("attrs")).alias("b")).collect()] == [True, False, True, True, False, False]


def test_match_levels_by_keys():
    from quire.functions.fuzzy import match_level

    for a, b, want in [("Ann Lee", "ann-lee", "Exact"), ("Ann", "Ann Lee", "Contains"), ("Kallisto", "Kalliste", "High"), ("Kallister", "Kalloster X", "Low"), ("cat", "dog", "None"), ("", "", "Exact"), ("日本", "日本", "Exact"), ("日本", "中国", "None")]:
        assert match_level(a, b) == match_level(b, a) == want, (a, b)


def test_synthesized_terms_see_each_other(spark):
    from quire.operators import glossary as G

    hits = spark.createDataFrame([(1, 0, 0, "Ann  Lee", "A"), (1, 0, 1, "ann lee", "B"), (1, 0, 2, "Bo", "B"), (1, 0, 3, "Cy", "C"), (1, 0, 4, "Di", "gone"), (1, 1, 0, "Bo", "B")], "task int, idx int, ord int, source string, target string")
    own = spark.createDataFrame([(1, 0, "A B C"), (1, 1, None)], "task int, idx int, translated string")
    confirmed = spark.createDataFrame([(1, 0, "x", " C ")], "task int, idx int, source string, translation string")
    rows = G.synthesized(hits, own, confirmed, "task").collect()
    assert sorted((r.idx, r.source, r.target, r.confidence) for r in rows) == [(0, "Ann  Lee", "A", 100), (0, "Bo", "B", 100)]


def test_resume_needs_the_same_prompt_and_chunk_size(spark):
    from quire.operators import chunks as C

    kind = "task int, source_hash string, chunk_size int, prompt_hash string"
    saved = spark.createDataFrame([(1, "a", 9, "p"), (2, "a", 9, "p"), (3, "a", 9, "p"), (4, "a", 8, "p"), (5, "a", 9, " ")], kind)
    now = spark.createDataFrame([(1, "a", 9, "p"), (2, "b", 9, "p"), (3, "b", 9, "p"), (4, "a", 9, "p"), (5, "a", 9, " ")], kind)
    matching = spark.createDataFrame([(2, True), (3, False)], "task int, match boolean")
    assert {r.task: r.gate for r in C.resume_gate(saved, now, matching, "task").collect()} == {1: "ExactSourceHash", 2: "MatchingTranslatedSources", 3: None, 4: None, 5: None}
