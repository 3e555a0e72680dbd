"""Blocks and their alignment, first-seen terms, hints, waves and plug points for translators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import fuzzy
from quire.functions.segments import blocks, capital_phrases, distinctive_tokens, heading_paths, pack_lines, reference_start
from quire.functions.text import ascii_lower, block_kind, canonical_phrase, is_noise_phrase, keep_proper_noun, lint_style_rule, plain_text, replace_terms, similarity, term_key, trim_ws


# Chunking ------------------------------------------------------------------------------------------


def reference_aware(docs: DataFrame, column: str, limit: int, *key: str) -> DataFrame:
    """(*key, part, ord, chunk): body, references and tail packed apart; the tail begins at the first
    heading behind the references that is no reference heading."""
    from quire.functions.segments import reference_tail

    text = F.col(column)
    start = reference_start(text)
    lines = F.split(text, "\n")
    head = F.aggregate(lines, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), lambda a, x: F.struct((a["at"] + F.octet_length(x) + 1).alias("at"), (a["n"] + (a["at"] < start).cast("int")).alias("n")))["n"]
    rows = docs.select(*key, text.alias("t"), start.alias("start"), head.alias("head"), lines.alias("l"))
    rest = reference_tail(F.array_join(F.slice("l", F.col("head") + 1, F.size("l")), "\n"))
    body = F.when(F.col("start").isNull(), F.col("t")).otherwise(F.array_join(F.slice("l", F.lit(1), F.col("head")), "\n"))
    none = F.col("start").isNull()
    parts = F.array(
        F.struct(F.lit("body").alias("part"), body.alias("t")), F.struct(F.lit("references").alias("part"), F.when(none, "").otherwise(rest["references"]).alias("t")), F.struct(F.lit("tail").alias("part"), F.when(none, "").otherwise(rest["tail"]).alias("t"))
    )
    return rows.select(*key, F.explode(parts).alias("p")).select(*key, "p.part", F.posexplode(pack_lines(F.col("p.t"), limit)).alias("ord", "chunk"))


def academic_parts(docs: DataFrame, column: str, limit: int, *key: str) -> DataFrame:
    """(*key, part, ord, chunk): opening blocks of addresses and correspondence are metadata, apart
    from the body."""
    meta = lambda b: F.regexp_like(b, F.lit(r"(?i)@|department of |university of |corresponding authors?:|^#+ addresses")) & (F.length(b) < 400)
    parts = F.transform(blocks(F.col(column)), lambda b: F.struct(F.when(meta(b), "metadata").otherwise("body").alias("part"), b.alias("b")))
    joined = lambda part: F.array_join(F.transform(F.filter("parts", lambda p: p["part"] == part), lambda p: p["b"]), "\n\n")
    rows = docs.select(*key, parts.alias("parts"))
    two = F.array(*[F.struct(F.lit(p).alias("part"), joined(p).alias("t")) for p in ("metadata", "body")])
    return rows.select(*key, F.explode(two).alias("p")).select(*key, "p.part", F.posexplode(pack_lines(F.col("p.t"), limit)).alias("ord", "chunk"))


def source_blocks(docs: DataFrame, column: str, *key: str) -> DataFrame:
    """(*key, ord, kind, markdown, text, translate, heading_path, chapter)."""
    rows = docs.select(*key, blocks(F.col(column)).alias("b"))
    rows = rows.select(*key, F.posexplode(F.arrays_zip(F.col("b").alias("b"), heading_paths(F.col("b")).alias("p"))).alias("ord", "z"))
    md = F.col("z.b")
    return rows.select(*key, F.col("ord").cast("long").alias("ord"), block_kind(md).alias("kind"), md.alias("markdown"), plain_text(md).alias("text"), (~block_kind(md).isin("image", "code")).alias("translate"), F.col("z.p").alias("heading_path"), F.get(F.reverse("z.p"), F.lit(0)).alias("chapter"))


# Alignment -----------------------------------------------------------------------------------------


def by_ordinal(source: DataFrame, target: DataFrame, *key: str) -> DataFrame:
    """Blocks of a chunk paired by place; what the target has beyond the source's last goes to it."""
    n = source.groupBy(*key).agg((F.max("ord")).alias("last"))
    t = target.join(n, list(key)).withColumn("ord", F.least("ord", "last")).groupBy(*key, "ord").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("target"))
    return source.join(t, [*key, "ord"], "left")


def unique_anchors(source: DataFrame, target: DataFrame, *key: str) -> DataFrame:
    """(*key, s, t, score): pairs of blocks that share distinctive words, the only best of each source;
    one shared word is enough if it has eight characters. Words join blocks; no pairs are formed else."""
    words = lambda df, name: df.select(*key, F.col("ord").alias(name), F.explode(distinctive_tokens(F.col("text"))).alias("w"))
    hits = words(source, "s").join(words(target, "t"), [*key, "w"]).groupBy(*key, "s", "t").agg(F.count(F.lit(1)).alias("score"), F.max(F.length("w")).alias("longest"))
    hits = hits.filter((F.col("score") >= 2) | (F.col("longest") >= 8))
    best = hits.groupBy(*key, "s").agg(F.max("score").alias("score"))
    top = hits.join(best, [*key, "s", "score"])
    return top.groupBy(*key, "s").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t"), F.first("score").alias("score")).filter("n = 1").select(*key, "s", "t", "score")


def aligned(source: DataFrame, target: DataFrame, *key: str, window: int = 2) -> DataFrame:
    """(*key, ord, target): for each source block the target's place: in proportion, then moved to an
    anchor, then to the best scored block within the window, if strictly better."""

    def align(left, right):
        import pandas as pd

        a, b = left.sort_values("ord"), right.sort_values("ord")
        if not len(a):
            return pd.DataFrame({**{k: [] for k in key}, "ord": [], "target": []})
        texts, kinds = b["text"].tolist(), b["kind"].tolist()
        n = max(len(b), 1)
        tokens = lambda t: {w.strip("'.-").lower() for w in re.findall(r"[A-Za-z0-9.'-]{4,}", t)}
        own = [tokens(t) for t in texts]
        out = []
        for i, (text, kind) in enumerate(zip(a["text"], a["kind"], strict=True)):
            at = min(i * n // max(len(a), 1), n - 1)
            shared = [len(tokens(text) & o) for o in own]
            if shared and max(shared) >= 2 and shared.count(max(shared)) == 1:
                at = shared.index(max(shared))
            score = lambda j: fuzzy.alignment_score(kind, text, f"{kinds[j]}\x1f{texts[j]}") if texts else 0  # noqa: B023, E731
            for j in range(max(0, at - window), min(n, at + window + 1)):
                if texts and score(j) > score(at):
                    at = j
            out.append(at)
        return pd.DataFrame({**{k: [a[k].iloc[0]] * len(a) for k in key}, "ord": a["ord"].tolist(), "target": out})

    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in (*key, "ord")) + ", target long"
    return source.groupBy(*key).cogroup(target.groupBy(*key)).applyInPandas(align, schema)


def heading_sequence(source: DataFrame, target: DataFrame, *key: str) -> DataFrame:
    """(*key, s, t): headings paired in order where both sides have as many, else by unique anchors."""
    count = lambda df, n: df.groupBy(*key).agg(F.count(F.lit(1)).alias(n))
    even = count(source, "a").join(count(target, "b"), list(key)).filter("a = b").select(*key)
    place = Window.partitionBy(*key).orderBy("ord")
    numbered = lambda df, name: df.withColumn("i", F.row_number().over(place)).select(*key, "i", F.col("ord").alias(name))
    straight = numbered(source, "s").join(numbered(target, "t"), [*key, "i"]).join(even, list(key), "left_semi").select(*key, "s", "t")
    rest = unique_anchors(source, target, *key).join(even, list(key), "left_anti").select(*key, "s", "t")
    return straight.unionByName(rest)


# Terms ---------------------------------------------------------------------------------------------


def locked(terms: DataFrame, *by: str) -> DataFrame:
    """(*by, key, target): the translation with which each term was first confirmed."""
    return terms.withColumn("key", term_key(F.col("source"))).groupBy(*by, "key").agg(F.min_by("translation", F.struct("chunk", "source", "translation")).alias("target"))


def pruned(hints: DataFrame, confirmed: DataFrame, *by: str) -> DataFrame:
    """Hints that no confirmed term covers, by key."""
    k = confirmed.select(*by, term_key(F.col("source")).alias("_k")).distinct()
    rows = hints.withColumn("_k", term_key(F.col("source")))
    return rows.join(k, [*by, "_k"], "left_anti").drop("_k")


def merged_neighbours(plans: DataFrame, *by: str) -> DataFrame:
    """Every plan joined with the next: excerpts with a blank line, terms united."""
    w = Window.partitionBy(*by).orderBy("idx")
    nxt, more = F.lead("excerpt").over(w), F.lead("terms").over(w)
    return plans.select(*by, "idx", F.concat_ws("\n\n", "excerpt", nxt).alias("excerpt"), F.when(more.isNull(), F.array_distinct("terms")).otherwise(F.array_union("terms", more)).alias("terms"))


def cleaned_terms(terms: DataFrame, *by: str) -> DataFrame:
    """Trimmed terms, without blank and untranslated ones, confidence to 100, each once."""
    rows = terms.withColumns({"source": trim_ws(F.col("source")), "translation": trim_ws(F.col("translation")), "confidence": F.least("confidence", F.lit(100))})
    rows = rows.filter((F.col("source") != "") & (F.col("translation") != "") & (F.col("source") != F.col("translation"))).withColumn("k", ascii_lower(F.col("source")))
    return rows.groupBy(*by, "k", "translation").agg(F.min_by(F.struct("source", "confidence"), F.struct("pos", "confidence", "source")).alias("f")).select(*by, "f.source", "translation", "f.confidence")


def anchoring_summary(terms: DataFrame, *by: str) -> DataFrame:
    from .glossary import first_seen

    rows = first_seen(terms, *by)
    return rows.groupBy(*by).agg(F.countDistinct("key").alias("anchored"), F.countDistinct(F.when(F.col("translation") != F.col("anchor"), F.col("chunk"))).alias("repaired_chunks"))


def potential_variants(chunks: DataFrame, hints: list[str], *by: str, least: float = 0.82) -> DataFrame:
    """How many capitalised phrases resemble a hint without being it. hints: a handful of names."""
    phrases = chunks.select(*by, F.explode(capital_phrases(F.col("source"))).alias("p"))
    near = F.lit(False)
    for h in hints:
        near = near | ((F.col("p") != h) & (similarity(F.col("p"), F.lit(h)) >= least))
    return phrases.groupBy(*by).agg(F.count_if(near).alias("variants"))


def hint_build(chunks: DataFrame, *by: str) -> DataFrame:
    """Proper nouns worth a hint: (*by, phrase, occurrences, first_chunk, chunks)."""
    rows = chunks.select(*by, "idx", F.explode(capital_phrases(F.col("source"))).alias("p")).withColumn("phrase", canonical_phrase(F.col("p"))).filter(~is_noise_phrase(F.col("phrase")))
    sums = rows.groupBy(*by, "phrase").agg(F.count(F.lit(1)).alias("occurrences"), F.min("idx").alias("first_chunk"), F.array_sort(F.collect_set("idx")).alias("chunks"))
    return sums.filter(keep_proper_noun(F.col("phrase"), F.col("occurrences"), F.lit(0), F.lit(False)))


def running_titles(chunks: DataFrame, *by: str, least: int = 3) -> DataFrame:
    """Title-like lines that stand in several chunks."""
    lines = chunks.select(*by, "idx", F.explode(F.split("text", "\n")).alias("l")).select(*by, "idx", trim_ws(F.col("l")).alias("title"))
    rows = lines.filter(F.regexp_like("title", F.lit("^[A-Z][^.!?;:]{2,59}$")))
    return rows.groupBy(*by, "title").agg(F.countDistinct("idx").alias("chunks")).filter(F.col("chunks") >= least)


def clusters(items: DataFrame) -> DataFrame:
    """(id, cluster): items that share a part, directly or through others; the least id names them.
    Labels spread from items to parts and back until nothing changes, so no pairs are formed. Each round is
    stored, which cuts its lineage; items are joined by sorting, as a broadcast of them would go through the driver."""
    from quire.streaming.state import shared_folder

    spark = items.sparkSession
    held = items.select("id", F.explode("parts").alias("part")).distinct()
    label = items.select("id", F.col("id").alias("cluster"))
    while True:
        by_part = held.join(label.hint("merge"), "id").groupBy("part").agg(F.min("cluster").alias("c"))
        new = held.join(by_part.hint("merge"), "part").groupBy("id").agg(F.min("c").alias("c"))
        step, path = label.hint("merge").join(new.hint("merge"), "id", "left").select("id", F.coalesce("c", "cluster").alias("new"), "cluster"), shared_folder(spark)
        step.write.parquet(path)
        step = spark.read.schema(step.schema).parquet(path)
        label = step.select("id", F.col("new").alias("cluster"))
        if step.filter("new <> cluster").isEmpty():
            return label


# Scheduling and plug points ------------------------------------------------------------------------


def waves(log: DataFrame, size: int, *by: str) -> DataFrame:
    return log.withColumn("wave", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy("seq")) - 1) / size))


def flushes(log: DataFrame, *by: str) -> DataFrame:
    """Whether each write flushes: every write at first, every second from the third, every fourth from
    the twentieth on."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy("seq"))
    rows = log.withColumn("n", n)
    every = F.when(F.col("n") < 3, 1).when(F.col("n") < 20, 2).otherwise(4)
    return rows.withColumn("flush", (F.col("n") % every == 0).cast("long"))


def translate(chunks: DataFrame, translator: Callable[[list[str]], list[str]]) -> DataFrame:
    """Pending chunks through a translator of batches of texts. A chunk whose translator fails is marked
    and stays; the others go on."""

    def attempt(texts: list[str]) -> list[str] | None:
        try:
            out = translator(texts)
        except Exception:  # the translator is foreign code: its failure is a row's state
            return None
        return out if len(out) == len(texts) else None

    def run(batches):
        for pdf in batches:
            texts = pdf["source"].tolist()
            done = attempt(texts)
            if done is None:  # find the texts that fail by themselves
                done = [(attempt([t]) or [None])[0] for t in texts]
            yield pdf.assign(translated=done, stage=["translationFailed" if t is None else "translated" for t in done])

    return chunks.mapInPandas(run, chunks.schema)


def patched(chunks: DataFrame, terms: list[dict]) -> DataFrame:
    """Terms that came late put into finished translations; ``patched`` tells where that changed any."""
    rows = chunks.withColumn("new", replace_terms(F.col("translated"), terms))
    return rows.withColumn("patched", F.col("new") != F.col("translated")).withColumn("translated", F.col("new")).drop("new")


def ner_hints(answers: DataFrame, column: str, *by: str) -> DataFrame:
    """(*by, source, target, n): terms that a model's JSON answers name."""
    rows = answers.select(*by, F.explode(F.from_json(column, "terms array<struct<source:string,target:string>>")["terms"]).alias("t"))
    return rows.select(*by, "t.source", "t.target").filter("trim(source) <> ''").groupBy(*by, "source", "target").agg(F.count(F.lit(1)).alias("n"))


def style_rules(answers: DataFrame, column: str, most: int = 8) -> DataFrame:
    """The first usable rules of a style profile in JSON."""
    rules = F.from_json(column, "rules array<string>")["rules"]
    return answers.withColumn("rules", F.slice(F.filter(rules, lambda r: (F.trim(r) != "") & lint_style_rule(r)), 1, most))


def numbered_runs(entries: DataFrame, *by: str) -> DataFrame:
    """(*by, first, last, entries) of unbroken runs of numbers."""
    run = F.col("n") - F.row_number().over(Window.partitionBy(*by).orderBy("n"))
    return entries.withColumn("run", run).groupBy(*by, "run").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count(F.lit(1)).alias("entries")).drop("run")
