"""Chunks of a translation: stages, eligibility, neighbours, headings, contracts, checks, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.segments import blocks
from quire.functions.text import CJK, ascii_lower, collapse, count_sub, is_back_matter, is_reference_chunk, lines, mojibake, numbers, repair_quote, trim_ws

# Stages in order.
STAGES = ["pending", "translated", "termConsistencyApplied", "residualReviewed", "translationFailed", "mergeReady", "protectedPassthrough"]
# Stages of a run that are one phase of a task.
TRANSLATING = ["Translating", "TermConsistency", "ResidualReview"]
# What a finished task's manifest holds.
REQUIRED_ARTIFACTS = ["sourceMarkdown", "translatedMarkdown", "translatedHtml", "checkpoint", "eventLog", "validationReport", "glossary", "metrics"]


def stage_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), c) - 1


def pending(chunks: DataFrame) -> DataFrame:
    return chunks.filter("kind = 'body' AND stage = 'pending'")


def failed(chunks: DataFrame) -> DataFrame:
    return chunks.filter("kind = 'body' AND stage = 'translationFailed'")


def skips_review(source: Column) -> Column:
    first = F.get(F.filter(F.transform(lines(source), trim_ws), lambda x: x != ""), F.lit(0))
    return is_reference_chunk(source) | F.coalesce(is_back_matter(first), F.lit(False))


def reviewable(chunks: DataFrame) -> DataFrame:
    return chunks.filter((F.col("kind") == "body") & F.col("translated").isNotNull() & (F.col("stage") == "termConsistencyApplied") & ~skips_review(F.col("source")))


def needs(chunks: DataFrame, *task: str) -> DataFrame:
    """What each task still needs: term consistency, residual review, merging."""
    body = (F.col("kind") == "body") & F.col("translated").isNotNull()
    copied = (F.col("kind") != "body") & (F.col("translated") == F.col("source")) & (F.col("stage") != "protectedPassthrough")
    any_ = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    return chunks.groupBy(*task).agg(
        any_(body & (F.col("stage") == "translated")).alias("term_consistency"), any_(body & (F.col("stage") == "termConsistencyApplied")).alias("residual_review"), any_((body & (F.col("stage") == "residualReviewed")) | copied).alias("merge_ready")
    )


def advanced(chunks: DataFrame, wanted: Column) -> DataFrame:
    """Stages moved on to the wanted one; a stage never goes back."""
    return chunks.withColumn("stage", F.when(stage_rank(wanted) >= stage_rank(F.col("stage")), wanted).otherwise(F.col("stage")))


def reset_failed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("stage", F.when(F.col("stage") == "translationFailed", "pending").otherwise(F.col("stage")))


def marked_ready(chunks: DataFrame) -> DataFrame:
    ready = (F.col("kind") == "body") & F.col("translated").isNotNull() & (F.col("stage") == "residualReviewed")
    return chunks.withColumn("stage", F.when(ready, "mergeReady").otherwise(F.col("stage")))


def with_heading(chunks: DataFrame, *task: str, default: str = "Untitled") -> DataFrame:
    """The last heading at or before each chunk."""
    w = Window.partitionBy(*task).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("current", F.coalesce(F.last("heading", ignorenulls=True).over(w), F.lit(default)))


def in_references(chunks: DataFrame, starts: Column, resets: Column, *task: str) -> DataFrame:
    """A flag that stays on from a start to the next reset; a start in the reset's chunk wins."""
    w = Window.partitionBy(*task).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(starts, True).when(resets, False)
    return chunks.withColumn("in_references", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)))


def prose(c: Column) -> Column:
    return F.filter(blocks(c), lambda b: ~F.startswith(b, F.lit("![")) & ~F.startswith(b, F.lit("<!--")))


def neighbours(chunks: DataFrame, *task: str) -> DataFrame:
    """The last paragraph of the chunk before and the first of the chunk after, images left out."""
    before = chunks.select(*task, (F.col("idx") + 1).alias("idx"), F.get(F.reverse(prose(F.col("source"))), F.lit(0)).alias("previous"))
    after = chunks.select(*task, (F.col("idx") - 1).alias("idx"), F.get(prose(F.col("source")), F.lit(0)).alias("next"))
    return chunks.join(before, [*task, "idx"], "left").join(after, [*task, "idx"], "left")


def sentence_window(sentences: Column, i: Column) -> Column:
    start = F.greatest(i - 1, F.lit(0))
    return F.array_join(F.slice(sentences, start + 1, F.least(i + 2, F.size(sentences)) - start), " ")


def contiguous(chunks: DataFrame, *task: str) -> DataFrame:
    """Tasks whose indexes are 0, 1, 2 ... without gap or repeat."""
    n = F.count(F.lit(1))
    return chunks.groupBy(*task).agg(((F.min("idx") == 0) & (F.max("idx") == n - 1) & (F.countDistinct("idx") == n)).alias("contiguous"))


def log_contract(log: DataFrame, required: list[str], *task: str) -> DataFrame:
    """Drops in progress, whether the log starts queued, which required stages it lacks."""
    w = Window.partitionBy(*task).orderBy("seq")
    rows = log.withColumn("drop", F.coalesce((F.col("progress") < F.lag("progress").over(w)).cast("long"), F.lit(0)))
    lacks = F.array_join(F.array_sort(F.array_except(F.array(*[F.lit(x) for x in required]), F.collect_set("stage"))), ",")
    return rows.groupBy(*task).agg(F.sum("drop").alias("drops"), (F.min_by("stage", "seq") == "queued").alias("starts_queued"), lacks.alias("missing"))


def manifest_contract(files: DataFrame, *task: str) -> DataFrame:
    return files.groupBy(*task).agg(F.array_join(F.array_sort(F.array_except(F.array(*[F.lit(x) for x in REQUIRED_ARTIFACTS]), F.collect_set("kind"))), ",").alias("missing"))


def ewma(log: DataFrame, *task: str, alpha: float = 0.3) -> DataFrame:
    """Exponentially weighted rate a minute over the times between events of more than a millisecond.
    A task's log is a bounded array; the fold is in its order."""
    w = Window.partitionBy(*task).orderBy("seq")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gaps = log.withColumn("gap", (us - F.lag(us).over(w)) / 1e6).filter("gap > 0.001")
    rows = gaps.groupBy(*task).agg(F.array_sort(F.collect_list(F.struct("seq", "gap"))).alias("h"))
    fold = F.aggregate("h", F.lit(0.0), lambda a, x: F.when(a <= 0, 60.0 / x["gap"]).otherwise((1 - alpha) * a + alpha * (60.0 / x["gap"])))
    return rows.select(*task, fold.alias("per_minute"))


def water_filling(routes: DataFrame, demand: float, *pool: str, slow: float = 0.2) -> DataFrame:
    """Demand given to the fastest routes first, up to their capacity; slow ones are left out."""
    fastest = F.max("speed").over(Window.partitionBy(*pool))
    order = Window.partitionBy(*pool).orderBy(F.desc("speed"), F.desc("capacity"), "route")
    used = F.when(F.col("speed") >= slow * fastest, F.col("capacity")).otherwise(0.0)
    rows = routes.withColumn("used", used)
    before = F.coalesce(F.sum("used").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("given", F.least("used", F.greatest(F.lit(0.0), F.lit(demand) - before)))


def best_candidate(candidates: DataFrame, *task: str) -> DataFrame:
    """Most translated, then an exact hash, then most writes, then the newest."""
    cols = [c for c in candidates.columns if c not in task]
    return candidates.groupBy(*task).agg(F.max_by(F.struct(*cols), F.struct("translated", "exact", "writes", "ts")).alias("c")).select(*task, "c.*")


def sources_match(chunks: DataFrame, new: DataFrame, *task: str) -> DataFrame:
    """Whether new sources fit a checkpoint: as many, and every translated chunk's source unchanged."""
    a, b = chunks.select(*task, "idx", "source", "translated", F.lit(1).alias("a")), new.select(*task, "idx", F.col("source").alias("new"), F.lit(1).alias("b"))
    both = a.join(b, [*task, "idx"], "full")
    same = F.col("translated").isNull() | F.coalesce(F.col("source") == F.col("new"), F.lit(False))
    return both.groupBy(*task).agg(((F.count("a") == F.count("b")) & F.bool_and(same) & F.bool_or(F.col("translated").isNotNull())).alias("match"))


# Quality rules -------------------------------------------------------------------------------------


def resume_gate(saved: DataFrame, now: DataFrame, matching: DataFrame, *task: str) -> DataFrame:
    """(*task, gate): whether a checkpoint can go on. saved, now: (*task, source_hash, chunk_size, prompt_hash);
    matching: (*task, match), see ``sources_match``. Chunk size and prompt must be the same and the prompt's hash
    not blank; then the same source will do, or translated chunks whose sources are unchanged; else null."""
    then = saved.select(*task, *[F.col(c).alias(f"old_{c}") for c in ("source_hash", "chunk_size", "prompt_hash")])
    rows = then.join(now, list(task)).join(matching, list(task), "left")
    usable = (F.col("old_chunk_size") == F.col("chunk_size")) & (F.col("old_prompt_hash") == F.col("prompt_hash")) & (trim_ws(F.col("prompt_hash")) != "")
    gate = F.when(usable & (F.col("old_source_hash") == F.col("source_hash")), "ExactSourceHash").when(usable & F.col("match"), "MatchingTranslatedSources")
    return rows.select(*task, gate.alias("gate"))


def running_state(updates: DataFrame, *task: str) -> DataFrame:
    """(*task, status, phase, progress, message): a running task after its last update (seq, stage, progress, message)."""
    last = updates.groupBy(*task).agg(F.max_by(F.struct("stage", "progress", "message"), "seq").alias("u"))
    phase = F.when(F.col("u.stage").isin(TRANSLATING), "Translating").otherwise(F.col("u.stage"))
    return last.select(*task, F.lit("Processing").alias("status"), phase.alias("phase"), F.least(F.col("u.progress"), F.lit(100)).alias("progress"), F.col("u.message").alias("message"))


def table_snapshot_missing(translated: Column) -> Column:
    """The mark of a table whose picture could not be made still stands in the translation."""
    return F.regexp_like(translated, F.lit("<!--[^>]*pdf-table:image-missing"))


def quote_imbalance(target: Column) -> Column:
    return count_sub(target, "“") != count_sub(target, "”")


def missing_numbers(source: Column, target: Column) -> Column:
    found = numbers(target)
    return F.filter(numbers(source), lambda n: ~F.array_contains(found, n))


def half_heading(target: Column) -> Column:
    return F.regexp_like(target, F.lit(rf"(?m)^\s*(?:(?:Book|Volume|Part|Section)\s+\w+[,:：]?\s+)?Chapter\s+(\d+)\s*[:：]\s*[^\n]*[{CJK}]"))


def drift(pairs: DataFrame, *key: str) -> DataFrame:
    """(*key, code): one row for each rule that a pair breaks."""
    s, t = F.col("source"), F.col("target")
    codes = F.array(F.when(quote_imbalance(t), "QUOTE_IMBALANCE"), F.when(half_heading(t), "HEADING_BILINGUAL_RESIDUE"), F.when(F.size(missing_numbers(s, t)) > 0, "NUMBER_CONSERVATION"))
    return pairs.select(*key, F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


def review_checks(pairs: DataFrame, *key: str) -> DataFrame:
    """(*key, rule): untranslated pairs break that rule alone; others may break several."""
    s, t = F.col("source"), F.col("target")
    empty = trim_ws(t) == ""
    untranslated = empty | (ascii_lower(trim_ws(t)) == ascii_lower(trim_ws(s))) | ~F.regexp_like(t, F.lit(f"[{CJK}]"))
    digits = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit("[0-9]"), F.lit(0)))
    rest = F.filter(F.array(F.when(digits(s) != digits(t), "digits"), F.when(count_sub(s, "\n") != count_sub(t, "\n"), "newlines")), lambda c: c.isNotNull())
    return pairs.select(*key, F.explode(F.when(untranslated, F.array(F.lit("untranslated"))).otherwise(rest)).alias("rule"))


def residual_terms(pairs: DataFrame, narrative: bool, *key: str) -> DataFrame:
    """(*key, term, n): words of the source that stand in the translation, the masked parts of both
    left out; see ``residual.mask``."""
    from quire.functions.text import ignored_residual

    words = lambda c: F.regexp_extract_all(c, F.lit("[A-Za-z]{2,}"), F.lit(0))
    rows = pairs.select(*key, F.transform(words(F.col("source")), ascii_lower).alias("own"), F.explode(words(F.col("target"))).alias("token"))
    kept = rows.filter(~ignored_residual(F.col("token"), F.lit(narrative)) & F.array_contains("own", ascii_lower(F.col("token"))))
    return kept.groupBy(*key, ascii_lower(F.col("token")).alias("term")).agg(F.count(F.lit(1)).alias("n"))


def validation(chunks: DataFrame, *task: str) -> DataFrame:
    """(*task, idx, code, level): issues of chunks. Any kind may be untranslated; other rules are for
    bodies."""
    t, s = F.col("translated"), F.col("source")
    body, blank = F.col("kind") == "body", trim_ws(s) == ""
    found = F.array(
        F.when(t.isNull(), F.struct(F.lit("UNTRANSLATED_CHUNK").alias("code"), F.lit("error").alias("level"))),
        F.when(body & (trim_ws(t) == "") & ~blank, F.struct(F.lit("EMPTY_TRANSLATION").alias("code"), F.lit("error").alias("level"))),
        F.when(body & (t == s) & ~blank, F.struct(F.lit("SOURCE_EQUALS_TRANSLATION").alias("code"), F.lit("warning").alias("level"))),
        F.when(body & F.contains(t, F.lit("pdf-table:start")) & ~F.contains(t, F.lit("pdf-table:end")), F.struct(F.lit("PDF_TABLE_SNAPSHOT_MISSING").alias("code"), F.lit("error").alias("level"))),
    )
    return chunks.select(*task, "idx", F.inline(F.filter(found, lambda x: x.isNotNull())))


def purged(chunks: DataFrame) -> DataFrame:
    """Polluted translations become null, to be made anew."""
    return chunks.withColumn("translated", F.when(~F.coalesce(mojibake(F.col("translated"))["polluted"], F.lit(False)), F.col("translated")))


def merged(chunks: DataFrame, *task: str) -> DataFrame:
    """The text of each task, chunks in order: the source where translation failed. One row a task is
    what a merged document is."""
    text = F.when((F.col("kind") == "body") & (F.col("stage") == "translationFailed"), F.col("source")).otherwise(F.col("translated"))
    return chunks.groupBy(*task).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"), F.count_if(text.isNull()).alias("missing"))


def budget(candidates: DataFrame, limit: int, *task: str, most_chunks: int = 64, floor: int = 8) -> DataFrame:
    """The first chunks with their terms; only if all have more terms than the limit, each keeps an
    even share, at least the floor. candidates: (*task, idx, terms)."""
    rank = F.row_number().over(Window.partitionBy(*task).orderBy("idx"))
    rows = candidates.withColumn("_r", rank).filter(F.col("_r") <= most_chunks).drop("_r")
    sums = rows.groupBy(*task).agg(F.sum(F.size("terms")).alias("all"), F.count(F.lit(1)).alias("n"))
    share = F.greatest(F.floor(F.lit(limit) / F.col("n")), F.lit(floor)).cast("int")
    return rows.join(sums, list(task)).withColumn("terms", F.when(F.col("all") > limit, F.slice("terms", F.lit(1), share)).otherwise(F.col("terms"))).drop("all", "n")


def running_cap(candidates: DataFrame, limit: int, *task: str) -> DataFrame:
    """How many terms each chunk adds under a cap over all chunks in order. candidates: (*task, idx, n)."""
    w = Window.partitionBy(*task).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.coalesce(F.sum("n").over(w), F.lit(0))
    return candidates.withColumn("counted", F.least("n", F.greatest(F.lit(0), F.lit(limit) - prior)))


def style_sample(text: Column, blocks_: int = 6, chars: int = 4000) -> Column:
    """Up to six prose blocks of 80 characters at even steps, joined and cut."""
    full = F.filter(blocks(text), lambda b: ~F.startswith(b, F.lit("#")) & ~F.startswith(b, F.lit("<!--")) & (F.length(b) >= 80))
    step = F.greatest(F.floor(F.size(full) / blocks_).cast("int"), F.lit(1))
    return F.substring(F.array_join(F.filter(full, lambda b, i: (i % step == 0) & (i / step < blocks_)), "\n\n"), 1, chars)


def repaired(pairs: DataFrame) -> DataFrame:
    fixed = repair_quote(F.col("source"), F.col("target"))
    return pairs.withColumn("target", fixed["text"]).withColumn("repairs", fixed["repairs"])


def compact_key(c: Column) -> Column:
    return ascii_lower(collapse(c))
