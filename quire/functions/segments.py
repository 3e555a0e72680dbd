"""Segmentation of texts into arrays: blocks, sentences, tokens, phrases, numbers, headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CJK, ascii_lower, is_reference_heading, lines, trim_end, trim_start, trim_ws, words


def blocks(c: Column) -> Column:
    """Blocks between literal blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, "\n\n"), trim_ws), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    """Blocks between lines of nothing but white space."""
    return F.filter(F.transform(F.split(c, r"\n(?:[ \t\r]*\n)+"), trim_ws), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Sentences with their end mark, Latin or Chinese; a line end closes one too."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit("[^.!?。！？\n]++[.!?。！？\n]?|[.!?。！？\n]"), F.lit(0)), trim_ws), lambda x: x != "")


def marked_blocks(c: Column) -> Column:
    """Blocks between alignment markers if there are any, else between blank lines."""
    return F.when(F.regexp_like(c, F.lit(r"\[\[B[0-9]{3}\]\]")), F.filter(F.transform(F.slice(F.split(c, r"\[\[B[0-9]{3}\]\]"), 2, 2**30), trim_ws), lambda x: x != "")).otherwise(blocks(c))


def english_words(c: Column) -> Column:
    """Runs of letters, apostrophes and hyphens of 3 or more, then trimmed of the latter two."""
    return F.regexp_extract_all(c, F.lit("(?<![A-Za-z'-])(?=[A-Za-z'-]{3})['-]*+([A-Za-z](?:[A-Za-z'-]*[A-Za-z])?)"), F.lit(1))


def ascii_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[A-Za-z]{2,}"), F.lit(0))


def han_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[{CJK}]+"), F.lit(0))


def capital_phrases(c: Column) -> Column:
    """Runs of capitalised words within spans that punctuation bounds; what stands between two of
    them, but a lower-case word, does not part them."""
    spans = F.split(c, r"[.!?;:,()\[\]{}]")

    def of(span: Column) -> Column:
        tokens = F.regexp_extract_all(span, F.lit("[A-Za-z][A-Za-z'’-]*"), F.lit(0))
        marked = F.transform(tokens, lambda t: F.when(F.regexp_like(t, F.lit("^[A-Z]")), t).otherwise(F.lit("")))
        return F.filter(F.transform(F.split(F.array_join(marked, " "), r" {2,}"), trim_ws), lambda x: x != "")

    return F.flatten(F.transform(spans, of))


def first_names(c: Column) -> Column:
    """Words of capitalised phrases that are not all capitals, sorted, each once."""
    each = F.flatten(F.transform(capital_phrases(c), lambda p: F.transform(words(p), lambda w: F.regexp_replace(w, "^[^A-Za-z]+|[^A-Za-z]+$", ""))))
    return F.array_sort(F.array_distinct(F.filter(each, lambda w: (F.octet_length(w) >= 2) & F.regexp_like(w, F.lit("^[A-Z]")) & F.regexp_like(w, F.lit("[^A-Z]")))))


def headings(c: Column) -> Column:
    """Structs (level, title) of the Markdown headings."""
    found = F.filter(lines(c), lambda x: F.regexp_like(x, F.lit(r"^\s*#{1,6} ")))
    made = F.transform(
        found, lambda x: F.struct(F.length(F.regexp_extract(trim_ws(x), "^(#{1,6}) ", 1)).alias("level"), trim_ws(F.regexp_replace(F.regexp_replace(trim_ws(x), "^#{1,6} ", ""), "#+$", "")).alias("title"))
    )
    return F.filter(made, lambda h: h["title"] != "")


def distinctive_tokens(c: Column) -> Column:
    """Tokens of letters, digits, hyphens, apostrophes and dots, of 4 characters with a letter."""
    cut = F.transform(F.split(c, "[^A-Za-z0-9.'-]+"), lambda t: ascii_lower(F.regexp_replace(t, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")))
    return F.array_sort(F.array_distinct(F.filter(cut, lambda t: (F.length(t) >= 4) & F.regexp_like(t, F.lit("[a-z]")))))


def with_markers(parts: Column) -> Column:
    """Blocks with their numbers as alignment markers, three digits or more."""
    label = lambda i: F.concat(F.lit("[[B"), F.when(i < 1000, F.lpad(i.cast("string"), 3, "0")).otherwise(i.cast("string")), F.lit("]]\n"))
    return F.array_join(F.transform(parts, lambda b, i: F.concat(label(i), b)), "\n\n")


def by_markers(c: Column) -> Column:
    return F.transform(F.slice(F.split(c, r"\[\[B[0-9]{1,6}\]\]"), 2, 2**30), trim_ws)


def marker_numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[\[B([0-9]{1,6})\]\]"), F.lit(1)), lambda x: x.cast("int"))


def retry_slice(parts: Column, attempt: Column) -> Column:
    """From the third attempt on a window of half, a quarter, an eighth of the blocks, further on with
    each attempt; all blocks before, or where there are fewer than two."""
    n = F.size(parts)
    window = F.greatest(F.floor(n / F.pow(F.lit(2.0), F.least(attempt - 2, F.lit(3)))).cast("int"), F.lit(1))
    start = F.pmod((attempt - 3) * window, F.greatest(n, F.lit(1)))
    return F.when((attempt < 3) | (n < 2), parts).otherwise(F.slice(parts, start + 1, F.least(window, n - start)))


#: Lines around a table that layout recovery took from a PDF.
TABLE_START, TABLE_END = r"^\s*<!--[^>]*pdf-table:start\s*-->\s*$", r"^\s*<!--[^>]*pdf-table:end\s*-->\s*$"


def pack_lines(c: Column, limit: int) -> Column:
    """Lines packed greedily into chunks of at most ``limit`` bytes. Image lines and PDF tables are
    chunks of their own, as is a line longer than the limit."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit("").alias("table"))
    put = lambda done, x: F.when(x == "", done).otherwise(F.concat(done, F.array(x)))

    def step(a: Column, line: Column) -> Column:
        text = F.concat(line, F.lit("\n"))
        opens, inside = F.regexp_like(line, F.lit(TABLE_START)), a["table"] != ""
        closes = inside & F.regexp_like(line, F.lit(TABLE_END))
        image = F.startswith(trim_start(line), F.lit("![")) & F.contains(line, F.lit("](")) & F.endswith(line, F.lit(")"))
        full = (a["now"] != "") & (F.octet_length(a["now"]) + F.octet_length(line) > limit)
        done = (
            F.when(opens, put(a["done"], a["now"])).when(closes, put(a["done"], F.concat(a["table"], text))).when(inside, a["done"])
            .when(image, put(put(a["done"], a["now"]), F.concat(trim_end(line), F.lit("\n")))).when(full, put(a["done"], a["now"])).otherwise(a["done"])
        )
        now = F.when(opens | (~inside & image), F.lit("")).when(inside, a["now"]).when(full, text).otherwise(F.concat(a["now"], text))
        table = F.when(closes, F.lit("")).when(opens | inside, F.concat(a["table"], text)).otherwise(a["table"])
        return F.struct(done.alias("done"), now.alias("now"), table.alias("table"))

    rows = F.split(F.regexp_replace(c, r"\n$", ""), "\n")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.aggregate(rows, start, step, lambda a: put(put(a["done"], a["table"]), a["now"])))


def reference_start(c: Column) -> Column:
    """The byte offset of the references heading; null without one."""
    each = F.transform(F.split(c, "\n"), lambda x, i: F.struct(is_reference_heading(x).alias("hit"), i.alias("i")))
    first = F.get(F.filter(each, lambda x: x["hit"]), F.lit(0))["i"]
    return F.when(first == 0, 0).otherwise(F.octet_length(F.array_join(F.slice(F.split(c, "\n"), F.lit(1), F.greatest(first, F.lit(1))), "\n")) + 1)


def reference_tail(c: Column) -> Column:
    """(references, tail) of a text that begins with its references: the tail begins at the first
    other heading."""
    rows = F.split(c, "\n")
    other = lambda x: F.startswith(trim_ws(x), F.lit("#")) & ~is_reference_heading(x)
    each = F.transform(rows, lambda x, i: F.struct(((i > 0) & other(x)).alias("hit"), i.alias("i")))
    at = F.get(F.filter(each, lambda x: x["hit"]), F.lit(0))["i"]
    head = F.concat(F.array_join(F.slice(rows, F.lit(1), F.coalesce(F.greatest(at, F.lit(1)), F.size(rows))), "\n"), F.when(at.isNotNull(), "\n").otherwise(""))
    tail = F.when(at.isNotNull(), F.array_join(F.slice(rows, at + 1, F.size(rows)), "\n")).otherwise("")
    return F.struct(head.alias("references"), tail.alias("tail"))


def heading_paths(parts: Column) -> Column:
    """For each block the stack of headings above it; a heading cuts the stack at its level only if
    the stack is that deep (so H1, H3, H3 stack up to three)."""

    def step(a: Column, b: Column) -> Column:
        level = F.greatest(F.length(F.regexp_extract(b, "^(#*)", 1)), F.lit(1))
        title = trim_ws(F.regexp_replace(b, "^#+", ""))
        stack = a["stack"]
        cut = F.when(F.size(stack) >= level, F.slice(stack, F.lit(1), level - 1)).otherwise(stack)
        new = F.when(F.startswith(b, F.lit("#")) & (title != ""), F.concat(cut, F.array(title))).otherwise(stack)
        return F.struct(new.alias("stack"), F.concat(a["all"], F.array(new)).alias("all"))

    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<array<string>>").alias("all"))
    return F.aggregate(parts, start, step, lambda a: a["all"])
