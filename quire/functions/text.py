"""Text predicates, normalisers and extractors as Column expressions.

Case folding is ASCII-only where noted (``ascii_lower``), since Spark's ``lower`` folds all of Unicode.
Character classes are spelled out, so that letters beyond ASCII never depend on a regex dialect.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CJK = "一-鿿"
#: White space at which words split.
WS = r"[\s\u0085   -     　]"
#: The characters that Unicode classes as spaces.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: The characters of ``WS``; trimming looks at the ends only, a pattern at every blank.
BLANKS = SPACES + "\t\n\x0b\f\r\u0085\u2028\u2029"

# Spelled-out symbols of a term key.
SYMBOLS = {"+": "plus", "&": "and", "@": "at", "#": "hash", "%": "percent", "=": "equals"}
# Labels of headings.
REFERENCE_HEADINGS = ["references", "bibliography", "works cited", "literature cited"]
BACK_MATTER = ["abbreviations", "abbreviation", "acknowledgements", "acknowledgments", "bibliography", "works cited", "about the author", "about the editor", "copyright", "credits"]
# Signs of a publication in a reference line.
PUBLICATION = [
    "doi", "journal", "vol.", "pp.", "proc ", "proceedings", "press", "commun", "psychol", "science", "acad", "reports", "letters", "routledge", "springer",
    "wiley", "elsevier", "sage", "cambridge", "oxford", "nature", "plos", "eds.", "(ed.)", "(eds.)", "memory and language", "public interest", "north-holland",
]
# Signs of an academic text.
ACADEMIC = ["\n## references", "\n## abstract", "\nkeywords:", "\nreceived ", "\naccepted ", "\ndoi"]
# English number words and Roman numerals, 1 to 20.
NUMBER_WORDS = [
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen", "twenty",
]
ROMAN = [
    "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx",
]
# Exam levels in order, and their labels.
LEVELS = ["zhongKao", "gaoKao", "cet4", "cet6", "kaoYan", "ielts", "toefl", "tem4", "tem8", "gre"]
LEVEL_LABELS = {
    "中考": 0, "初中": 0, "zhongKao": 0, "zk": 0, "高考": 1, "高中": 1, "gaoKao": 1, "gk": 1, "四级": 2, "cet4": 2, "CET4": 2, "六级": 3, "cet6": 3, "CET6": 3,
    "考研": 4, "kaoYan": 4, "ky": 4, "雅思": 5, "ielts": 5, "IELTS": 5, "托福": 6, "toefl": 6, "TOEFL": 6, "专四": 7, "tem4": 7, "TEM4": 7, "专八": 8, "tem8": 8, "TEM8": 8,
    "GRE": 9, "gre": 9, "SAT": 9, "sat": 9, "GMAT": 9,
}
TAG_LABELS = {"zk": "中考", "gk": "高考", "cet4": "四级", "cet6": "六级", "ky": "考研", "ielts": "雅思", "toefl": "托福", "tem4": "专四", "tem8": "专八", "gre": "GRE", "sat": "GRE"}
FORM_CODES = ["d", "p", "i", "3", "s", "r", "t"]
# Words that make no proper noun.
NOISE_WORDS = [
    "The", "A", "An", "And", "But", "For", "If", "In", "Into", "Of", "On", "Or", "That", "Their", "Then", "There", "They", "This", "Those", "To",
    "We", "When", "Where", "With", "Now", "Indeed", "Even", "One", "You", "People", "Story", "Chance", "Anon", "End", "Abstract", "Introduction",
    "Background", "Methods", "Results", "Discussion", "Conclusion", "Conclusions", "References", "Appendix", "Table", "Figure", "Language",
    "Specifically", "However", "Although", "Apparently", "Before", "Besides", "Consequently", "Doubtless", "Meanwhile", "Moreover", "Nevertheless",
    "Nothing", "Perhaps", "Presently", "Probably", "Somehow", "Something", "Sometimes", "Suddenly", "Though", "Toward", "Turning", "Unlike",
    "Whatever", "Whenever", "Wherever", "Whether", "Future", "Lastly", "Department", "Social", "Participants", "Study", "Research", "Data", "First",
    "Second", "Third",
]
LEADING_NOISE = ["I", "Now", "And", "But", "Then", "The"]
TRAILING_NOISE = ["And", "We", "His", "Her", "Its", "Their", "Before", "Indeed", "Finally"]
# English words that a translation may keep.
RESIDUAL_STOPWORDS = [
    "a", "an", "about", "after", "again", "against", "all", "also", "although", "am", "and", "any", "anyone", "as", "at", "be", "because", "been",
    "being", "before", "both", "but", "by", "can", "could", "did", "do", "does", "down", "for", "from", "had", "has", "have", "he", "her", "here",
    "hers", "him", "his", "how", "however", "i", "if", "in", "is", "it", "its", "may", "me", "might", "more", "most", "must", "my", "no", "not", "of",
    "on", "only", "onto", "or", "our", "out", "over", "shall", "she", "should", "so", "some", "such", "than", "that", "the", "their", "them", "then",
    "there", "these", "they", "this", "those", "though", "to", "under", "up", "very", "vs", "was", "we", "were", "what", "when", "where", "which",
    "while", "who", "whom", "whose", "why", "will", "with", "without", "would", "you", "your",
]
# Names in classes and ids of page furniture.
FURNITURE = [
    "sharedaddy", "sd-sharing", "sd-social", "sd-block", "jp-sharing", "jp-relatedposts", "jp-post-flair", "share-buttons", "share-button",
    "sharebox", "share-bar", "social-share", "social-links", "social-media", "social-icons", "addtoany", "addthis", "sharethis", "related-posts",
    "related-post", "related-articles", "yarpp", "post-navigation", "post-nav", "nav-links", "nav-previous", "nav-next", "pagination", "page-links",
    "prev-next", "post-pagination", "comment-respond", "comments-area", "comment-area", "comments-list", "comment-list", "screen-reader-text",
    "sr-only", "visually-hidden", "a11y-hidden",
]
# Characters typical of text decoded with the wrong table.
MOJIBAKE_CJK = "璇妗嘘灦濡備綍濉戦犲绀瑙勮寖鐸鐭璧鎴浼濂鍙"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def trim_spaces(c: Column) -> Column:
    """Without the space characters (not tabs or line ends) at both ends."""
    return F.btrim(c, F.lit(SPACES))


def trim_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def trim_start(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def collapse(c: Column) -> Column:
    return F.array_join(words(c), " ")


def count_of(c: Column, pattern: str) -> Column:
    """How many characters match a character class."""
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def count_sub(c: Column, s: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))) / F.lit(len(s))).cast("int")


def lines(c: Column) -> Column:
    return F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n")


def any_of(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


# Terms ---------------------------------------------------------------------------------------------


def term_key(c: Column) -> Column:
    """ASCII letters and digits in lower case; symbols by name, a minus only when it stands alone."""
    c = F.regexp_replace(c, r"(?<![A-Za-z0-9])-|-(?![A-Za-z0-9])", "minus")
    for s, name in SYMBOLS.items():
        c = F.replace(c, F.lit(s), F.lit(name))
    return ascii_lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def compact(c: Column, n: int) -> Column:
    """White space collapsed, then the first n characters."""
    return F.substring(collapse(c), 1, n)


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, in single precision; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest).cast("float")


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters two texts share from the start on. Both are taken apart once."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    n = F.least(F.length(a), F.length(b))
    first = F.array_position(same, False)
    return F.when(n == 0, F.lit(0)).when(first > 0, first - 1).otherwise(n).cast("int")


def common_prefix_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(common_prefix(a, b) / longest).cast("float")


def quoted(c: Column) -> Column:
    """A column's text as a literal in a regex."""
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|/-])", r"\\$1")


def mentions(text: Column, term: Column) -> Column:
    """The term stands between characters that are no ASCII letter, digit, underscore or hyphen."""
    return F.contains(text, term) & F.regexp_like(text, F.concat(F.lit("(?<![A-Za-z0-9_-])"), quoted(term), F.lit("(?![A-Za-z0-9_-])")))


def replace_term(text: Column, source: Column, target: Column) -> Column:
    """The source replaced where it stands at a boundary of Latin identifiers."""
    safe = F.regexp_replace(target, r"([\\$])", r"\\$1")
    return F.when(trim_ws(source) == "", text).otherwise(F.regexp_replace(text, F.concat(F.lit("(?<![A-Za-z0-9_-])"), quoted(source), F.lit("(?![A-Za-z0-9_-])")), safe))


def canonical_phrase(c: Column) -> Column:
    """Without leading and trailing function words; one token always stays."""
    c = collapse(c)
    c = F.regexp_replace(c, rf"^(?:(?:{'|'.join(LEADING_NOISE)}) )+", "")
    return F.regexp_replace(c, rf"(?: (?:[\x00-\x7F]|{'|'.join(TRAILING_NOISE)}))+$", "")


def is_noise_phrase(c: Column) -> Column:
    bare = F.transform(words(c), lambda w: F.regexp_replace(w, "^[^A-Za-z]+|[^A-Za-z]+$", ""))
    function = (F.size(words(c)) >= 2) & F.forall(bare, lambda w: (w == "") | w.isin(NOISE_WORDS))
    return (F.octet_length(c) < 3) | (F.octet_length(c) > 64) | c.isin(NOISE_WORDS) | function | F.regexp_like(c, F.lit("^[A-Z]*$"))


def keep_proper_noun(phrase: Column, count: Column, evidence: Column, academic: Column) -> Column:
    return F.when(F.contains(phrase, F.lit(" ")), count >= 1).when(academic & (evidence == 0), False).otherwise((count >= 2) & (F.octet_length(phrase) >= 6))


def strict_role(c: Column) -> Column:
    """(role, type) of a surface form."""
    c = trim_ws(c)
    starts = lambda *p: F.regexp_like(c, F.lit(f"^(?:{'|'.join(p)}) "))
    role = (
        F.when(starts("The Tale of"), "book_title").when(starts("Queen", "King", "Prince", "Princess", "Lord", "Lady"), "person_name")
        .when(starts("Temple of", "Church of", "University of"), "organization_name").when(F.contains(c, F.lit(" of ")), "other").when(F.size(words(c)) >= 2, "person_name").otherwise("place_name")
    )
    kinds = {"book_title": "title", "person_name": "person", "organization_name": "organization", "other": "technical", "place_name": "location"}
    return F.struct(role.alias("role"), F.element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), role).alias("type"))


# Languages and scripts -----------------------------------------------------------------------------


def language(c: Column) -> Column:
    c = F.substring(c, 1, 2000)
    n = F.length(c)
    share = lambda p: F.try_divide(count_of(c, p), n)
    return F.when(n == 0, "unknown").when(share("[぀-ヿ]") > 0.05, "ja").when(share(f"[{CJK}]") > 0.3, "zh").when(share("[A-Za-z]") > 0.4, "en").otherwise("unknown")


def ascii_words(c: Column) -> Column:
    """Words with an ASCII letter in them."""
    return F.size(F.filter(words(c), lambda w: F.regexp_like(w, F.lit("[A-Za-z]"))))


def half_translated(c: Column) -> Column:
    """Some line has over 30 English words and over three for each Chinese character."""
    cjk = lambda x: count_of(x, "[一-鿿㐀-䶿豈-﫿]")
    return F.exists(F.split(c, "\n"), lambda x: (ascii_words(x) > 30) & (ascii_words(x) > 3 * cjk(x)))


def mojibake(c: Column) -> Column:
    """(polluted, score, chars)."""
    n = F.length(c)
    strong = count_of(c, "[\\ue000-\\uf8ff€™█\\ufffd]")
    score = strong + count_of(c, f"[{MOJIBAKE_CJK}]")
    polluted = ((strong >= 2) & (F.floor(score * 100 / F.greatest(n, F.lit(1))) >= 2)) | F.contains(c, F.lit("�"))
    return F.struct(((n >= 4) & polluted).alias("polluted"), F.when(n < 4, 0).otherwise(score).alias("score"), n.alias("chars"))


def english_prose(c: Column) -> Column:
    c = trim_ws(c)
    letters = count_of(c, "[A-Za-z]")
    return (F.octet_length(c) >= 160) & (letters >= 120) & (letters > 4 * count_of(c, f"[{CJK}]"))


def near_passthrough(source: Column, target: Column) -> Column:
    """The translation repeats the source: the letters alone are nearly the same."""
    a, b = (ascii_lower(F.regexp_replace(x, "[^A-Za-z]", "")) for x in (source, target))
    la, lb = F.length(a), F.length(b)
    ma, mb = F.floor(la / 2).cast("int"), F.floor(lb / 2).cast("int")
    mid = F.least(F.lit(40), la - ma, lb - mb)
    differs = (F.substring(a, 1, 80) != F.substring(b, 1, 80)) & (mid > 0) & (F.substr(a, ma + 1, mid) != F.substr(b, mb + 1, mid))
    return (
        F.when((la < 80) | (lb < 80), False).when(a == b, True).when((F.abs(la - lb) / F.greatest(la, lb)).cast("float") > F.lit(0.06).cast("float"), False)
        .when(differs, False).otherwise(similarity(a, b) >= F.lit(0.94).cast("float"))
    )


def untranslated_body(source: Column, target: Column) -> Column:
    a, b = (ascii_lower(F.regexp_replace(x, "[^A-Za-z0-9]", "")) for x in (source, target))
    overlap = common_prefix(a, b) + common_prefix(F.reverse(a), F.reverse(b))
    shorter = F.least(F.length(a), F.length(b))
    return (
        F.when(F.regexp_like(target, F.lit("[一-鿿㐀-䶿豈-﫿]")), half_translated(target)).when((ascii_words(source) < 8) | (F.length(source) < 48), False)
        .when((a == "") | (b == ""), False).when(a == b, True).otherwise(overlap >= F.floor(shorter * 9 / 10))
    )


# HTML ----------------------------------------------------------------------------------------------


def decode_entities(c: Column) -> Column:
    """Five entities, the ampersand first (so doubly escaped text becomes markup)."""
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def decode_html(c: Column) -> Column:
    c = decode_entities(F.replace(c, F.lit("&nbsp;"), F.lit(" ")))
    return F.replace(F.replace(c, F.lit("&apos;"), F.lit("'")), F.lit("&#x27;"), F.lit("'"))


def html_text(c: Column) -> Column:
    """Text of a page: block tags end lines, lines without text go, a blank line between the rest."""
    c = F.regexp_replace(F.regexp_replace(c, "(?is)<script.*?</script>", " "), "(?is)<style.*?</style>", " ")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, "(?i)</?(p|div|section|article|h1|h2|h3|h4|h5|h6|li|blockquote|tr|td|th)>", "\n")
    c = decode_html(F.regexp_replace(c, "(?is)<[^>]+>", " "))
    return F.array_join(F.filter(F.transform(lines(c), trim_ws), lambda x: x != ""), "\n\n")


def html_heading(c: Column) -> Column:
    raw = F.regexp_extract(c, "(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", 1)
    return F.nullif(collapse(decode_html(F.regexp_replace(raw, "(?is)<[^>]+>", " "))), F.lit(""))


def html_title(c: Column) -> Column:
    return decode_entities(F.nullif(trim_ws(F.regexp_extract(c, "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")))


def strip_tags(c: Column) -> Column:
    """Everything between < and the next >; a stray > goes too, an unclosed < takes the rest."""
    return F.regexp_replace(c, "(?s)<[^>]*>?|>", "")


def file_component(c: Column) -> Column:
    out = trim_ws(F.substring(F.regexp_replace(c, r'[/\\:*?"<>|]', "_"), 1, 60))
    return F.when(out == "", "web-article").otherwise(out)


def article_html(c: Column) -> Column:
    """The article element, else main, else body, else all. (A densest block: ``dense.py``.)"""
    pick = lambda tag: F.nullif(F.regexp_extract(c, f"(?is)<{tag}[\\s>].*?</{tag}>", 0), F.lit(""))
    return F.coalesce(pick("article"), pick("main"), pick("body"), c)


def is_boilerplate(name: Column, attrs: Column) -> Column:
    low = ascii_lower(attrs)
    values = F.regexp_extract_all(low, F.lit(r"""(?:class|id)=(?:"[^"]*"|'[^']*')"""), F.lit(0))
    names = F.flatten(F.transform(values, lambda v: F.split(F.regexp_replace(v, r"""^[a-z]+=|["']""", ""), r"\s+")))
    keep = any_of(attrs, ['epub:type="toc', "epub:type='toc", "landmarks", "page-list", "doc-toc"])
    hidden = any_of(low, ["hidden", 'aria-hidden="true"', "display:none", "display: none", "visibility:hidden", "visibility: hidden"])
    return F.when(name.isin("footer", "script", "style"), True).when(name == "nav", ~keep).when(hidden, True).otherwise(F.arrays_overlap(names, F.array(*[F.lit(t) for t in FURNITURE])))


# Markdown ------------------------------------------------------------------------------------------


def block_kind(c: Column) -> Column:
    c = trim_ws(c)
    starts = lambda p: F.startswith(c, F.lit(p))
    return (
        F.when(starts("#"), "heading").when(starts("!["), "image").when(starts(">"), "blockquote").when(starts("- ") | starts("* ") | starts("1. "), "list")
        .when(starts("```"), "code").when((c == "") | F.forall(lines(c), lambda x: F.startswith(trim_start(x), F.lit("|"))), "table").otherwise("paragraph")
    )


def plain_text(c: Column) -> Column:
    def one(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(trim_ws(x), "^#+", ""), "^>+", "")
        return trim_ws(F.regexp_replace(F.regexp_replace(x, "^(?:- )+", ""), r"^(?:\* )+", ""))

    return trim_ws(F.array_join(F.transform(lines(c), one), " "))


def translatable(c: Column) -> Column:
    return ~block_kind(c).isin("image", "code")


def is_image_chunk(c: Column) -> Column:
    full = F.filter(F.transform(lines(c), trim_ws), lambda x: x != "")
    return (F.size(full) > 0) & F.forall(full, lambda x: F.startswith(x, F.lit("![")) & F.contains(x, F.lit("](")) & F.endswith(x, F.lit(")")))


def is_academic(c: Column) -> Column:
    return any_of(ascii_lower(c), ACADEMIC)


def article_policy(c: Column) -> Column:
    c = ascii_lower(trim_ws(c))
    return F.when(c == "academic", "Academic").when(c.isin("business", "legal", "tech_doc", "textbook", "nonfiction"), "Specialized").otherwise("Narrative")


def accepts_persons(c: Column) -> Column:
    p = article_policy(c)
    return (p == "Narrative") | ((p == "Specialized") & ascii_lower(trim_ws(c)).isin("business", "nonfiction"))


def mask_links(c: Column) -> Column:
    """Link destinations become blanks; ``](`` becomes ``] ``. Lengths stay."""
    hit = F.regexp_extract_all(c, F.lit(r"\]\([^)]*\)?"), F.lit(0))
    return F.aggregate(hit, c, lambda acc, h: F.replace(acc, h, F.concat(F.lit("]"), F.repeat(F.lit(" "), F.length(h) - 1))))


def is_multi_column(c: Column) -> Column:
    cells = F.filter(F.transform(F.split(c, r"\s{2,}"), trim_ws), lambda x: x != "")
    return (F.size(cells) >= 3) & F.forall(cells, lambda x: F.size(words(x)) <= 6)


# Headings and references ---------------------------------------------------------------------------


def heading_label(c: Column) -> Column:
    c = trim_ws(F.regexp_replace(trim_ws(c), "^#+", ""))
    return ascii_lower(F.regexp_replace(c, ":+$", ""))


def is_reference_heading(c: Column) -> Column:
    return heading_label(c).isin(REFERENCE_HEADINGS)


def is_back_matter(c: Column) -> Column:
    return heading_label(c).isin(BACK_MATTER)


def numbered_reference(c: Column) -> Column:
    return F.regexp_like(c, F.lit(r"^\s*(?:\[[0-9]+\]|[0-9]+[.)] )"))


def has_year(c: Column) -> Column:
    return any_of(ascii_lower(c), ["(19", "(20", " 19", " 20", "(forthcoming)", "(in press)"])


def is_reference_line(c: Column) -> Column:
    head = F.substring(trim_start(c), 1, 96)
    place = lambda s: F.when(F.locate(s, head) == 0, F.lit(10**6)).otherwise(F.locate(s, head) - 1)
    year = F.when(F.locate("(19", head) > 0, F.locate("(19", head) - 1).otherwise(place("(20"))
    author = (place(",") <= 40) & (year <= 72) & (place(".") <= 90)
    publication = any_of(ascii_lower(c), PUBLICATION)
    return F.when(F.octet_length(c) < 24, False).when(numbered_reference(c), has_year(c) | publication).otherwise(author & has_year(c) & F.contains(c, F.lit(", ")) & F.contains(c, F.lit(".")) & publication)


def is_reference_chunk(c: Column) -> Column:
    full = F.filter(F.transform(lines(c), trim_ws), lambda x: x != "")

    def prose(x: Column) -> Column:
        marks = sum((F.contains(x, F.lit(m)).cast("int") for m in ".?!;:"), F.lit(0))
        return (F.octet_length(x) >= 120) & ~F.startswith(x, F.lit("#")) & ~is_reference_line(x) & ~numbered_reference(x) & (marks >= 2) & (ascii_words(x) >= 20)

    return F.exists(F.slice(full, 1, 3), is_reference_heading) | (F.coalesce(is_reference_line(F.get(full, F.lit(0))), F.lit(False)) & ~F.exists(full, prose))


def heading_key(c: Column) -> Column:
    return F.lower(collapse(c))


def numberless_key(c: Column) -> Column:
    key = heading_key(c)
    cut = F.regexp_replace(key, r"^[0-9.)(\-:\s]+", "")
    return F.when(cut == "", key).otherwise(cut)


def semantic_heading(c: Column) -> Column:
    key = ascii_lower(collapse(c))
    # Names of the usual sections.
    names = {"abstract": ["abstract", "摘要", "摘 要"], "keywords": ["keywords", "关键字", "关键词"], "references": ["references", "参考文献"], "acknowledgments": ["acknowledgments", "acknowledgements", "致谢"]}
    out = None
    for name, labels in names.items():
        out = F.when(key.isin(labels), name) if out is None else out.when(key.isin(labels), name)
    cut = key
    for p in ("abstract ", "keywords ", "acknowledgments ", "acknowledgements ", "references "):
        cut = F.regexp_replace(cut, f"^(?:{p})+", "")
    return out.otherwise(cut)


def docx_heading_level(c: Column) -> Column:
    c = F.replace(ascii_lower(trim_ws(c)), F.lit(" "), F.lit(""))
    pattern = "^(?:heading([1-6])(?:char)?|标题([1-6]))$"
    level = F.concat(F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2))
    return F.coalesce(level.try_cast("int"), F.when(c.isin("title", "标题"), 1).when(c.isin("subtitle", "副标题"), 2))


# Numerals ------------------------------------------------------------------------------------------

HAN_DIGITS = "零一二三四五六七八九"


def chinese_value(c: Column) -> Column:
    """The number that a Chinese numeral names; null for anything else."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("now"))

    def step(a: Column, ch: Column) -> Column:
        unit = F.when(ch == "十", 10).when(ch == "百", 100).when(ch == "千", 1000)
        digit = F.when(ch.isin("〇", "零"), 0).when(ch == "两", 2).otherwise(F.position(ch, F.lit(HAN_DIGITS)) - 1)
        return F.struct(
            F.when(unit.isNotNull(), a["total"] + F.when(a["now"] == 0, 1).otherwise(a["now"]) * unit).otherwise(a["total"]).cast("long").alias("total"),
            F.when(unit.isNotNull(), 0).otherwise(a["now"] * 10 + digit).cast("long").alias("now"),
        )

    total = F.aggregate(F.split(c, ""), start, step, lambda a: a["total"] + a["now"])
    return F.when(F.regexp_like(c, F.lit("^[〇零一二两三四五六七八九十百千]{1,12}$")), total)


def chinese_numeral(n: Column) -> Column:
    """1 to 99 in Chinese (0 too), else the digits."""
    digit = lambda x: F.substr(F.lit(HAN_DIGITS), x.cast("int") + 1, F.lit(1))
    tens, ones = F.floor(n / 10), n % 10
    return (
        F.when(n < 0, n.cast("string")).when(n < 10, digit(n)).when(n == 10, "十").when(n < 20, F.concat(F.lit("十"), digit(ones)))
        .when(n < 100, F.concat(digit(tens), F.lit("十"), F.when(ones == 0, "").otherwise(digit(ones)))).otherwise(n.cast("string"))
    )


def chinese_numeral_long(n: Column) -> Column:
    """1 to 9999 in Chinese with zero fillers; null beyond."""
    digit = lambda x: F.substr(F.lit(HAN_DIGITS), x.cast("int") + 1, F.lit(1))
    q, b, s, g = F.floor(n / 1000), F.floor(n / 100) % 10, F.floor(n / 10) % 10, n % 10
    none = F.lit("")
    return F.when(
        (n > 0) & (n <= 9999),
        F.concat(
            F.when(q > 0, F.concat(digit(q), F.lit("千"))).otherwise(none),
            F.when(b > 0, F.concat(digit(b), F.lit("百"))).when((q > 0) & ((s > 0) | (g > 0)), F.lit("零")).otherwise(none),
            F.when(s > 0, F.concat(F.when((s == 1) & (q == 0) & (b == 0), none).otherwise(digit(s)), F.lit("十"))).when((b > 0) & (g > 0), F.lit("零")).otherwise(none),
            F.when(g > 0, digit(g)).otherwise(none),
        ),
    )


def english_number(c: Column) -> Column:
    c = ascii_lower(c)
    table = F.create_map(*[F.lit(x) for i, p in enumerate(zip(NUMBER_WORDS, ROMAN, strict=True)) for w in p for x in (w, i + 1)])
    return F.coalesce(F.try_element_at(table, c), F.when(F.regexp_like(c, F.lit(r"^\+?[0-9]{1,9}$")), c.try_cast("int")))


# Quality of translations ---------------------------------------------------------------------------


def repair_quote(source: Column, target: Column) -> Column:
    """(text, repairs): one missing closing quote is added if the source ends with a quote."""
    cut = trim_end(target)
    apply = (count_sub(target, "“") == count_sub(target, "”") + 1) & ~F.endswith(cut, F.lit("”")) & F.regexp_like(trim_end(source), F.lit('["”]$'))
    return F.struct(F.when(apply, F.concat(cut, F.lit("”"))).otherwise(target).alias("text"), apply.cast("int").alias("repairs"))


def numbers(c: Column) -> Column:
    """Number tokens that matter: no years 1900 to 2099, no single characters."""
    found = F.regexp_extract_all(c, F.lit(r"(?U)\b\d+(?:\.\d+)?%?\b"), F.lit(0))
    return F.filter(found, lambda x: (F.length(x) > 1) & ~F.coalesce(F.rtrim(x, F.lit("%")).try_cast("int").between(1900, 2099), F.lit(False)))


def untranslated_token(source: Column, translation: Column, preserved: Column) -> Column:
    """A source word of four letters or more stands in the translation."""
    low = ascii_lower(translation)
    tokens = F.filter(F.split(ascii_lower(source), "[^a-z]+"), lambda t: F.length(t) >= 4)
    return ~preserved & F.exists(tokens, lambda t: F.regexp_like(low, F.concat(F.lit("(?<![a-z])"), t, F.lit("(?![a-z])"))))


def accepts_term(source: Column, translation: Column, kind: Column, role: Column, confidence: Column, text: Column, article_type: Column) -> Column:
    """A confirmed term is usable: type, confidence, article rules, preservation, containment."""
    translation = trim_ws(translation)
    preserved = kind.isin("person", "organization") & role.isin("person_name", "organization_name")
    return (
        kind.isin("coinage", "disputed", "person", "location", "organization", "title", "technical") & (confidence >= 85)
        & ((kind != "person") | accepts_persons(article_type)) & ((translation != source) | preserved)
        & ~untranslated_token(source, translation, preserved) & F.contains(text, translation)
    )


def ignored_residual(token: Column, narrative: Column) -> Column:
    return ascii_lower(token).isin(RESIDUAL_STOPWORDS) | F.regexp_like(token, F.lit("^[A-Z]+$")) | (narrative & F.regexp_like(token, F.lit("^[A-Z][a-z]+$")))


def excerpt_around(text: Column, term: Column) -> Column:
    at = F.position(term, ascii_lower(text)) - 1
    start = F.greatest(at - 32, F.lit(0))
    return F.when(at < 0, F.substring(text, 1, 160)).otherwise(trim_ws(F.substr(text, start + 1, at + 96 - start)))


def lint_style_rule(c: Column) -> Column:
    return ~(any_of(c, ['"', "“", "”", "'"]) | any_of(ascii_lower(c), ["such as", "e.g.", "for example", "words like", "use words"]) | F.contains(c, F.lit("词汇")))


# Messages, dictionaries, cards ---------------------------------------------------------------------


def metric(message: Column, field: str) -> Column:
    """The leading digits of the first ``field=value`` of a message; 0 if there are none."""
    value = F.regexp_extract(message, rf"(?:^|;)\s*{field}\s*=\s*([0-9]*)", 1)
    return F.coalesce(F.nullif(value, F.lit("")).try_cast("long"), F.lit(0).cast("long"))


def decode_exchange(exchange: Column, word: Column) -> Column:
    """Forms of a word from ``d:x/p:y``: structs of code and value."""
    parts = F.transform(F.split(exchange, "/"), lambda p: F.struct(F.substring_index(p, ":", 1).alias("code"), trim_ws(F.regexp_replace(p, "^[^:]*:?", "")).alias("value")))
    return F.coalesce(F.filter(parts, lambda x: x["code"].isin(FORM_CODES) & (x["value"] != "") & (x["value"] != word)), F.array().cast("array<struct<code:string,value:string>>"))


def tag_labels(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in TAG_LABELS.items() for x in p])
    return F.transform(words(F.coalesce(c, F.lit(""))), lambda t: F.coalesce(F.try_element_at(table, t), t))


def frequency_text(bnc: Column, frq: Column) -> Column:
    part = lambda name, x: F.when(x > 0, F.concat(F.lit(f"{name} #"), F.format_number(x, 0)))
    return F.concat_ws(" · ", part("BNC", bnc), part("COCA", frq))


def user_level(c: Column) -> Column:
    """Rank 0 to 9 of a level's label; null for other labels."""
    return F.try_element_at(F.create_map(*[F.lit(x) for p in LEVEL_LABELS.items() for x in p]), trim_ws(c))


def lowest_level(tag: Column) -> Column:
    """The lowest rank among the exam codes of a tag."""
    codes = {"zk": 0, "gk": 1, "cet4": 2, "cet6": 3, "ky": 4, "ielts": 5, "toefl": 6, "tem4": 7, "tem8": 8, "gre": 9}
    table = F.create_map(*[F.lit(x) for p in codes.items() for x in p])
    return F.array_min(F.transform(words(ascii_lower(tag)), lambda t: F.try_element_at(table, t)))


def lemma_candidates(w: Column) -> Column:
    """Base forms that a lower-case word may have, in order of preference; repeats stay."""
    none = F.array().cast("array<string>")
    cut = lambda n: F.substr(w, F.lit(1), F.length(w) - n)
    ends = lambda s: F.endswith(w, F.lit(s))
    on = lambda cond, *xs: F.when(cond, F.array(*xs)).otherwise(none)
    add = lambda c, s: F.concat(c, F.lit(s))

    def doubled(stem: Column, l_too: bool) -> Column:
        last, prev = F.right(stem, F.lit(1)), F.substr(stem, F.length(stem) - 1, F.lit(1))
        short = F.substr(stem, F.lit(1), F.length(stem) - 1)
        double = (F.length(stem) >= 3) & (last == prev) & ~last.isin("a", "e", "i", "o", "u")
        if not l_too:
            return on(double, short)
        return F.when(double & (last == "l"), F.array(short, stem)).when(double, F.array(short)).otherwise(none)

    base = F.when(ends("er"), cut(2)).otherwise(cut(3))
    parts = F.concat(
        on(ends("'s") | ends("’s"), cut(2)), on(ends("es"), cut(2), add(cut(2), "e")), on(ends("ies"), add(cut(3), "y")), on(ends("ves"), add(cut(3), "fe"), add(cut(3), "f")),
        on(ends("s"), cut(1), add(cut(1), "e")),
        on(ends("ing"), cut(3), cut(3), add(cut(3), "e"), w), F.when(ends("ing"), doubled(cut(3), True)).otherwise(none),
        on(ends("ied"), add(cut(3), "y")), on(ends("ed"), cut(2), cut(2), add(cut(2), "e")), F.when(ends("ed"), doubled(cut(2), False)).otherwise(none),
        on(ends("iest"), add(cut(4), "y")), on(ends("er") | ends("est"), cut(2)), on(ends("er"), cut(2), add(cut(2), "e")), on(ends("est"), cut(3), cut(3), add(cut(3), "e")),
        F.when(ends("er") | ends("est"), doubled(base, False)).otherwise(none),
    )
    return F.when(F.length(w) < 4, none).otherwise(F.filter(parts, lambda x: (F.octet_length(x) >= 2) & (x != w)))


def context_around(text: Column, word: Column) -> Column:
    """60 characters before a word to 180 behind it, else the first 240."""
    low, needle = ascii_lower(text), ascii_lower(word)
    at = F.regexp_instr(low, F.concat(F.lit("(?<![a-z])"), quoted(needle), F.lit("(?![a-z])"))) - 1
    start = F.greatest(at - 60, F.lit(0))
    return F.when((trim_ws(text) == "") | (word == ""), "").when(at < 0, F.substring(text, 1, 240)).otherwise(trim_ws(F.substr(text, start + 1, at + F.length(word) + 180 - start)))


def search_snippet(text: Column, query: Column) -> Column:
    """81 characters before the first hit to 120 behind it, on one line, with ellipses."""
    at = F.position(ascii_lower(query), ascii_lower(text)) - 1
    start = F.greatest(at - 81, F.lit(0))
    end = F.least(at + F.length(query) + 120, F.length(text))
    body = collapse(F.substr(text, start + 1, end - start))
    return F.when(at >= 0, F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise("")))


def structured_text(c: Column) -> Column:
    """The translated text of a model's JSON answer, or of what is left of a truncated one."""
    whole = F.get_json_object(trim_ws(c), "$.translatedText")
    cut = F.regexp_extract(c, r'"translated(?:T|_t)ext"[^"]*"((?:[^"\\]|\\.)*)"', 1)
    text = trim_ws(F.coalesce(whole, F.get_json_object(F.concat(F.lit('{"t":"'), cut, F.lit('"}')), "$.t")))
    return F.nullif(text, F.lit(""))


def replace_terms(text: Column, terms: list[dict]) -> Column:
    """Terms (source, target) replaced at boundaries of Latin identifiers, longer sources first."""
    for t in sorted(terms, key=lambda t: -len(t["source"])):
        text = replace_term(text, F.lit(t["source"]), F.lit(t["target"]))
    return text


def replace_aliases(text: Column, terms: list[dict]) -> Column:
    """Other renderings (source) replaced by the canonical one (target), longer ones first."""
    for t in sorted(terms, key=lambda t: -len(t["source"].strip())):
        alias, target = t["source"].strip(), t["target"]
        if alias and alias not in target and target not in alias:
            text = F.replace(text, F.lit(alias), F.lit(target))
    return text


def protected_metadata(c: Column) -> Column:
    """A short chunk of addresses or correspondence of an academic text."""
    signs = any_of(F.lower(c), ["@", "department of ", "university of ", "corresponding author"])
    return (trim_ws(c) != "") & signs & (F.length(c) < 400)


def chapter_title(ncx: Column, nav: Column, heading: Column, head: Column, order: Column) -> Column:
    """(title, source): the first title there is, and where it comes from."""
    named = [(ncx, "EpubNcx"), (nav, "EpubNav"), (heading, "EpubHtmlTitle"), (head, "EpubHtmlTitle"), (F.concat(F.lit("Chapter "), (order + 1).cast("string")), "EpubSpineFallback")]
    return F.coalesce(*[F.when(title.isNotNull(), F.struct(title.alias("title"), F.lit(source).alias("source"))) for title, source in named])


def replace_once(text: Column, old: Column, new: Column) -> Column:
    """The first occurrence replaced; null if there is none."""
    at = F.position(old, text)
    return F.when((old == "") | (old == new), text).when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(old), F.length(text))))


CHAPTER = "^(第\\s*)([0-9〇零一二两三四五六七八九十百千]+)(\\s*[章节篇部卷回])"


def toc_colon(source: Column, title: Column) -> Column:
    """A full-width colon where the source has one, else none behind the chapter's number."""
    wide = F.regexp_replace(F.replace(title, F.lit(":"), F.lit("：")), r"：\s+", "：")
    prefix = F.regexp_extract(wide, CHAPTER, 0)
    rest = trim_start(F.substr(wide, F.length(prefix) + 1, F.length(wide)))
    with_colon = F.when(F.contains(wide, F.lit("：")) | (prefix == "") | (rest == ""), wide).otherwise(F.concat(prefix, F.lit("："), rest))
    head = F.regexp_extract(title, CHAPTER, 0)
    tail = trim_start(F.substr(title, F.length(head) + 1, F.length(title)))
    bare = trim_start(F.regexp_replace(tail, "^[：:]", ""))
    without = F.when((head == "") | ~F.regexp_like(tail, F.lit("^[：:]")), title).when(bare == "", trim_end(head)).otherwise(F.concat(head, F.lit(" "), bare))
    return F.when(F.regexp_like(source, F.lit("[:：]")), with_colon).otherwise(without)


def epub_path(base: Column, href: Column) -> Column:
    """A path inside an archive, without fragments, dots and double slashes."""
    raw = F.replace(F.concat_ws("/", base, F.substring_index(href, "#", 1)), F.lit("\\"), F.lit("/"))
    raw = F.when(F.startswith(href, F.lit("/")), F.substring_index(href, "#", 1)).otherwise(raw)
    none = F.array().cast("array<string>")
    return F.array_join(F.aggregate(F.split(raw, "/"), none, lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))), "/")
