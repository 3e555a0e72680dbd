"""The queries that have no SQL, each against a plain computation of the same rows."""

import re
from collections import Counter

import numpy as np
import pytest

from quire import registry
from quire.functions import fuzzy as Z
from quire.functions import text as X
from quire.plans.standins import pairs, snippets
from quire.sources.tables import table


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {(r.task, r.idx): (r.source, r.target) for r in pairs(spark, sf_dir).collect()}


def results(spark, sf_dir, name, *key):
    rows = registry.queries()[name](spark, sf_dir).collect()
    out = {tuple(r[k] for k in key): r for r in rows}
    assert len(out) == len(rows)
    return out


def common_subsequence(a: str, b: str) -> int:
    row = np.zeros(len(b) + 1, dtype=int)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + [x == y for y in b])
        row = np.maximum.accumulate(row)
    return int(row[-1])


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def level(a: str, b: str) -> str:
    """Of terms that both have a key."""
    ka, kb = Z.term_key(a), Z.term_key(b)
    if ka == kb:
        return "Exact"
    if ka in kb or kb in ka:
        return "Contains"
    size = max(len(ka), len(kb))
    if min(len(ka), len(kb)) < 4 or abs(len(ka) - len(kb)) / size > 0.3:
        return "None"
    prefix = next((i for i, (x, y) in enumerate(zip(ka, kb, strict=False)) if x != y), min(len(ka), len(kb)))
    alike, order, head = 1 - edits(ka, kb) / size, common_subsequence(ka, kb) / size, prefix / size
    return "High" if alike >= 0.85 or order >= 0.9 else "Low" if alike >= 0.7 or order >= 0.8 or head >= 0.6 else "None"


def packed(text: str, limit: int) -> list[str]:
    """Lines packed greedily; the texts here hold no images and no tables."""
    out, now = [], ""
    for line in text.removesuffix("\n").split("\n") if text else []:
        if now and len((now + line).encode()) > limit:
            out.append(now)
            now = ""
        now += line + "\n"
    return [*out, now] if now else out


def test_longest_common_subsequence(spark, sf_dir, texts):
    found = results(spark, sf_dir, "txt43_lcs", "task", "idx")
    assert {k: r.out for k, r in found.items()} == {k: common_subsequence(*v) for k, v in texts.items()}


def test_match_levels(spark, sf_dir, texts):
    want = {k: level(*v) for k, v in texts.items() if all(map(Z.term_key, v))}
    found = {k: r.out for k, r in results(spark, sf_dir, "txt45_match_level", "task", "idx").items()}
    assert {k: found[k] for k in want} == want and set(found) == set(texts)
    family = results(spark, sf_dir, "win02_family_match", "task", "idx")
    assert {k: family[k].family for k in want} == {k: v in ("High", "Exact") for k, v in want.items()}


@pytest.mark.parametrize(("a", "b"), [("", ""), ("", "abc"), ("kitten", "sitting"), ("a" * 50, "a" * 40 + "b"), ("词语" * 30, "词" * 45), ("abcdefgh" * 9, "bcdefgha" * 8)])
def test_edit_distance(a, b):
    assert Z.distance(a, b) == edits(a, b) == Z.distance(b, a)


def test_masks_blank_and_change_nothing_else(spark, sf_dir):
    own = {(r.id, r.n): r.t for r in snippets(spark, sf_dir).collect()}
    gone = [r"https?://\S", r"<[A-Za-z/][^>]*>", r"`[^`\n]+`", r"\[[0-9]+\]", r"\((?:1[89]|20)\d\d\)"]
    for name in ("txt55_mask", "txt56_mask_special"):
        found = results(spark, sf_dir, name, "id", "n")
        assert set(found) == set(own)
        for k, r in found.items():
            assert len(r.out) == len(own[k]) and all(x == y or x == " " and y != "\n" for x, y in zip(r.out, own[k], strict=True))
            assert not any(re.search(p, r.out) for p in gone)
            if not re.search(r"[`<\[(（@/.0-9]|[a-z][A-Z]|[A-Z]{2}|package|library|references|bibliography|cited", own[k], re.I):
                assert r.out == own[k]
    line = "Smith and Doe (2001) use `x`, see [a](http://b.c/d) and doi: 10.1/x now"
    assert Z.mask(line).split() == ["use", ",", "see", "[a](", ")", "and", "now"]
    assert Z.mask_special("The R package zoo, version GNU 3.4.5, in McGill.\n# References\nx").split() == ["The", ",", "version", ",", "in", "."]


def test_residual_of_masked_texts(spark, sf_dir, texts):
    want = {}
    for k, (source, target) in texts.items():
        own = {w.lower() for w in re.findall("[A-Za-z]{2,}", Z.mask(source))}
        kept = (w for w in re.findall("[A-Za-z]{2,}", Z.mask(target)) if w.lower() in own and w.lower() not in X.RESIDUAL_STOPWORDS and not re.fullmatch("[A-Z]+|[A-Z][a-z]+", w))
        want |= {(*k, w): n for w, n in Counter(w.lower() for w in kept).items()}
    assert {k: r.n for k, r in results(spark, sf_dir, "qa01_masked_residual", "task", "idx", "term").items()} == want


def test_speech_chunks(spark, sf_dir):
    def chunks(text: str) -> list[str]:
        out, rest = [], text.strip()
        while rest:
            size = end = 0
            while end < len(rest) and size + len(rest[end].encode()) <= 1800:
                size += len(rest[end].encode())
                end += 1
            if end < len(rest):
                at, cut = 0, end
                for i, c in enumerate(rest[:end]):
                    if c in " .!?;\n。！？；" and at >= size * 3 // 5:
                        cut = i + 1
                    at += len(c.encode())
                end = cut
            out.append(rest[:end].strip())
            rest = rest[end:].lstrip(" \t\n\r\x0b\f")
        return [x for x in out if x]

    made = {r.doc_id: chunks(r.text) for r in table(spark, sf_dir, "documents").collect() if r.text}
    found = results(spark, sf_dir, "chk15_speech_chunks", "doc_id")
    assert {k[0]: (r.n, r.largest) for k, r in found.items()} == {k: (len(v), max(len(x.encode()) for x in v)) for k, v in made.items() if v}


def test_reference_aware_chunks(spark, sf_dir, texts):
    label = lambda x: x.strip().lstrip("#").strip().rstrip(":").lower()
    want = {}
    for k, (source, target) in texts.items():
        rows = f"{source}\n# References\n{target}\n# Tail\nend".split("\n")
        start = next(i for i, x in enumerate(rows) if label(x) in X.REFERENCE_HEADINGS)
        end = next(i for i, x in enumerate(rows) if i > start and x.strip().startswith("#") and label(x) not in X.REFERENCE_HEADINGS)
        for part, text in (("body", "\n".join(rows[:start])), ("references", "\n".join(rows[start:end]) + "\n"), ("tail", "\n".join(rows[end:]))):
            if n := len(packed(text, 300)):
                want[*k, part] = n
    assert {k: r.n for k, r in results(spark, sf_dir, "chk02_reference_chunks", "task", "idx", "part").items()} == want


def test_academic_chunks(spark, sf_dir, texts):
    want: Counter = Counter()
    for source, _ in texts.values():
        parts = [b.strip() for b in f"Department of X\na@b.c\n\n{source}".split("\n\n") if b.strip()]
        meta = [bool(re.search(r"(?i)@|department of |university of |corresponding authors?:|^#+ addresses", b)) and len(b) < 400 for b in parts]
        for part, is_meta in (("metadata", True), ("body", False)):
            want[part] += len(packed("\n\n".join(b for b, m in zip(parts, meta, strict=True) if m == is_meta), 300))
    assert {k[0]: r.n for k, r in results(spark, sf_dir, "chk03_academic_chunks", "part").items()} == {k: n for k, n in want.items() if n}


def test_every_query_has_sql_or_a_test_here():
    with open(__file__) as f:
        own = f.read()
    assert not [n for n in set(registry.queries()) - set(registry.oracle_sql()) if f'"{n}"' not in own]
