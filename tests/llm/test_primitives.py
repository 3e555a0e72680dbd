import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bytestext as T
from quire.llm import exchange as E
from quire.llm import near
from quire.llm.lines import CuckooFilter, Shard

texts = st.lists(st.text(alphabet="aAbZ é\n\t 你-.", max_size=40), max_size=6)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words_are_those_of_the_pattern(ts):
    data = [t.encode() for t in ts]
    w = T.split_words(data)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in ts]
    assert w.lengths.tolist() == [len(x) for x in want]
    raw = w.data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(w.starts, w.ends, strict=True)] == [x for y in want for x in y]
    low = T.split_words(data, T.ALNUM, lower=True)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert low.lengths.tolist() == [len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(lower))) for t in ts]


def test_hashes_tell_words_apart():
    words = [b"a", b"aa", b"abcdefgh", b"abcdefghi", b"abcdefgh\x00", b"x" * 100, b"x" * 101]
    w = T.split_words([b" ".join(words)])
    assert len(set(w.hashes().tolist())) == len(words)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 35])
def test_windows_depend_on_content_and_order(n):
    r = np.random.default_rng(n)
    x = r.integers(0, 3, 400).astype(np.uint64)
    h = T.windows(x, n)
    seen = {}
    for i, v in enumerate(h.tolist()):
        assert seen.setdefault(tuple(x[i : i + n]), v) == v
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packed_keys_return(keys):
    k = np.unique(np.array(keys, dtype=np.uint64))
    assert (E.unpack(E.pack(k)) == k).all()
    assert sum(b - a for _, a, b in E.by_shard(k, 7)) == len(k)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=18), st.lists(st.integers(0, 4), max_size=18), st.integers(0, 9))
def test_banded_alignment_is_the_edit_distance(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    x, y = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    assert near.banded(x, y, most) == (row[-1] <= most)
    assert near.within(x.astype(np.uint64), y.astype(np.uint64), most) == (row[-1] <= most)


def test_cuckoo_filter_has_no_false_negatives_and_deletes():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 2**64, 5000, dtype=np.uint64))
    f = CuckooFilter.of(keys)
    assert f.maybe(keys).all()
    assert f.maybe(r.integers(0, 2**64, 20000, dtype=np.uint64)).mean() < 0.01
    f.delete(keys[:2500])
    assert f.maybe(keys[2500:]).all() and f.maybe(keys[:2500]).mean() < 0.05


def test_shard_is_reversible():
    keys = np.arange(1, 2000, dtype=np.uint64) * np.uint64(2**50 + 7)
    keys.sort()
    s, low = Shard.empty(), lambda k: k ^ np.uint64(3)
    s.change(keys, low(keys), np.full(len(keys), 2))
    s.change(keys[:100], low(keys[:100]), np.full(100, 3))
    s.change(keys[:100], low(keys[:100]), np.full(100, -3))
    s.change(keys[500:], low(keys[500:]), np.full(len(keys) - 500, -2))
    assert s.keys.tolist() == keys[:500].tolist() and set(s.refs.tolist()) == {2}
    assert s.references(keys, low(keys)).tolist() == [2] * 500 + [0] * (len(keys) - 500)
    assert s.filter.maybe(keys[:500]).all()
