"""Benchmark decontamination over a stored, distributed positional inverted index.

The index is a table. Its rows are segments of about ``SEGMENT`` bytes of training text, each with its
documents and, for every term in them, the ascending list of the places at which it stands, coded as
differences. Segments are built where their documents are read and are searched independently.

Test items become phrases of ``window`` terms. How often each of their terms stands in the whole index is
summed over the segments first, so every phrase knows its rarest term. A segment takes that term's list,
shifted by its place in the phrase, and intersects it with the shifted lists of the other terms, rarer ones
first: what is left are the exact matches. Proximity matches need all words of the phrase, in any order,
within a stretch as long as the phrase (and ``slack`` words more): places of the rarest term around which a
term is too far or too rare fall away, and the stretches around the others are counted out. Both kinds are
verified by a second hash of the words, so that terms have 128 bits.

Items are a stated query set. They are read in blocks of at most ``BLOCK`` phrases, broadcast one at a time
(100 bytes a phrase); the results of several blocks are stored and meet the segments in the end.

Defined results: null has no words; an item of fewer words than the window is one phrase, of none is
none; items of one name count once, a null name is the empty one; repeated rows are documents of their own;
without items nothing is hit; an empty table gives an empty result; columns named like the new ones are
replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytestext import ALNUM, covered, groups_of, split_words
from .exchange import Shelf, boxed, frugal, pack, row_lengths, row_texts, tally, unboxed, unpack

#: Phrases in a block, bytes of text in a segment, places that are worked on at once.
BLOCK, SEGMENT, STEP = 200_000, 2_000_000, 500_000
#: Of the stored index: row groups of a few segments. Parquet's writer looks at their size after 100 rows else.
STORED = {"compression": "zstd", "parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}
RESULT = "n_words long, n_hit long, items array<string>, hits array<struct<first:int,behind:int>>, near array<string>"


class Postings:
    """The positional inverted index of a segment: sorted distinct terms, and the places of each."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, places: np.ndarray):
        self.terms, self.counts, self.places = terms, counts, places
        self.begin = np.concatenate([[0], np.cumsum(counts)])
        self.wide = len(places) + 1
        self.keyed = np.repeat(np.arange(len(terms)), counts) * self.wide + places

    @classmethod
    def of(cls, words: np.ndarray) -> Postings:
        terms, counts = tally(words)
        return cls(terms, counts, np.argsort(words, kind="stable"))

    def number(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term, -1 for those that do not occur."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def within(self, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How often terms stand at low or behind it and before high."""
        base = number * self.wide
        return np.searchsorted(self.keyed, base + high) - np.searchsorted(self.keyed, base + low)

    def dump(self) -> tuple[bytes, bytes, bytes]:
        gaps = np.diff(self.places, prepend=0)
        gaps[self.begin[:-1]] = self.places[self.begin[:-1]]
        return pack(self.terms), self.counts.astype("<i4").tobytes(), gaps.astype("<i4").tobytes()

    @classmethod
    def load(cls, terms: bytes, counts: bytes, places: bytes) -> Postings:
        counts = np.frombuffer(counts, dtype="<i4").astype(np.int64)
        gaps = np.frombuffer(places, dtype="<i4").astype(np.int64)
        run = np.cumsum(gaps)
        begin = np.cumsum(counts) - counts
        before = np.where(begin > 0, run[begin - 1], 0) if len(begin) else begin
        return cls(unpack(terms), counts, run - np.repeat(before, counts))


@dataclass
class Phrases:
    """A block: distinct phrases of up to ``width`` terms, and the items of each."""

    terms: np.ndarray  # (n, width)
    second: np.ndarray  # (n, width): other hashes of the same words
    sizes: np.ndarray
    items: list[list[int]]  # of each phrase
    names: list[str]

    def rank(self, vocabulary: np.ndarray, often: np.ndarray) -> None:
        """Orders the columns of each phrase by how often their terms stand in the index, rarest first."""
        n, width = self.terms.shape
        real = np.arange(width)[None, :] < self.sizes[:, None]
        count = np.where(real, often[np.searchsorted(vocabulary, self.terms)], np.iinfo(np.int64).max)
        self.order = np.argsort(count, axis=1, kind="stable")
        same = (self.terms[:, :, None] == self.terms[:, None, :]) & real[:, None, :]
        first = np.argmax(same, axis=2) == np.arange(width)[None, :]
        self.times = np.where(real & first, same.sum(axis=2), 0)  # 0 at a repeated term's later places

    def vocabulary(self) -> np.ndarray:
        return np.unique(self.terms)


def exact(index: Postings, block: Phrases, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, place) of every occurrence within one document. doc: the document of each place."""
    out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    for which, at, number in _rarest(index, block):
        at = at - block.order[which, 0]
        size = block.sizes[which]
        good = (at >= 0) & (at + size <= len(index.places))
        which, at, size = which[good], at[good], size[good]
        good = doc[at] == doc[at + size - 1]
        which, at, size = which[good], at[good], size[good]
        for k in range(1, block.terms.shape[1]):  # the next rarest term of each phrase
            off = block.order[which, k]
            real = off < size
            good = ~real | (index.within(np.where(real, number[which, off], 0), at + off, at + off + 1) > 0)
            which, at, size = which[good], at[good], size[good]
        out.append((which, at))
    return np.concatenate([w for w, _ in out]), np.concatenate([a for _, a in out])


def near(index: Postings, block: Phrases, doc: np.ndarray, first: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, place) of stretches as long as the phrase and ``slack`` more, cut at the document's ends, that
    hold all its words as often as it does, in any order. first: where each document begins, and the end."""
    out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    width = block.terms.shape[1]
    for which, at, number in _rarest(index, block):
        long = block.sizes[which] + slack
        begin, end = first[doc[at]], first[doc[at] + 1]

        def enough(which, low, high, k, number=number):
            column = block.order[which, k]
            times = block.times[which, column]
            return (times == 0) | (index.within(np.where(times > 0, number[which, column], 0), low, high) >= times)

        for k in range(width):
            good = enough(which, np.maximum(at - long + 1, begin), np.minimum(at + long, end), k)
            which, at, long, begin, end = which[good], at[good], long[good], begin[good], end[good]
        back = np.arange(len(which)).repeat(long)
        start = at[back] - (np.arange(len(back)) - np.repeat(np.cumsum(long) - long, long))
        low, high = np.maximum(start, begin[back]), np.minimum(start + long[back], end[back])
        which = which[back]
        for k in range(width):
            good = enough(which, low, high, k)
            which, low, high = which[good], low[good], high[good]
        out.append((which, low))
    return np.concatenate([w for w, _ in out]), np.concatenate([a for _, a in out])


def _rarest(index: Postings, block: Phrases) -> Iterator[tuple]:
    """(phrase, a place of its rarest term) of phrases whose terms all occur, about STEP at once, and the
    terms' numbers."""
    number = index.number(block.terms)
    live = np.flatnonzero(((number >= 0) | (np.arange(number.shape[1])[None, :] >= block.sizes[:, None])).all(axis=1))
    rare = number[live, block.order[live, 0]]
    count = index.counts[rare] if len(live) else np.zeros(0, dtype=np.int64)
    for a, b in groups_of(count.tolist(), STEP):
        own = count[a:b]
        which = np.repeat(live[a:b], own)
        step = np.arange(len(which)) - np.repeat(np.cumsum(own) - own, own)
        yield which, index.places[np.repeat(index.begin[rare[a:b]], own) + step], number


def blocks_of(benchmark: DataFrame, item: str, column: str, window: int) -> Iterator[Phrases]:
    """The phrases of all items in blocks of at most BLOCK, one item at least."""
    rows: dict[bytes, tuple[int, list[int]]] = {}
    names: list[str] = []

    def block() -> Phrases:
        both = np.frombuffer(b"".join(rows), dtype="<u8").reshape(len(rows), 2, window)
        return Phrases(both[:, 0], both[:, 1], np.array([n for n, _ in rows.values()], dtype=np.int64), [sorted(set(x)) for _, x in rows.values()], names)

    for row in benchmark.selectExpr(f"CAST(`{item}` AS STRING) AS item", f"`{column}` AS text").toLocalIterator(prefetchPartitions=False):
        words = split_words([(row["text"] or "").encode("utf-8", "surrogatepass")], ALNUM, lower=True)
        size = min(window, len(words.starts))
        if not size:
            continue
        if rows and len(rows) + len(words.starts) - size + 1 > BLOCK:
            yield block()
            rows, names = {}, []
        both = np.zeros((len(words.starts) - size + 1, 2, window), dtype="<u8")
        for half in (0, 1):
            both[:, half, :size] = np.lib.stride_tricks.sliding_window_view(words.hashes(bool(half)), size)
        for x in both:
            rows.setdefault(x.tobytes(), (size, []))[1].append(len(names))
        names.append(row["item"] or "")
    if rows:
        yield block()


def build_index(docs: DataFrame, column: str = "text") -> DataFrame:
    """The index's rows: segment, rows (the documents), sizes (their words), terms, counts, places. To be
    stored before it is used."""

    def build(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context, number = TaskContext.get(), 0
        task = context.partitionId() if context else 0
        for batch in batches:
            for a, b in groups_of(row_lengths(batch, column), SEGMENT):
                words = split_words(row_texts(batch.slice(a, b - a), column), ALNUM, lower=True)
                terms, counts, places = Postings.of(words.hashes()).dump()
                box = batch.column("row").slice(a, b - a)
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array([f"{task}/{number}"]), "rows": pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), box), "sizes": pa.array([words.lengths.astype("<i4").tobytes()], pa.binary()),
                    "terms": pa.array([terms], pa.binary()), "counts": pa.array([counts], pa.binary()), "places": pa.array([places], pa.binary()),
                })
                number += 1

    box = T.StructType(docs.schema.fields)
    fields = [T.StructField("segment", T.StringType()), T.StructField("rows", T.ArrayType(box))] + [T.StructField(x, T.BinaryType()) for x in ("sizes", "terms", "counts", "places")]
    return boxed(docs).mapInArrow(frugal(build), T.StructType(fields))


def frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the terms (a block's, sorted) stands in the whole index; reads no texts or places."""
    asked = index.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            n = np.zeros(len(asked.value), dtype=np.int64)
            for own, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own, counts = unpack(own), np.frombuffer(counts, dtype="<i4")
                if len(own):
                    at = np.minimum(np.searchsorted(own, asked.value), len(own) - 1)
                    n += np.where(own[at] == asked.value, counts[at], 0)
            yield pa.RecordBatch.from_pydict({"term": pa.array(np.flatnonzero(n), pa.int64()), "n": pa.array(n[n > 0], pa.int64())})

    out = np.zeros(len(terms), dtype=np.int64)
    for row in index.select("terms", "counts").mapInArrow(frugal(count), "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[row[0]] = row[1]
    return out


class Found:
    """What blocks have found in a segment: hit places, and the items of each document."""

    def __init__(self, sizes: np.ndarray):
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.hit = np.zeros(int(self.first[-1]), dtype=bool)
        self.items: list[set] = [set() for _ in sizes]
        self.near: list[set] = [set() for _ in sizes]

    def search(self, texts: list[bytes], index: Postings, block: Phrases, slack: int) -> None:
        doc = np.repeat(np.arange(len(self.items)), np.diff(self.first))
        which, at = exact(index, block, doc)
        far, place = near(index, block, doc, self.first, slack)
        if not len(far):  # exact matches are proximity matches too
            return
        second, spot = np.zeros(len(self.hit), dtype=np.uint64), np.unique(doc[place])
        words = split_words([texts[d] for d in spot], ALNUM, lower=True)
        second[np.concatenate([np.arange(self.first[d], self.first[d + 1]) for d in spot])] = words.hashes(True)
        steps = np.arange(block.terms.shape[1])
        inside = lambda p, a: second[np.minimum(a[:, None] + steps, len(second) - 1)] * (steps < block.sizes[p][:, None])
        good = (inside(which, at) == block.second[which]).all(axis=1)
        which, at = which[good], at[good]
        if slack:
            good = np.array([not Counter(block.second[p, : block.sizes[p]].tolist()) - Counter(second[a : min(a + block.sizes[p] + slack, self.first[doc[a] + 1])].tolist()) for p, a in zip(far, place, strict=True)])
        else:
            good = (np.sort(inside(far, place), axis=1) == np.sort(block.second[far], axis=1)).all(axis=1)
        far, place = far[good], place[good]
        for size in np.unique(block.sizes[which]):
            self.hit |= covered(at[block.sizes[which] == size], int(size), len(self.hit))
        for sets, phrases, places in ((self.items, which, at), (self.near, far, place)):
            for d, p in np.unique(np.stack([doc[places], phrases], axis=1), axis=0).tolist():
                sets[d].update(block.names[i] for i in block.items[p])

    def spans(self, a: int, b: int) -> list[dict]:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], self.hit[a:b], [False]]).astype(np.int8)))
        return [{"first": int(p), "behind": int(q)} for p, q in edge.reshape(-1, 2)]

    def result(self, rows):
        """The documents with what has been found in them."""
        import pyarrow as pa

        n = np.diff(np.concatenate([[0], np.cumsum(self.hit)])[self.first])
        spans = [self.spans(a, b) if k else [] for a, b, k in zip(self.first[:-1].tolist(), self.first[1:].tolist(), n.tolist(), strict=True)]
        return {
            "row": rows, "n_words": pa.array(np.diff(self.first), pa.int64()), "n_hit": pa.array(n, pa.int64()), "items": pa.array([sorted(x) for x in self.items], pa.list_(pa.string())),
            "hits": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("behind", pa.int32())]))), "near": pa.array([sorted(x) for x in self.near], pa.list_(pa.string())),
        }


def _segments(batch, column: str) -> Iterator[tuple]:
    """(number in the batch, documents, texts, words of each, postings)."""
    import pyarrow as pa

    for i in range(batch.num_rows):
        rows = batch.column("rows")[i].values
        texts = row_texts(pa.table({"row": rows}), column)
        yield i, rows, texts, np.frombuffer(batch.column("sizes")[i].as_py(), dtype="<i4").astype(np.int64), Postings.load(*(batch.column(c)[i].as_py() for c in ("terms", "counts", "places")))


def contamination(docs: DataFrame, benchmark: DataFrame, column: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, slack: int = 0) -> DataFrame:
    """The columns of docs, then n_words, n_hit (words inside an occurrence of a window of an item),
    items (the sorted names of the items with occurring windows), ``hits``: the ranges of hit words (first,
    behind the last), and ``near``: the sorted names of the items with proximity matches."""
    spark, shelf = docs.sparkSession, Shelf(docs.sparkSession)
    index = shelf.put("index", build_index(docs, column), **STORED)
    schema = T.StructType([T.StructField("row", T.StructType(docs.schema.fields)), *T.StructType.fromDDL(RESULT).fields])
    new = ("n_words", "n_hit", "items", "hits", "near")

    def searching(block: Phrases):
        words = block.vocabulary()
        block.rank(words, frequencies(index, words))
        shared = spark.sparkContext.broadcast(block)

        def search(batches):
            import pyarrow as pa

            for batch in batches:
                for _, rows, texts, sizes, postings in _segments(batch, column):
                    found = Found(sizes)
                    found.search(texts, postings, shared.value, slack)
                    yield pa.RecordBatch.from_pydict(found.result(rows))

        def keep(batches):
            import pyarrow as pa

            for batch in batches:
                for i, _, texts, sizes, postings in _segments(batch, column):
                    found = Found(sizes)
                    found.search(texts, postings, shared.value, slack)
                    yield pa.RecordBatch.from_pydict({
                        "segment": batch.column("segment").slice(i, 1), "hit": pa.array([np.packbits(found.hit).tobytes()], pa.binary()),
                        "items": pa.array([[sorted(x) for x in found.items]], pa.list_(pa.list_(pa.string()))), "near": pa.array([[sorted(x) for x in found.near]], pa.list_(pa.list_(pa.string()))),
                    })

        return shared, frugal(search), frugal(keep)

    blocks = blocks_of(benchmark, item, item_text, window)
    first, kept, more = next(blocks, None), [], None
    if first is not None:
        more = next(blocks, None)
    if more is None:
        empty = Phrases(*(np.zeros((0, window), dtype=np.uint64) for _ in range(2)), np.zeros(0, dtype=np.int64), [], [])
        return unboxed(index.mapInArrow(searching(first or empty)[1], schema), docs, *new)
    while first is not None:  # one block at a time, each with its own result
        shared, _, keep = searching(first)
        kept.append(shelf.put(f"found_{len(kept)}", index.mapInArrow(keep, "segment string, hit binary, items array<array<string>>, near array<array<string>>")))
        shared.unpersist()
        first, more = more, next(blocks, None)

    def combine(left, right):
        import pyarrow as pa

        tables = []
        left = left.combine_chunks().to_batches()
        for batch in left:
            for _, rows, _, sizes, _ in _segments(batch, column):
                found = Found(sizes)
                for own in right.to_pylist():
                    found.hit |= np.unpackbits(np.frombuffer(own["hit"], dtype=np.uint8), count=len(found.hit)).astype(bool)
                    for sets, given in ((found.items, own["items"]), (found.near, own["near"])):
                        for mine, x in zip(sets, given, strict=True):
                            mine.update(x)
                tables.append(pa.table(found.result(rows)))
        return pa.concat_tables(tables)

    union = kept[0]
    for x in kept[1:]:
        union = union.union(x)
    return unboxed(index.groupBy("segment").cogroup(union.groupBy("segment")).applyInArrow(combine, schema), docs, *new)


def cut_hits(text: bytes, hits: list[tuple[int, int]]) -> bytes:
    """The text without the hit words' bytes."""
    words = split_words([text], ALNUM, lower=True)
    out, last = [], 0
    for first, behind in hits:
        out.append(text[last : words.starts[first] - 1])
        last = words.ends[behind - 1] - 1
    return b"".join([*out, text[last:]])
