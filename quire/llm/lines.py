"""Line dedup that can be undone: sharded cuckoo filters over exact reference-count tables.

Every shard of keys holds a table of how many documents contain each line key, and a cuckoo filter of
the keys in that table. Adding documents raises counts, deleting them lowers counts and takes keys that
reach zero out of filter and table again, so the state after a deletion equals the state without those
documents. Lookups ask the filter first and the exact table only for keys that may be present; a false
positive of the filter therefore never drops a line. Keys are compared by hashes of 128 bits.

Defined results: a null or empty text is one empty line; keys shorter than ``least_chars`` code points
(empty ones, at 1) are never dropped; repeated rows count as that many documents; an empty table gives
an empty result; columns of the input that are named like a new column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytestext import M1, M2, R32, SPACES, wide_place, wide_tally
from .exchange import FOUND, Shelf, boxed_schema, by_shard, chunk_count, found_keys, found_table, gathered, in_chunks, lows_of, pack, row_texts, shard_count, strings, unboxed, unpack

SLOTS = 4
STATE = "shard int, shards int, keys binary, lows binary, refs binary, filter binary"
STATED = "chunk int, shard int, keys binary, lows binary, refs binary"


class CuckooFilter:
    """16-bit fingerprints in buckets of four, each key in one of two buckets."""

    def __init__(self, table: np.ndarray):
        self.table = table  # (buckets, SLOTS), 0 is free

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * 0.8 < n + 1:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), dtype=np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        out = cls.sized(len(keys))
        while not out.insert(keys):
            out = cls(np.zeros((len(out.table) * 2, SLOTS), dtype=np.uint16))
        return out

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = ((keys * M2) >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, ((keys * M1) >> R32).astype(np.int64) & (len(self.table) - 1)

    def _other(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return place ^ ((mark.astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1))

    def insert(self, keys: np.ndarray, kicks: int = 500) -> bool:
        """False if the filter is too full; build a larger one from the table then."""
        mark, place = self._places(keys)
        rng = np.random.default_rng(len(keys))
        for _ in range(kicks):
            if not len(mark):
                return True
            order = np.argsort(place, kind="stable")
            mark, place = mark[order], place[order]
            rank = np.arange(len(place)) - np.searchsorted(place, place)
            free = self.table[place] == 0
            seat = np.argmax(np.cumsum(free, axis=1) == (rank + 1)[:, None], axis=1)
            fits = rank < free.sum(axis=1)
            self.table[place[fits], seat[fits]] = mark[fits]
            mark, place = mark[~fits], place[~fits]
            if not len(mark):
                return True
            alone = np.unique(place, return_index=True)[1]  # one eviction per full bucket and round
            wait = np.setdiff1d(np.arange(len(place)), alone)
            seat = rng.integers(0, SLOTS, len(alone))
            out = self.table[place[alone], seat]
            self.table[place[alone], seat] = mark[alone]
            place = np.concatenate([self._other(place[alone], out), self._other(place[wait], mark[wait])])
            mark = np.concatenate([out, mark[wait]])
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Takes out keys that were inserted."""
        mark, place = self._places(keys)
        other = self._other(place, mark)
        for m, p, q in zip(mark, place, other, strict=True):
            for at in (p, q):
                if len(hit := np.flatnonzero(self.table[at] == m)):
                    self.table[at, hit[0]] = 0
                    break

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        mark, place = self._places(keys)
        own = (self.table[place] == mark[:, None]).any(axis=1)
        return own | (self.table[self._other(place, mark)] == mark[:, None]).any(axis=1)


class Shard:
    """One shard's filter and its table of references. Keys have 128 bits; the filter takes the high half."""

    def __init__(self, keys: np.ndarray, lows: np.ndarray, refs: np.ndarray, filter_: CuckooFilter | None = None):
        self.keys, self.lows, self.refs = keys, lows, refs
        self.filter = filter_ or CuckooFilter.of(keys)

    @classmethod
    def empty(cls) -> Shard:
        none = np.zeros(0, dtype=np.uint64)
        return cls(none, none, np.zeros(0, dtype=np.int64))

    def change(self, keys: np.ndarray, lows: np.ndarray, by: np.ndarray) -> None:
        """Adds to the references of distinct sorted keys; by may be negative."""
        every, low, refs = wide_tally(np.concatenate([self.keys, keys]), np.concatenate([self.lows, lows]), np.concatenate([self.refs, by]))
        live, known = refs > 0, wide_place(every, low, self.keys, self.lows) >= 0
        self.filter.delete(every[~live & known])
        self.keys, self.lows, self.refs = every[live], low[live], refs[live]
        if len(self.keys) > self.filter.table.size * 0.8 or not self.filter.insert(every[~known & live]):
            self.filter = CuckooFilter.of(self.keys)

    def references(self, keys: np.ndarray, lows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=np.int64)
        ask = np.flatnonzero(self.filter.maybe(keys))
        at = wide_place(keys[ask], lows[ask], self.keys, self.lows)
        out[ask[at >= 0]] = self.refs[at[at >= 0]]
        return out

    def row(self, shard: int, shards: int):
        import pyarrow as pa

        return pa.table({
            "shard": pa.array([shard], pa.int32()), "shards": pa.array([shards], pa.int32()), "keys": pa.array([pack(self.keys)], pa.binary()), "lows": pa.array([self.lows.astype("<u8").tobytes()], pa.binary()),
            "refs": pa.array([self.refs.astype("<i8").tobytes()], pa.binary()), "filter": pa.array([self.filter.table.tobytes()], pa.binary()),
        })

    @classmethod
    def load(cls, table) -> Shard:
        if not table.num_rows:
            return cls.empty()
        row = table.to_pylist()[0]
        marks, keys = np.frombuffer(row["filter"], dtype=np.uint16).reshape(-1, SLOTS).copy(), unpack(row["keys"])
        return cls(keys, lows_of(row["lows"], keys), np.frombuffer(row["refs"], dtype="<i8").copy(), CuckooFilter(marks))


def line_keys(text: bytes, least_chars: int) -> tuple[list[bytes], list[int]]:
    """Lines, and the 128-bit hash of each one's key, 0 for keys too short to count."""
    from xxhash import xxh3_128_intdigest

    lines = text.split(b"\n")
    keys = [x.strip(SPACES).lower() for x in lines]
    if least_chars > 1:
        keys = [k if len(k) - sum(0x80 <= c < 0xC0 for c in k) >= least_chars else b"" for k in keys]
    return lines, [(xxh3_128_intdigest(k) or 1) if k else 0 for k in keys]


def contributions(docs: DataFrame, column: str, least_chars: int, chunks: int, shards: int) -> DataFrame:
    """(chunk, shard, keys, lows, refs): in how many documents of the chunk each key is."""

    def ask(key, table):
        import pyarrow as pa

        flat: list[bytes] = []
        for text in row_texts(table, column):
            flat += [k.to_bytes(16, "little") for k in set(line_keys(text, least_chars)[1]) - {0}]
        both = np.frombuffer(b"".join(flat), dtype="<u8").reshape(-1, 2)
        keys, lows, n = wide_tally(both[:, 1], both[:, 0])
        rows = by_shard(keys, shards)
        return pa.table({
            "chunk": pa.array([key[0].as_py()] * len(rows), pa.int32()), "shard": pa.array([s for s, _, _ in rows], pa.int32()),
            "keys": pa.array([pack(keys[a:b]) for _, a, b in rows], pa.binary()), "lows": pa.array([lows[a:b].astype("<u8").tobytes() for _, a, b in rows], pa.binary()),
            "refs": pa.array([n[a:b].astype("<i4").tobytes() for _, a, b in rows], pa.binary()),
        })

    return docs.groupBy("chunk").applyInArrow(ask, STATED)


def _summed(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, keys, lows = gathered(table)
    refs = [np.frombuffer(x, dtype="<i4").astype(np.int64) for x in table.column("refs").to_pylist()]
    none = np.zeros(0, dtype=np.uint64)
    return wide_tally(np.concatenate([none, *keys]), np.concatenate([none, *lows]), np.concatenate([np.zeros(0, dtype=np.int64), *refs]))


def change_state(state: DataFrame | None, docs: DataFrame, sign: int, column: str = "text", least_chars: int = 1, shards: int | None = None) -> DataFrame:
    """The state after adding (sign 1) or deleting (-1) documents. None is the empty state.

    Deleting documents that were never added is an error of the caller; their counts stop at zero."""
    chunks = chunk_count(docs, column)
    if state is not None:
        row = state.select("shards").first()
        shards = row[0] if row else None
    shards = shards or shard_count(chunks)
    asked = contributions(in_chunks(docs, chunks), column, least_chars, chunks, shards)

    def merge(key, old, new):
        shard = Shard.load(old)
        keys, lows, refs = _summed(new)
        shard.change(keys, lows, refs * sign)
        return shard.row(key[0].as_py(), shards)

    if state is None:
        return asked.groupBy("shard").applyInArrow(lambda key, new: merge(key, new.slice(0, 0), new), STATE)
    return state.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(merge, STATE)


def of_distinct_texts(docs: DataFrame, column: str = "text", least_chars: int = 1) -> DataFrame:
    """The state in which a line counts once for each distinct text that has it: the lines of exact
    copies are not common because of the copies."""
    shelf = Shelf(docs.sparkSession)
    text = docs.select(F.coalesce(F.col(f"`{column}`"), F.lit("")).alias("text"))
    distinct = text.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary")))).dropDuplicates(["digest"])
    distinct = shelf.put("distinct", distinct.select("digest", "text"))
    state = shelf.put("state", change_state(None, distinct, 1, "text", least_chars))
    shelf.drop("distinct")
    return state


def drop_common_lines(docs: DataFrame, state: DataFrame | None = None, column: str = "text", least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """Documents without the lines whose key is in at least ``least_docs`` documents of the state
    (None: of docs themselves). The columns of docs with the text cut, then n_lines (before) and
    n_dropped."""
    chunks = chunk_count(docs, column)
    shards = shard_count(chunks)
    if state is not None:
        row = state.select("shards").first()
        shards = row[0] if row else shards
    dealt = in_chunks(docs, chunks)
    asked = contributions(dealt, column, least_chars, chunks, shards)

    def look(shard: Shard, table):
        out = []
        for chunk, keys, lows in zip(*gathered(table), strict=True):
            often = shard.references(keys, lows) >= least_docs
            out.append((chunk, keys[often], lows[often]))
        return found_table(out)

    if state is None:  # the shard's state is made and asked in one step, from the same rows

        def answer(table):
            shard = Shard.empty()
            shard.change(*_summed(table))
            return look(shard, table)

        answers = asked.groupBy("shard").applyInArrow(answer, FOUND)
    else:
        answers = asked.groupBy("shard").cogroup(state.groupBy("shard")).applyInArrow(lambda a, s: look(Shard.load(s), a), FOUND)

    def cut(left, right) -> Iterator:
        import pyarrow as pa

        common = {(high << 64) | low for high, low in zip(*(x.tolist() for x in found_keys(right)), strict=True)}
        texts, n_lines, n_dropped = [], [], []
        for text in row_texts(left, column):
            lines, keys = line_keys(text, least_chars)
            kept = [x for x, k in zip(lines, keys, strict=True) if k not in common]
            texts.append(b"\n".join(kept))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        return pa.table({"row": left.column("row"), column: strings(texts), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())})

    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(cut, boxed_schema(docs, f"`{column}` string, n_lines long, n_dropped long"))
    return unboxed(out, docs, column, "n_lines", "n_dropped")


def kept_digest(text: str = "text"):
    return F.sha2(F.col(text).cast("binary"), 256)
