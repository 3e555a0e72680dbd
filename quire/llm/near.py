"""Near-duplicate documents by order MinHash, candidates verified by banded alignment.

A document is its sequence of word 5-grams (lower-cased; fewer words are one gram). Each gram is labelled
with its occurrence, so repeats count. Every table hashes the labelled grams anew, takes the ``picks``
least, and keeps *their text order*: the sketch is the sequence of those grams. Equal sketches in any
table make candidates. Two documents are linked if the edit similarity of their gram sequences,
1 - distance / longer length, is at least ``similarity``: decided by cheap bounds where these suffice, else
by an alignment restricted to the band of allowed differences. Classes are the connected components.

Exact copies are one node. Documents that share a sketch are not paired with each other: every document
meets the leader with which it shares most sketches, which joins most of a bucket. Of a bucket that is
divided still, every document apart from its largest component meets all the others, in tasks of bounded
size that return only links; pairs whose grams overlap too little for the similarity are passed over at once
there, whatever is left is aligned. So every two documents with a common sketch end up connected or
compared, however large their bucket. Documents at the least similarity lack one in 2 cases of 1,000 at
most (ten grams) and 0.2 of 1,000 where they are long. Sequences of ``SHORT`` grams or fewer that are one
edit apart always have one: their last sketches are the sequence itself and what is left of it without one
of its grams.

Defined results: a null text counts as empty; texts without words are linked to exact copies alone;
repeated rows are copies; a class whose keys are all null has the key null; an empty table gives an
empty result; columns named like new ones are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytestext import groups_of, mix, split_words, text_bytes, windows
from .exchange import Shelf, boxed, unboxed

GRAM, SIMILARITY, TABLES, PICKS = 5, 0.8, 40, 4
BATCH = 4_000_000
#: Grams of a sequence that has sketches of the whole and of the whole without one gram in place of its
#: last SHORT + 1 tables'.
SHORT = 9
#: Grams of the least sequence that may differ in one at SIMILARITY.
EDIT = 5
#: Documents and grams in a block, and rows of a small table that may be broadcast (about 60 bytes each).
BLOCK, GRAMS = 4_096, 1_000_000
BROADCAST_ROWS = 200_000


def gram_sequences(texts: list[bytes], gram: int) -> list[np.ndarray]:
    words = split_words(texts, lower=True)
    h = words.hashes()
    full = windows(h, gram)
    out = []
    for a, n in zip(words.first[:-1].tolist(), words.lengths.tolist(), strict=True):
        out.append(full[a : a + n - gram + 1] if n >= gram else windows(h[a : a + n], n) if n else h[:0])
    return out


def occurrences(x: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    out = np.empty(len(x), dtype=np.uint64)
    out[order] = np.arange(len(x)) - start
    return out


def sketch(x: np.ndarray, seeds: np.ndarray, picks: int) -> np.ndarray:
    """One hash a table of the least labelled grams in text order."""
    tables = len(seeds)
    labelled = mix(x, occurrences(x))
    if len(x) > picks:
        ranks = (labelled[None, :] ^ seeds[:, :1]) * seeds[:, 1:]
        at = np.sort(np.argpartition(ranks, picks - 1, axis=1)[:, :picks], axis=1)
    else:
        at = np.broadcast_to(np.arange(len(x)), (tables, len(x)))
    out = np.arange(tables, dtype=np.uint64)
    for k in range(at.shape[1]):
        out = mix(out, x[at[:, k]])
    if len(x) <= SHORT < tables:
        out[-SHORT - 1 :] = short_keys(x)
    return out


def short_keys(x: np.ndarray) -> np.ndarray:
    """SHORT + 1 hashes, the first repeated as need be, of the sequence and, if it is long enough for one
    edit at SIMILARITY, of what each deletion leaves of it: sequences one edit apart have a common one."""
    gone = np.arange(-1, len(x) if len(x) >= EDIT else 0)
    keys = np.uint64(1_000) + np.uint64(len(x)) - (gone >= 0).astype(np.uint64)  # not a table's number
    for k in range(len(x)):
        keys = np.where(gone == k, keys, mix(keys, x[k : k + 1]))
    return np.concatenate([keys, np.repeat(keys[:1], SHORT + 1 - len(keys))])


def seeds_of(tables: int) -> np.ndarray:
    rng = np.random.default_rng(20_24)
    return rng.integers(0, 2**64, (tables, 2), dtype=np.uint64) | np.uint64(1)


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether at most ``most`` insertions, deletions and substitutions turn a into b."""
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    same = np.flatnonzero(a[:n] != b[:n])
    head = int(same[0]) if len(same) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(same[0]) if len(same) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return max(len(a), len(b)) <= most
    # at least as many edits as values of one side that the other lacks
    every, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    in_a, in_b = (np.bincount(x, minlength=len(every)) for x in (back[: len(a)], back[len(a) :]))
    if max(np.maximum(in_a - in_b, 0).sum(), np.maximum(in_b - in_a, 0).sum()) > most:
        return False
    # at most as many edits as any common subsequence leaves over: values found once on both sides
    once = (in_a == 1) & (in_b == 1)
    place = np.full(len(every), -1)
    place[back[len(a) :]] = np.arange(len(b))
    i = np.flatnonzero(once[back[: len(a)]])
    j = place[back[: len(a)]][i]
    if len(j) and (np.diff(j) > 0).all():
        gap = np.maximum(np.diff(np.concatenate([[-1], i, [len(a)]])), np.diff(np.concatenate([[-1], j, [len(b)]]))) - 1
        if gap.sum() <= most:
            return True
    return banded(back[: len(a)], back[len(a) :], most)


def banded(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance is at most ``most``, by furthest-reaching points on the diagonals of
    the band: after e edits, reach[k] is how far a is matched on diagonal k of j - i."""
    n, m = len(a), len(b)
    goal = m - n
    if abs(goal) > most:
        return False
    # diagonals from which the goal can still be reached within the band
    low, high = -((most - goal) // 2), (most + goal) // 2
    k = np.arange(low, high + 1)
    far = np.minimum(n, m - k)  # the end of each diagonal
    reach = np.full(len(k) + 2, -2)  # a margin on either side
    a, b = np.append(a, -1), np.append(b, -2)

    def run(i: np.ndarray, live: np.ndarray) -> None:
        while len(live):
            at = i[live]
            go = (at < far[live]) & (a[np.minimum(at, n)] == b[np.clip(at + k[live], 0, m)])
            live = live[go]
            i[live] += 1

    reach[1 - low] = 0
    inner = reach[1:-1]
    run(inner, np.array([-low]))
    for e in range(most + 1):
        if inner[goal - low] >= n:
            return True
        if e == most:
            return False
        new = np.maximum(np.maximum(inner + 1, reach[:-2]), reach[2:] + 1)
        new = np.minimum(new, far)
        new[(new < 0) | (new + k < 0)] = -2
        inner[:] = np.maximum(new, inner)
        run(inner, np.flatnonzero(inner >= 0))
    return False


def components(edges: DataFrame, shelf: Shelf, name: str) -> DataFrame:
    """(node, label): every node of the edges (a, b) with the least node of its component. Labels spread
    over edges, twice a job; from the third job on they also jump along themselves, so that long chains
    take a logarithm of jobs."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels, job = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), 0
    while True:
        for last in (False, True):
            near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("binary").alias("old"))
            if job >= 2:
                hop = labels.select("node", F.col("label").alias("at")).join(labels.select(F.col("node").alias("at"), "label"), "at").select("node", "label", F.lit(None).cast("binary").alias("old"))
                near = near.union(hop)
            spread = near.union(labels.select("node", "label", F.col("label").alias("old"))).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
            labels = spread if last else spread.select("node", "label")
        done = shelf.put(f"{name}_{job}", labels)
        if job:
            shelf.drop(f"{name}_{job - 1}")
        labels, job = done.select("node", "label"), job + 1
        if done.filter("old <> label").isEmpty():
            return labels


def sketches(docs: DataFrame, key: str, column: str, gram: int, tables: int, picks: int) -> DataFrame:
    """(key, node, n, sketch): node is the digest of the text, n the number of grams."""

    def make(batches):
        import pyarrow as pa

        seeds = seeds_of(tables)
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for a, b in groups_of([len(x) for x in texts], BATCH):
                grams = gram_sequences(texts[a:b], gram)
                flat = np.concatenate([sketch(x, seeds, picks) for x in grams if len(x)] or [np.zeros(0, dtype=np.uint64)]).view(np.int64)
                ends = np.concatenate([[0], np.cumsum([tables * (len(x) > 0) for x in grams])]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "key": batch.column("key").slice(a, b - a), "node": pa.array([hashlib.md5(x).digest() for x in texts[a:b]], pa.binary()),
                    "n": pa.array([len(x) for x in grams], pa.int32()), "sketch": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                })

    kind = docs.schema[key].dataType.simpleString()
    return docs.selectExpr(f"`{key}` AS key", f"`{column}` AS text").mapInArrow(make, f"key {kind}, node binary, n int, sketch array<bigint>")


def classes(docs: DataFrame, key: str = "doc_id", column: str = "text", gram: int = GRAM, similarity: float = SIMILARITY, tables: int = TABLES, picks: int = PICKS) -> DataFrame:
    """(key, node, class_id): for every row the least key of its class. node is md5 of the text."""
    shelf = Shelf(docs.sparkSession)
    made = shelf.put("made", sketches(docs, key, column, gram, tables, picks))
    nodes = made.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")).filter("n > 0")
    rows = shelf.put("rows", nodes.select(F.explode(F.when(F.col("n") <= SHORT, F.array_distinct("sketch")).otherwise(F.col("sketch"))).alias("bucket"), "node", "n"))
    lead = rows.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("lead"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = shelf.put("members", rows.join(lead.select("bucket", "lead"), "bucket").select("bucket", "node", "n", "lead"))
    shelf.drop("rows")
    # exact copies are one before texts meet, so their number does not matter
    wanted = shelf.put("wanted", members.select("node").distinct())
    texts = docs.select(F.unhex(F.md5(F.coalesce(F.col(f"`{column}`"), F.lit("")).cast("binary"))).alias("node"), F.col(f"`{column}`").alias("text"))
    if wanted.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(wanted), "node", "left_semi").dropDuplicates(["node"])
    else:
        texts = texts.dropDuplicates(["node"]).join(wanted, "node", "left_semi")
    texts = shelf.put("texts", texts)
    shelf.drop("wanted")

    # first every document meets the leader with which it shares most sketches
    stars = (
        members.filter((F.col("node") != F.col("lead.node")) & _allowed(F.col("n"), F.col("lead.n"), similarity))
        .groupBy("node", "n", F.col("lead.node").alias("other"), F.col("lead.n").alias("m")).agg(F.count(F.lit(1)).alias("shared"))
        .groupBy("node", "n").agg(F.max_by(F.struct("other", "m"), F.struct("shared", "other")).alias("to"))
    )
    stars = shelf.put("stars", stars.select(F.col("to.other").alias("of_group"), "node", "n", F.col("node").alias("label"), F.col("to.m").alias("m")))
    leaders = stars.select("of_group", F.col("of_group").alias("node"), F.col("m").alias("n"), F.col("of_group").alias("label")).distinct()
    links = linked(leaders, stars.drop("m"), texts, gram, similarity, shelf, "first")
    shelf.drop("stars")
    label = components(links, shelf, "label")
    # then the members of buckets that are divided still: those apart from the largest component meet all.
    # Buckets with the same largest component are one group
    group = shelf.put("group", _divided(_labelled(members, label)).select(F.col("main").alias("of_group"), "node", "n", "label").distinct())
    shelf.drop("members")
    sizes = group.groupBy("of_group").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least"), F.max("n").alias("most"))
    pairs = sizes.filter((F.col("size") == 2) & ~_allowed(F.col("least"), F.col("most"), similarity)).select("of_group")
    group = group.join(pairs, "of_group", "left_anti")
    more = linked(group.filter("label <> of_group"), group, texts, gram, similarity, shelf, "second")
    shelf.drop("group"), shelf.drop("texts")
    # components of components
    over = lambda at, to: label.select(F.col("node").alias(at), F.col("label").alias(to))
    joined = (
        more.join(over("a", "la"), "a", "left").join(over("b", "lb"), "b", "left")
        .select(F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y")).filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    )
    joined = shelf.put("joined", joined)
    shelf.drop("second")
    if not joined.isEmpty():
        top = components(joined, shelf, "top").select(F.col("node").alias("label"), F.col("label").alias("top"))
        single = top.join(label, top["label"] == label["node"], "left_anti").select(F.col("label").alias("node"), "top")  # in no component before
        known = label.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label")).union(single.select("node", F.col("top").alias("label")))
        label = shelf.put("final", known)
    named = made.select("key", "node").join(_small(label.select(F.col("node").alias("of"), "label")), F.col("node") == F.col("of"), "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    least = shelf.put("least", named.groupBy("label").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("size")).filter("size > 1").select(F.col("label").alias("of"), "least"))
    out = named.join(_small(least), F.col("label") == F.col("of"), "left")
    return out.select(F.col("key").alias(key), "node", F.when(F.col("of").isNull(), F.col("key")).otherwise(F.col("least")).alias("class_id"))


def _allowed(x: Column, y: Column, similarity: float) -> Column:
    return F.abs(x - y) <= F.floor((1 - similarity) * F.greatest(x, y) + 1e-9)


def _small(table: DataFrame) -> DataFrame:
    """Broadcast where the rows, counted now, are few; else Spark shuffles both sides."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    return rows.join(label.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("bucket", "node", "n", F.coalesce("label", "node").alias("label"))


def _divided(known: DataFrame) -> DataFrame:
    """Adds to members (bucket, node, n, label) the bucket's largest component (main); buckets of one
    component go."""
    by_label = known.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("same"))
    open_ = by_label.groupBy("bucket").agg(F.max(F.struct("same", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    return known.join(open_.select("bucket", F.col("main.label").alias("main")), "bucket")


def linked(left: DataFrame, right: DataFrame, texts: DataFrame, gram: int, similarity: float, shelf: Shelf, name: str) -> DataFrame:
    """Links (a, b) between the left and the right documents (of_group, node, n, label) of each group
    that no label joins; those that others have connected meanwhile may be left out.

    Both sides are dealt to blocks of at most about ``BLOCK`` documents and ``GRAMS`` grams, and every left
    block of a group meets every right one: bounded work however large the group is, of which only links
    leave the task. Tasks take as many such meetings as make about ``GRAMS`` grams."""
    blocks = lambda rows, to: rows.groupBy("of_group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))), F.ceil(F.sum("n") / F.lit(float(GRAMS))), F.lit(1)).cast("int").alias(to))
    sizes = blocks(left, "narrow").join(blocks(right, "wide"), "of_group")
    dice = F.xxhash64("node")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(dice, F.col(n)).cast("int")
    dealt = left.join(sizes, "of_group").select("of_group", own("narrow").alias("i"), all_of("wide").alias("j"), "node", "n", "label", F.lit(0).alias("side"))
    dealt = dealt.union(right.join(sizes, "of_group").select("of_group", all_of("narrow").alias("i"), own("wide").alias("j"), "node", "n", "label", F.lit(1).alias("side")))
    dealt = shelf.put(f"{name}_dealt", dealt)
    grams = dealt.agg(F.sum("n")).first()[0] or 0
    part = F.pmod(F.xxhash64("of_group", "i", "j"), F.lit(max(12, -(-grams // GRAMS)))).cast("int")
    full = dealt.select(part.alias("part"), F.xxhash64("of_group", "i", "j").alias("cell"), "node", "label", "side").join(texts, "node")

    def meet(table):
        import pyarrow as pa

        a, b = meetings(table, gram, similarity)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    links = shelf.put(name, full.groupBy("part").applyInArrow(meet, "a binary, b binary"))
    shelf.drop(f"{name}_dealt")
    return links


def meetings(table, gram: int, similarity: float) -> tuple[list[bytes], list[bytes]]:
    """The links within each cell of a table (cell, node, label, side, text)."""
    node, label = table.column("node").to_pylist(), table.column("label").to_pylist()
    cell, side = (table.column(c).to_numpy() for c in ("cell", "side"))
    name: dict[bytes, int] = {}
    own = np.array([name.setdefault(x, len(name)) for x in node])
    first = {k: i for i, k in reversed(list(enumerate(own.tolist())))}
    found = text_bytes(table.column("text").take([first[k] for k in range(len(name))]))
    grams: list[np.ndarray] = []
    for a, b in groups_of([len(x) for x in found], BATCH):
        grams += gram_sequences(found[a:b], gram)
    n = np.array([len(x) for x in grams], dtype=np.int64)
    kind: dict[bytes, int] = {}
    of = np.array([kind.setdefault(x, len(kind)) for x in label])
    out_a: list[bytes] = []
    out_b: list[bytes] = []
    order = np.lexsort((side, cell))
    cut = np.flatnonzero(np.concatenate([[True], cell[order][1:] != cell[order][:-1], [True]]))
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        rows = order[s:e]
        x, y = rows[side[rows] == 0], rows[side[rows] == 1]
        if not len(x) or not len(y):
            continue
        root = {int(k): int(k) for k in of[rows]}

        def find(k: int, root=root) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        sizes = n[own[y]]
        if len(y) > 4:  # how many grams of each right document a left one has, at once for all of them
            every, at = np.unique(np.concatenate([grams[k] for k in own[y]] + [grams[k] for k in own[x]]), return_inverse=True)
            right, starts = at[: sizes.sum()], np.cumsum(sizes) - sizes
            mark, left_at = np.zeros(len(every), dtype=np.int32), int(sizes.sum())
        for i in x.tolist():
            size = int(n[own[i]])
            most = ((1 - similarity) * np.maximum(sizes, size) + 1e-9).astype(np.int64)
            may = (of[y] != of[i]) & (np.abs(sizes - size) <= most)
            common = None
            if len(y) > 4:
                mine = at[left_at : left_at + size]
                left_at += size
                if not may.any():
                    continue
                mark[mine] = 1
                common = np.add.reduceat(mark[right], starts)
                mark[mine] = 0
                may &= common >= np.maximum(sizes, size) - most  # no alignment matches more
            close = np.flatnonzero(may)
            if common is not None:
                close = close[np.argsort(-common[close], kind="stable")]
            for k in close.tolist():
                p, q = find(int(of[i])), find(int(of[y[k]]))
                if p != q and within(grams[own[i]], grams[own[y[k]]], int(most[k])):
                    root[p] = q
                    out_a.append(node[i])
                    out_b.append(node[y[k]])
    return out_a, out_b


def keep_one(docs: DataFrame, key: str = "doc_id", column: str = "text", **how) -> DataFrame:
    """The document of the least key of each class. All columns of docs."""
    own = classes(docs, key, column, **how).filter(F.col(key).eqNullSafe(F.col("class_id"))).groupBy(F.col(key).alias("k"), "node").agg(F.count(F.lit(1)).alias("rows"))
    # equal keys with other texts: one of them
    own = own.groupBy("k").agg(F.min(F.struct("node", "rows")).alias("o")).select("k", F.col("o.node").alias("node"), F.col("o.rows").alias("rows"))
    rows = boxed(docs)
    node = F.unhex(F.md5(F.coalesce(F.col(f"row.`{column}`"), F.lit("")).cast("binary")))
    kept = rows.join(own, F.col(f"row.`{key}`").eqNullSafe(F.col("k")) & (node == F.col("node")))
    if (own.agg(F.max("rows")).first()[0] or 0) > 1:  # rows that are equal in key and text
        kept = kept.dropDuplicates(["k", "node"])
    return unboxed(kept, docs)
