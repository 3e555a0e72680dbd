"""Exact substring dedup by seed and extend.

Seeds are hashes of ``seed`` consecutive words; winnowing keeps, of every ``window - seed + 1``
consecutive seeds, the least. Two equal windows have equal anchors, so documents meet on anchors alone
(about one seed in fifteen): the shard of an anchor joins all its occurrences. Around each anchor that
occurs more than once, matches are extended to both sides, from the window that ends with the anchor to
the one that begins with it: every such placement meets, by its whole word sequence, the other
occurrences of the same placement. Placements that match overlap into maximal repeats, which are cut and
kept as ``repeats``.

Occurrences of an anchor are joined by key and never paired with each other: a passage in a third of all
documents is one entry for each chunk of documents, and pairs of its occurrences would grow with the square of
their number. That is why an extension compares a placement with all other occurrences at once instead of
two documents word by word; the result is the same. Word sequences are compared by hashes of 128 bits.

Defined results: null has no words; texts of fewer words than the window stay; repeated rows are other
places; an empty table gives an empty result; kept words are joined by one space.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
from pyspark.sql import DataFrame

from .bytestext import Words, covered, member, sliding, split_words, wide_place, windows
from .exchange import ASKED, boxed_schema, chunk_count, found_keys, in_chunks, question, repeated, row_texts, shard_count, strings, unboxed

def anchors_of(words: Words, h: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, each one's anchor, and all anchor occurrences."""
    seeds = windows(h, seed)
    reach = window - seed
    least = sliding(seeds, reach + 1)
    inside = words.left()[: len(least)] >= window
    bar = np.concatenate([np.zeros(reach, dtype=np.uint64), np.where(inside, least, np.uint64(0)), np.zeros(reach, dtype=np.uint64)])
    over = sliding(bar, reach + 1, np.maximum)
    chosen = seeds[(seeds == over[: len(seeds)]) & (over[: len(seeds)] > 0)] if len(least) else seeds[:0]
    starts = np.flatnonzero(inside)
    return starts, least[starts], chosen


def cut_repeats(docs: DataFrame, column: str = "text", window: int = 35, seed: int = 8) -> DataFrame:
    """Documents without the words under any window of ``window`` words that also starts elsewhere.

    The columns of docs with the text cut to its kept words, then n_words, n_removed and ``repeats``:
    the maximal repeats as word ranges (first, behind the last)."""
    if not 0 < seed <= window:
        raise ValueError("a seed has between 1 word and the window's")
    chunks = chunk_count(docs, column)
    shards = shard_count(chunks)
    dealt = in_chunks(docs, chunks)

    def seeds(key, table):
        words = split_words(row_texts(table, column))
        return question(key[0].as_py(), anchors_of(words, words.hashes(), window, seed)[2], shards)

    def extend(key, table, answers):
        words = split_words(row_texts(table, column))
        h = words.hashes()
        starts, anchor, _ = anchors_of(words, h, window, seed)
        starts = starts[member(anchor, found_keys(answers)[0])]
        return question(key[0].as_py(), windows(h, window)[starts], shards, windows(words.hashes(True), window, True)[starts])

    def cut(key, table, answers):
        import pyarrow as pa

        texts = row_texts(table, column)
        words = split_words(texts)
        n = len(words.starts)
        full = windows(words.hashes(), window)
        starts = np.flatnonzero(words.left()[: len(full)] >= window)
        high, low = found_keys(answers)
        starts = starts[member(full[starts], high)]
        if len(starts):
            starts = starts[wide_place(full[starts], windows(words.hashes(True), window, True)[starts], high, low) >= 0]
        gone = covered(starts, window, n)
        kept, spans, removed = [], [], []
        for text, a, b in zip(texts, words.first[:-1], words.first[1:], strict=True):
            out, own = gone[a:b], text.split()
            removed.append(int(out.sum()))
            if removed[-1]:
                own = compress(own, (~out).tolist())
                edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
                spans.append([{"first": int(x), "behind": int(y)} for x, y in edge.reshape(-1, 2)])
            else:
                spans.append([])
            kept.append(b" ".join(own))
        return pa.table({
            "row": table.column("row"), column: strings(kept), "n_words": pa.array(words.lengths, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "repeats": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("behind", pa.int32())]))),
        })

    anchors = repeated(dealt.groupBy("chunk").applyInArrow(seeds, ASKED), 2)
    asked = dealt.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(extend, ASKED)
    found = repeated(asked, 2)
    schema = boxed_schema(docs, f"`{column}` string, n_words long, n_removed long, repeats array<struct<first:int,behind:int>>")
    out = dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(cut, schema)
    return unboxed(out, docs, column, "n_words", "n_removed", "repeats")
