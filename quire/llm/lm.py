"""Language-model scores by deleted interpolation of word n-grams.

P(w | h) mixes three maximum-likelihood estimates: of the word after its predecessor, of the word
alone, and of any word. The weights depend on how often the predecessor was seen (buckets by the
logarithm of its count) and are learned by expectation-maximisation on held-out documents, whose counts
are left out of the estimates meanwhile; the final estimates use all training documents.

Counts are exact and cover all training documents. Chunks of documents ask about their distinct words
and word pairs, shards of keys add the counts up and answer in the order of the question, so an answer
carries no keys; see ``exchange``. The held-out events reach the EM as sums over a logarithmic grid of
estimates, whose size does not grow with the input.

Defined results: a null text is empty, an empty text is its end token alone; repeated rows are
documents of their own; a null id counts as training; without held-out documents the weights are
``FALLBACK``; an empty table gives an empty result; columns named like the new ones are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytestext import mix, split_words
from .exchange import boxed_schema, by_shard, chunk_count, in_chunks, pack, row_texts, shard_count, shared_dir, tally, unboxed, unpack

BEGIN, STOP = np.uint64(0x5DEECE66D1234567), np.uint64(0xBB67AE8584CAA73B)
BUCKETS = 40
GRID = 8  # cells to a doubling
FALLBACK = (0.3, 0.5, 0.2)
#: The least weight of any estimate, so that no text has probability 0.
FLOOR = 1e-4

ASK = "chunk int, shard int, kind int, keys binary, main binary, held binary"
ANSWER = "chunk int, shard int, kind int, main binary, held binary, n_main long, n_all long, v_main long, v_all long"
#: The chunk of the rows that hold a shard's totals.
TOTALS = -1


def pack_counts(c: np.ndarray) -> bytes:
    return len(c).to_bytes(8, "little") + np.minimum(c, 255).astype(np.uint8).tobytes() + c[c >= 255].astype("<i8").tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    small = np.frombuffer(blob, dtype=np.uint8, offset=8, count=n)
    out = small.astype(np.int64)
    out[small == 255] = np.frombuffer(blob, dtype="<i8", offset=8 + n)
    return out


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, its predecessor, text) of all texts, every text's end token included."""
    words = split_words(texts, lower=True)
    sizes = words.lengths + 1
    behind = np.cumsum(sizes)
    token = np.empty(int(behind[-1]) if len(behind) else 0, dtype=np.uint64)
    ends = np.zeros(len(token), dtype=bool)
    ends[behind - 1] = True
    token[ends] = STOP
    token[~ends] = words.hashes()
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[behind - sizes] = BEGIN
    return token, before, np.repeat(np.arange(len(texts)), sizes)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 and the whole part of the count's binary logarithm."""
    return np.minimum(np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0), BUCKETS - 1)


def keys_of(token: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of kind 0, words with the contexts, and of kind 1, pairs. Sorted, distinct."""
    return tally(np.append(token, BEGIN))[0], tally(mix(before, token))[0]


def counted(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), dtype=np.int64)
    every, n = tally(values)
    out[np.searchsorted(keys, every)] = n
    return out


def em(bucket_of: np.ndarray, p2: np.ndarray, p1: np.ndarray, p0: float, n: np.ndarray, rounds: int = 60) -> np.ndarray:
    """(BUCKETS, 3) weights of the estimates p2, p1, p0 that make n held-out events likeliest."""
    weights = np.tile(np.array(FALLBACK), (BUCKETS, 1))
    total = np.bincount(bucket_of, n, BUCKETS)
    p = np.stack([p2, p1, np.full(len(n), p0)], axis=1)
    for _ in range(rounds if len(n) else 0):
        part = weights[bucket_of] * p
        part *= (n / np.maximum(part.sum(axis=1), 1e-300))[:, None]
        own = np.stack([np.bincount(bucket_of, part[:, k], BUCKETS) for k in range(3)], axis=1)
        weights = np.where(total[:, None] > 0, own / np.maximum(total, 1e-300)[:, None], weights)
    weights = np.maximum(weights, FLOOR)
    return weights / weights.sum(axis=1, keepdims=True)


class Answers:
    """A chunk's counts in the order of its sorted keys."""

    def __init__(self, table):
        rows = table.select(["kind", "shard", "main", "held"]).to_pylist()
        rows.sort(key=lambda r: (r["kind"], r["shard"]))
        none = np.zeros(0, dtype=np.int64)
        self.main, self.held = ([np.concatenate([none, *[unpack_counts(r[x]) for r in rows if r["kind"] == k]]) for k in (0, 1)] for x in ("main", "held"))


def score(docs: DataFrame, train: Column, held: Column, column: str = "text") -> DataFrame:
    """The columns of docs, then n_tokens, n_known, train_tokens, base_score and score.

    train, held: conditions on docs. Documents of train are learned from; those of them that are held
    are the events on which the weights are learned."""
    spark = docs.sparkSession
    chunks = chunk_count(docs, column)
    apart = max(1, chunks // 8)  # held documents have chunks of their own
    shards = shard_count(chunks)
    part = F.when(~F.coalesce(train, F.lit(True)), 2).when(F.coalesce(held, F.lit(False)), 1).otherwise(0)
    dealt = in_chunks(docs, chunks, part=part)
    dealt = dealt.withColumn("chunk", F.when(F.col("part") == 1, F.lit(chunks) + F.pmod(F.col("chunk"), F.lit(apart))).otherwise(F.col("chunk")).cast("int"))

    def ask(key, table):
        import pyarrow as pa

        token, before, doc = tokens(row_texts(table, column))
        part = np.array(table.column("part").to_pylist(), dtype=np.int64)
        of = part[doc]
        rows: list[tuple] = []
        for kind, (every, values, owner) in enumerate(zip(keys_of(token, before), (np.concatenate([token, np.full(len(part), BEGIN)]), mix(before, token)), (np.concatenate([of, part]), of), strict=True)):
            main, held_ = (counted(every, values[owner == k]) for k in (0, 1))
            rows += [(key[0].as_py(), s, kind, pack(every[a:b]), pack_counts(main[a:b]), pack_counts(held_[a:b])) for s, a, b in by_shard(every, shards)]
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(("chunk", "shard", "kind", "keys", "main", "held"), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True))})

    def answer(key, table):
        import pyarrow as pa

        out: dict[str, list] = {n: [] for n in ("chunk", "shard", "kind", "main", "held", "n_main", "n_all", "v_main", "v_all")}
        kinds = np.array(table.column("kind").to_pylist())
        for kind in (0, 1):
            rows = table.filter(pa.array(kinds == kind))
            keys = [unpack(x) for x in rows.column("keys").to_pylist()]
            if not keys:
                continue
            flat = np.concatenate(keys)
            order = np.argsort(flat, kind="stable")
            ranked = flat[order]
            first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(flat) else np.zeros(0, dtype=np.int64)
            number = np.empty(len(flat), dtype=np.int64)
            number[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]])) if len(flat) else 0
            sums = []
            for x in ("main", "held"):
                c = np.concatenate([unpack_counts(b) for b in rows.column(x).to_pylist()])
                sums.append(np.add.reduceat(c[order], first) if len(first) else c)
            if kind == 0:
                real = ranked[first] != BEGIN
                main, every = sums[0][real], (sums[0] + sums[1])[real]
                for n, v in zip(out, (TOTALS, key[0].as_py(), kind, b"", b"", int(main.sum()), int(every.sum()), int((main > 0).sum()), int((every > 0).sum())), strict=True):
                    out[n].append(v)
            at = 0
            for chunk, k in zip(rows.column("chunk").to_pylist(), keys, strict=True):
                own = number[at : at + len(k)]
                at += len(k)
                for n, v in zip(out, (chunk, key[0].as_py(), kind, pack_counts(sums[0][own]), pack_counts(sums[1][own]), 0, 0, 0, 0), strict=True):
                    out[n].append(v)
        kinds_of = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4)
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), kinds_of, strict=True)})

    path = shared_dir(spark)
    asked = dealt.groupBy("chunk").applyInArrow(ask, ASK)
    asked.groupBy("shard").applyInArrow(answer, ANSWER).write.option("compression", "zstd").parquet(path)
    answers = spark.read.schema(ANSWER).parquet(path)
    sums = answers.filter(F.col("chunk") == TOTALS).agg(*[F.sum(c) for c in ("n_main", "n_all", "v_main", "v_all")]).first()
    n_main, n_all, v_main, v_all = (int(x or 0) for x in sums)
    answers = answers.filter(F.col("chunk") != TOTALS).drop("n_main", "n_all", "v_main", "v_all")

    def look(table, right):
        """Per token: its text and the counts of pair, context and word by (main, held)."""
        token, before, doc = tokens(row_texts(table, column))
        words, pairs = keys_of(token, before)
        known = Answers(right)
        at_pair, at_context, at_word = np.searchsorted(pairs, mix(before, token)), np.searchsorted(words, before), np.searchsorted(words, token)
        return doc, known, at_pair, at_context, at_word

    def events(table, right):
        import pyarrow as pa

        _, known, pair, context, word = look(table, right)
        h, n2, n1 = known.main[0][context], known.main[1][pair], known.main[0][word]
        b = bucket(h)
        grid = lambda x: np.where(x > 0, np.round(np.log2(np.maximum(x, 1e-300)) * GRID), 1).astype(np.int64)  # noqa: E731  1: none
        code = (b * 4096 - grid(n2 / np.maximum(h, 1)) + 1) * 4096 - grid(n1 / max(n_main, 1)) + 1
        every, n = np.unique(code, return_counts=True)
        return pa.table({"code": pa.array(every, pa.int64()), "n": pa.array(n, pa.int64())})

    held_docs = dealt.filter(F.col("chunk") >= chunks)
    gathered = (
        held_docs.groupBy("chunk").cogroup(answers.filter(F.col("chunk") >= chunks).groupBy("chunk")).applyInArrow(lambda a, b: events(a, b) if a.num_rows else events_none(), "code long, n long")
        .groupBy("code").agg(F.sum("n").alias("n"))
    )
    weights = learn(gathered, v_main)

    def rate(table, right):
        import pyarrow as pa

        doc, known, pair, context, word = look(table, right)
        c2, c1 = (known.main[k] + known.held[k] for k in (1, 0))
        h, n2, n1 = c1[context], c2[pair], c1[word]
        w = weights[bucket(h)]
        size = table.num_rows
        p = w[:, 0] * (n2 / np.maximum(h, 1)) + w[:, 1] * (n1 / max(n_all, 1)) + w[:, 2] / (v_all + 1)
        base = (n1 + 1) / (n_all + 1 * (v_all + 1))
        return pa.table({
            "row": table.column("row"), "n_tokens": pa.array(np.bincount(doc, minlength=size), pa.int64()), "n_known": pa.array(np.bincount(doc, n1 > 0, size).astype(np.int64), pa.int64()),
            "train_tokens": pa.array(np.full(size, n_all), pa.int64()), "base_score": pa.array(np.bincount(doc, np.log10(base), size), pa.float64()), "score": pa.array(np.bincount(doc, np.log10(p), size), pa.float64()),
        })

    out = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(rate, boxed_schema(docs, "n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    return unboxed(out, docs, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def events_none():
    import pyarrow as pa

    return pa.table({n: pa.array([], pa.int64()) for n in ("code", "n")})


def learn(gathered: DataFrame, vocabulary: int) -> np.ndarray:
    """The weights from held-out events on the grid, learned in one task; its size is the grid's."""

    def fit(table):
        import pyarrow as pa

        code, n = (np.array(table.column(c).to_pylist(), dtype=np.int64) for c in ("code", "n"))
        g1, rest = code % 4096, code // 4096
        g2, b = rest % 4096, rest // 4096
        value = lambda g: np.where(g == 0, 0.0, 2.0 ** (-(g - 1) / GRID))
        weights = em(b, value(g2), value(g1), 1 / (vocabulary + 1), n.astype(float))
        return pa.table({"weights": pa.array([weights.ravel().tolist()], pa.list_(pa.float64()))})

    row = gathered.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(fit, "weights array<double>").first()
    return np.array(row["weights"]).reshape(BUCKETS, 3) if row else np.tile(np.array(FALLBACK), (BUCKETS, 1))
