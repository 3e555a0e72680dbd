"""A byte-level convolutional network that scores the quality of whole texts.

Every byte has a learned vector. Filters ``WIDTH`` bytes wide run over the text in steps of ``STEP``, and
their responses are max-pooled within chunks of ``CHUNK`` bytes that overlap by half and cover the whole
document, however long. A document's features are the mean and the maximum of its chunks' pools; a
logistic unit combines them into one probability. Learned in NumPy by Adam from the whole texts of a
bounded sample of labelled rows (``SAMPLE``, those with the least hashes of their keys); scores need one
pass over the texts and no shuffle. Long texts are worked on in pieces of whole chunks, so memory is
bounded, and a score does not depend on the texts beside it.

Defined results: a null or empty text scores like one chunk of padding, within 0 to 1; repeated rows
score alike; without labelled rows of both kinds every text scores the share of good labels (0.5 if
there are none); an empty table gives an empty result; columns named like new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytestext import groups_of
from .exchange import boxed, boxed_schema, row_texts, unboxed

WIDTH, STEP, BLOCK, CHUNK = 16, 4, 128, 512
HALF = CHUNK // BLOCK // 2
DEPTH, FILTERS = 8, 16
#: Labelled rows to learn from at most. Their whole texts are learned from.
SAMPLE, PASSES, GROUP = 3_000, 4, 32
#: Updates of the weights at least.
UPDATES = 400
#: Chunks of a piece, and bytes of the pieces that are worked on at once.
PIECE, BATCH = 2_048, 1_500_000


class Piece(NamedTuple):
    """Some chunks of a text, with the block behind them or what pads the text's end."""

    text: int
    data: bytes
    chunks: int


class Forward(NamedTuple):
    data: np.ndarray
    x: np.ndarray
    arg: np.ndarray  # the step of the greatest response of each block and filter
    block: np.ndarray  # the block of that in each chunk
    pre: np.ndarray
    text: np.ndarray  # the text of each chunk


def batches_of(texts: list[bytes]) -> Iterator[list[Piece]]:
    """The pieces of all texts in order, in lists of about BATCH bytes; a text's end is padded by what a
    filter needs at least."""
    out: list[Piece] = []
    size = 0
    for i, text in enumerate(texts):
        blocks = -(-(max(len(text), 1) + WIDTH - STEP) // BLOCK)
        chunks = max(-(-(blocks - HALF) // HALF), 1)
        for a in range(0, chunks, PIECE):
            n = min(PIECE, chunks - a)
            end = min(((a + n - 1) * HALF + CHUNK // BLOCK + 1), blocks)
            data = text[a * HALF * BLOCK : end * BLOCK].ljust((end - a * HALF) * BLOCK, b"\0")
            if out and size + len(data) > BATCH:
                yield out
                out, size = [], 0
            out.append(Piece(i, data, n))
            size += len(data)
    if out:
        yield out


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {
            "bytes": r.normal(0, 0.5, (256, DEPTH)).astype(f), "filters": r.normal(0, (2 / (WIDTH * DEPTH)) ** 0.5, (WIDTH * DEPTH, FILTERS)).astype(f),
            "bias": np.zeros(FILTERS, f), "mean": r.normal(0, 0.1, FILTERS).astype(f), "most": r.normal(0, 0.1, FILTERS).astype(f), "out": np.zeros(1, f),
        }
        self.prior: float | None = None

    def forward(self, pieces: list[Piece]) -> Forward:
        """The pools of all chunks of the pieces, and where they come from."""
        blocks = np.array([len(x.data) // BLOCK for x in pieces], dtype=np.int64)
        first = np.cumsum(blocks) - blocks
        data = np.frombuffer(b"".join(x.data for x in pieces) + b"\0" * (WIDTH - STEP), dtype=np.uint8)
        x = self.p["bytes"][data].reshape(-1, STEP * DEPTH)  # a filter is a sum over its steps
        w = self.p["filters"].reshape(WIDTH // STEP, STEP * DEPTH, FILTERS)
        n = len(x) - len(w) + 1
        y = x[:n] @ w[0]
        for k in range(1, len(w)):
            y += x[k : n + k] @ w[k]
        y = y.reshape(-1, BLOCK // STEP, FILTERS)
        y[first + blocks - 1, 1 - WIDTH // STEP :] = -np.inf  # windows that would reach into the next piece
        arg = y.argmax(axis=1)
        best = np.take_along_axis(y, arg[:, None, :], axis=1)[:, 0]
        n = np.array([x.chunks for x in pieces], dtype=np.int64)
        of = np.repeat(np.arange(len(pieces)), n)
        start = first[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * HALF
        at = np.minimum(start[:, None] + np.arange(CHUNK // BLOCK), (first + blocks)[of, None] - 1)
        block = np.take_along_axis(at, best[at].argmax(axis=1), axis=1)  # (chunk, filter)
        pre = np.take_along_axis(best, block, axis=0) + self.p["bias"]
        return Forward(data, x, arg, block, pre, np.array([x.text for x in pieces])[of])

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """The mean and the greatest pool of each text by filter, the chunks that have the latter, the
        texts' chunks, and the last forward step."""
        mean, most, ties = (np.zeros((len(texts), FILTERS), np.float32) for _ in range(3))
        count, step = np.zeros(len(texts), np.float32), None
        for pieces in batches_of(texts):
            step = self.forward(pieces)
            pool, text = np.maximum(step.pre, 0), step.text
            cut = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            own = text[cut]
            mean[own] += np.add.reduceat(pool, cut)
            count[own] += np.diff(np.append(cut, len(text)))
            top = np.maximum.reduceat(pool, cut)
            same = np.add.reduceat((pool == np.repeat(top, np.diff(np.append(cut, len(text))), axis=0)).astype(np.float32), cut)
            ties[own] = np.where(top > most[own], same, ties[own] + same * (top == most[own]))
            most[own] = np.maximum(most[own], top)
        return mean / np.maximum(count, 1)[:, None], most, ties, count, step

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        if not texts:
            return np.zeros(0)
        mean, most, *_ = self.pooled(texts)
        z = mean.astype(np.float64) @ self.p["mean"] + most.astype(np.float64) @ self.p["most"] + float(self.p["out"][0])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def gradient(self, texts: list[bytes], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        mean, most, ties, count, step = self.pooled(texts)
        z = mean @ self.p["mean"] + most @ self.p["most"] + self.p["out"]
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight).astype(np.float32)
        g = {k: np.zeros_like(x) for k, x in self.p.items()}
        g |= {"mean": mean.T @ dz, "most": most.T @ dz, "out": np.array([dz.sum()], np.float32)}
        batches = list(batches_of(texts))
        for pieces in batches:
            if len(batches) > 1:
                step = self.forward(pieces)
            pool, text = np.maximum(step.pre, 0), step.text
            top = (pool == most[text]) & (pool > 0)
            d = (dz / count)[text][:, None] * self.p["mean"] + top * (dz[:, None] * self.p["most"] / np.maximum(ties, 1))[text]
            d *= step.pre > 0
            g["bias"] += d.sum(axis=0)
            rows = (step.block * (BLOCK // STEP) + np.take_along_axis(step.arg, step.block, axis=0)).ravel()
            fil, d = np.tile(np.arange(FILTERS), len(d)), d.ravel()
            live = d != 0
            rows, d, fil = rows[live], d[live], fil[live]
            # chunks that overlap often pool the same place: one row for each place and filter
            place, back = np.unique(rows * FILTERS + fil, return_inverse=True)
            rows, fil, d = place // FILTERS, place % FILTERS, np.bincount(back, d, len(place)).astype(np.float32)
            window = np.concatenate([step.x[rows + k] for k in range(WIDTH // STEP)], axis=1)
            for f in range(FILTERS):
                own = fil == f
                g["filters"][:, f] += d[own] @ window[own]
            back = (d[:, None] * self.p["filters"].T[fil]).reshape(len(d), WIDTH, DEPTH)
            byte = step.data[rows[:, None] * STEP + np.arange(WIDTH)]
            for k in range(DEPTH):
                g["bytes"][:, k] += np.bincount(byte.ravel(), back[:, :, k].ravel(), 256)
        return g

    def learn(self, texts: list[bytes], labels: np.ndarray, passes: int = PASSES, seed: int = 11, rate: float = 0.01) -> Network:
        labels = labels.astype(np.float32)
        good = float(labels.mean()) if len(labels) else 0.5
        if not len(labels) or not 0 < good < 1:
            self.prior = good
            return self
        r = np.random.default_rng(seed)
        # both labels weigh the same up to the square root of their imbalance
        weight = np.where(labels > 0, (0.5 / good) ** 0.5, (0.5 / (1 - good)) ** 0.5).astype(np.float32)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        passes = max(passes, -(-UPDATES * GROUP // len(texts)))  # small samples are seen more often
        t, total = 0, passes * -(-len(texts) // GROUP)
        for _ in range(passes):
            order = r.permutation(len(texts))
            for a in range(0, len(order), GROUP):
                own = order[a : a + GROUP]
                g = self.gradient([texts[i] for i in own], labels[own], weight[own] / len(own))
                t += 1
                now = rate * (1 - 0.9 * t / total)
                for k, x in self.p.items():
                    d = g[k] + 1e-4 * x
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.99 * v[k] + 0.01 * d * d
                    x -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", column: str = "text", label: str = "quality", sample: int = SAMPLE) -> Network:
    """A network learned from at most ``sample`` labelled rows for which ``usable`` (on docs) holds: the
    keys of least hashes; of rows of one key, one. The rows meet in one task, which learns from their whole
    texts; the driver gets the weights."""
    known = labels.filter(F.col(f"`{label}`").isin(0, 1)).groupBy(F.col(f"`{key}`").alias("_k")).agg(F.max(f"`{label}`").alias("_y"))
    chosen = known.orderBy(F.xxhash64("_k"), "_k").limit(2 * sample)  # bounded before texts are touched
    usable_docs = docs.filter(usable)
    ids = usable_docs.select(F.col(f"`{key}`").alias("_id")).join(F.broadcast(chosen), F.col("_id") == F.col("_k")).select("_k", "_y").distinct().orderBy(F.xxhash64("_k"), "_k").limit(sample)
    rows = usable_docs.select(F.col(f"`{key}`").alias("_id"), F.coalesce(F.col(f"`{column}`").cast("binary"), F.lit(b"")).alias("_text"))
    rows = rows.join(F.broadcast(ids), F.col("_id") == F.col("_k")).groupBy("_k").agg(F.max("_text").alias("text"), F.first("_y").alias("y"))

    def fit(table):
        import pickle

        import pyarrow as pa

        order = np.argsort(np.array(table.column("h").to_pylist(), dtype=np.int64), kind="stable")
        texts = table.column("text").to_pylist()
        net = Network().learn([texts[i] for i in order], np.array(table.column("y").to_pylist())[order])
        return pa.table({"net": pa.array([pickle.dumps((net.p, net.prior))], pa.binary())})

    learned = rows.select(F.lit(1).alias("one"), F.xxhash64("_k").alias("h"), "text", "y").groupBy("one").applyInArrow(fit, "net binary").collect()
    net = Network()
    if not learned:
        return net.learn([], np.zeros(0))
    import pickle

    net.p, net.prior = pickle.loads(bytes(learned[0]["net"]))
    return net


def classify(docs: DataFrame, network: Network, column: str = "text", threshold: float = 0.3) -> DataFrame:
    """The columns of docs, then score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        import pyarrow as pa

        net = shared.value
        for batch in batches:
            texts = row_texts(batch, column)
            score = np.concatenate([net.scores(texts[a:b]) for a, b in groups_of([len(t) for t in texts], BATCH)] or [np.zeros(0)])
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "score": pa.array(score, pa.float64()), "predicted": pa.array((score >= threshold).astype(np.int32), pa.int32())})

    return unboxed(boxed(docs).mapInArrow(run, boxed_schema(docs, "score double, predicted int")), docs, "score", "predicted")
