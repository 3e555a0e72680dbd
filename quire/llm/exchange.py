"""Exact questions about all documents, asked by chunks of documents and answered by shards of keys.

Documents are dealt by the hash of their whole row identity to chunks of bounded size. A chunk asks
about its *distinct* keys (hashes of 128 bits in two halves, or of 64), packed by shard; a shard gathers what all chunks say about
a key and answers each of them. A key that a third of all rows hold is therefore one entry per chunk:
no key is hot, and no pairs arise. Chunks and shards grow in number with the input, never in size. A
message from a chunk to a shard has a key at least, so there are never more messages than distinct keys of
the chunks, however many shards there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytestext import wide_place, wide_tally

#: Bytes of text in a chunk, and chunks to a shard.
CHUNK_BYTES = 8_000_000
CHUNKS_PER_SHARD = 3


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared one that the cluster names in ``spark.checkpoint.dir``; where that is
    unset, one in the warehouse of a local session, as in tests, and an error on a cluster."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/quire-shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


class Shelf:
    """The stored tables of one computation, in a database of their own in the shared folder. They cut
    lineage, and dropping one deletes its files."""

    def __init__(self, spark: SparkSession):
        import uuid

        self.spark, self.name = spark, f"quire_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {self.name} LOCATION '{shared_dir(spark)}'")

    def put(self, table: str, df: DataFrame, **options: str) -> DataFrame:
        df.write.options(**options).saveAsTable(f"{self.name}.{table}")
        release(self.spark)
        return self.spark.table(f"{self.name}.{table}")

    def drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}.{table}")


def ensure_checkpoints(spark: SparkSession) -> None:
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def release(spark: SparkSession) -> None:
    """Lets go of finished jobs' shuffle files: Spark deletes them when the driver collects the plans
    that wrote them, which a driver with memory to spare may not do for long."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let_go() -> None:
    """Gives memory that this process has freed back to the system."""
    import contextlib
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a system without glibc
        ctypes.CDLL(None).malloc_trim(0)


def frugal(work):
    """A function on batches whose worker lets go of its memory when the task is done. Spark keeps workers for
    later tasks and stages; what they hold on to counts there too, beside an executor that has grown."""

    def run(batches):
        yield from work(batches)
        let_go()

    return run


def text_size(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows, and bytes of a text column."""
    row = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(column))).first()
    return int(row[0] or 0), int(row[1] or 0)


def chunk_count(docs: DataFrame, column: str = "text", chunk_bytes: int = CHUNK_BYTES) -> int:
    rows, size = text_size(docs, column)
    return int(max(1, -(-size // chunk_bytes), -(-rows // 200_000), min(rows, 12)))


def shard_count(chunks: int) -> int:
    return max(min(chunks, 12), -(-chunks // CHUNKS_PER_SHARD))


def in_chunks(docs: DataFrame, chunks: int, **more: Column) -> DataFrame:
    """Boxed rows with ``chunk``, dealt by the hash of all their columns that can be hashed; so copies
    of a text under different ids do not meet in one chunk. more: further columns beside the box."""

    def plain(kind) -> bool:
        return not any(x in kind.simpleString() for x in ("map<", "variant", "geo", "void"))

    keys = [f"`{f.name}`" for f in docs.schema.fields if plain(f.dataType)]
    dice = F.xxhash64(*[docs[k] for k in keys]) if keys else F.lit(0)
    return docs.select(_box(docs), F.pmod(dice, F.lit(chunks)).cast("int").alias("chunk"), *[c.alias(k) for k, c in more.items()])


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Sorted keys to contiguous shards by their high bits."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def by_shard(keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) for sorted keys, without the empty ones."""
    cut = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
    return [(s, int(a), int(b)) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences of as few bytes as the largest one takes."""
    if not len(keys):
        return b""
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = 1
    rest = int(gaps[1:].max()) if len(gaps) > 1 else 0
    while rest >> (8 * width):
        width += 1
    planes = gaps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(keys[0]).to_bytes(8, "little") + np.ascontiguousarray(planes.T).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype=np.uint64)
    width, head = blob[0], int.from_bytes(blob[1:9], "little")
    planes = np.frombuffer(blob, dtype=np.uint8, offset=9).reshape(width, -1)
    wide = np.zeros((planes.shape[1] + 1, 8), dtype=np.uint8)
    wide[1:, :width] = planes.T
    gaps = wide.view("<u8").reshape(-1)
    gaps[0] = head
    return np.cumsum(gaps, dtype=np.uint64)


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs (or the sum of its weights)."""
    if weights is None:
        keys = np.sort(keys)
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        return keys[new], np.diff(np.append(new, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[new], np.add.reduceat(weights, new) if len(new) else weights[:0]


ASKED = "chunk int, shard int, keys binary, lows binary, counts binary"
FOUND = "chunk int, found binary, lows binary"


def lows_of(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """The low halves of keys; keys of 64 bits have none."""
    return np.frombuffer(blob, dtype="<u8") if blob else np.zeros(len(keys), dtype=np.uint64)


def asked_table(rows: list[tuple]):
    import pyarrow as pa

    kinds = {"chunk": pa.int32(), "shard": pa.int32(), "keys": pa.binary(), "lows": pa.binary(), "counts": pa.binary()}
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds.items())})


def gathered(table) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """Chunks, keys and their low halves of the questions that a shard has got."""
    keys = [unpack(x) for x in table.column("keys").to_pylist()]
    return table.column("chunk").to_pylist(), keys, [lows_of(x, k) for x, k in zip(table.column("lows").to_pylist(), keys, strict=True)]


def found_table(rows: list[tuple]):
    """Of (chunk, keys, lows) those with keys, as FOUND."""
    import pyarrow as pa

    rows = [(c, pack(k), x.astype("<u8").tobytes() if x.any() else b"") for c, k, x in rows if len(k)]
    return pa.table({"chunk": pa.array([c for c, _, _ in rows], pa.int32()), "found": pa.array([k for _, k, _ in rows], pa.binary()), "lows": pa.array([x for _, _, x in rows], pa.binary())})


def repeated(asked: DataFrame, least: int) -> DataFrame:
    """From questions (ASKED) the answers (FOUND): the keys asked by the chunk whose counts over all
    chunks come to ``least``. Counts are uint8 and cut at 255."""

    def answer(table):
        chunks, keys, lows = gathered(table)
        counts = [np.frombuffer(x, dtype=np.uint8) for x in table.column("counts").to_pylist()]
        high, low, total = wide_tally(np.concatenate(keys), np.concatenate(lows), np.concatenate(counts).astype(np.int64))
        often = total >= least
        high, low = high[often], low[often]
        out = []
        for c, k, x in zip(chunks, keys, lows, strict=True):
            hit = wide_place(k, x, high, low) >= 0
            out.append((c, k[hit], x[hit]))
        return found_table(out)

    return asked.groupBy("shard").applyInArrow(answer, FOUND)


def question(chunk: int, keys: np.ndarray, shards: int, lows: np.ndarray | None = None):
    """The rows (ASKED) of a chunk for the keys it holds, repeats included."""
    if lows is None:
        every, n = tally(keys)
        low = None
    else:
        every, low, n = wide_tally(keys, lows)
    n = np.minimum(n, 255).astype(np.uint8)
    return asked_table([(chunk, s, pack(every[a:b]), b"" if low is None else low[a:b].astype("<u8").tobytes(), n[a:b].tobytes()) for s, a, b in by_shard(every, shards)])


def found_keys(table) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a chunk's answers, sorted, with their low halves."""
    none = np.zeros(0, dtype=np.uint64)
    parts = [unpack(x) for x in table.column("found").to_pylist()]
    lows = [lows_of(x, k) for x, k in zip(table.column("lows").to_pylist(), parts, strict=True)]
    return wide_tally(np.concatenate([none, *parts]), np.concatenate([none, *lows]))[:2]


def boxed(docs: DataFrame) -> DataFrame:
    """All columns in one struct ``row``, so that no name of theirs can clash with an operator's own."""
    return docs.select(_box(docs))


def _box(docs: DataFrame) -> Column:
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")


def unboxed(df: DataFrame, docs: DataFrame, *new: str) -> DataFrame:
    """The columns of ``row`` and the new ones, which replace columns of the same name."""
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new], *new)


def boxed_schema(docs: DataFrame, more: str):
    from pyspark.sql import types as T

    fields = [T.StructField("row", T.StructType(docs.schema.fields)), *T.StructType.fromDDL(more).fields]
    return T.StructType(fields)


def row_texts(table, column: str) -> list[bytes]:
    """The texts of a table of boxed rows; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from .bytestext import text_bytes

    row = table.column("row")
    row = row.combine_chunks() if isinstance(row, pa.ChunkedArray) else row
    return text_bytes(pc.struct_field(row, [row.type.get_field_index(column)]))


def row_lengths(table, column: str) -> list[int]:
    """Bytes of the texts of a table of boxed rows, without making them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    row = table.column("row")
    row = row.combine_chunks() if isinstance(row, pa.ChunkedArray) else row
    return pc.fill_null(pc.binary_length(pc.struct_field(row, [row.type.get_field_index(column)])), 0).to_pylist()


def strings(values: list):
    import pyarrow as pa

    return pa.array(values, pa.binary()).cast(pa.string(), safe=False)
