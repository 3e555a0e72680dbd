"""Legacy web archives: ARC records in, equivalent WARC records out, and back to rows.

An ARC file opens with a ``filedesc://`` record whose body names the version and the fields of all
header lines that follow; the header line of a record ends in the declared length of its body. Version 1
has five fields, version 2 ten. The converter walks by declared lengths, never by looking for markers in
payloads, and makes of each record a WARC record: an identifier derived from its content and place, the
14-digit date as a W3C date, the type, and SHA-1 digests of payload and block. Records with an equal
payload of at least ``least_bytes`` are ``revisit`` records of the one with the smallest key.

Converted records are stored once, so that their identifiers stay as they are. Equal payloads are found
by digests alone, of which only those that occur more than once come back to the records: broadcast where
they are few, else a join by identifier. Archives are files of Spark's own text writer in the shared folder
(header and payload are UTF-8; any file system Spark writes to will do), of at most about 128 MB before
compression or one record, read back whole and parsed by declared lengths.

Defined results: a null payload is empty; a null URL is ``unknown:``; repeated rows are records of
their own with identifiers of their own, of which the smallest key is the response (equal keys: all of
them); an empty table gives an empty archive and result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import Shelf, shared_dir

#: The header fields of the two versions of the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed value: the profile of revisit records by payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records in an archive file by their greatest payload (None: any); files are read whole.
FILES = ((64_000, 2_000), (4_000_000, 32), (None, 1))
#: Digests (about 100 bytes each, with what belongs to them) that may be broadcast.
BROADCAST_ROWS = 200_000
#: Rows of a batch in a Python worker.
BATCH_ROWS = 256


class ArcError(ValueError):
    """The bytes are not an ARC file of a known version, or end before a declared length."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _token(value: str) -> str:
    """A header field: no white space in it."""
    return "".join("%%%02X" % ord(c) if c in " \t\r\n\x0b\x0c" else c for c in value) or "-"


def arc_record(version: int, url: str, date: str, body: bytes, ip: str = "0.0.0.0", kind: str = "text/html", offset: int = 0, filename: str = "-") -> bytes:
    """One record with its header line, as the version has it."""
    fields = [_token(url), ip, date, kind]
    if version == 2:
        fields += ["200", digest(body), "-", str(offset), filename]
    return (" ".join([*fields, str(len(body))]) + "\n").encode() + body + b"\n"


def arc_head(version: int, filename: str = "records.arc", date: str = "19960101000000") -> bytes:
    body = f"{version} 0 quire\n{FIELDS[version]}\n".encode()
    fields = [f"filedesc://{filename}", "0.0.0.0", date, "text/plain"]
    if version == 2:
        fields += ["200", "-", "-", "0", filename]
    return (" ".join([*fields, str(len(body))]) + "\n").encode() + body + b"\n"


def read_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file: the header's fields by lower-case name, ``version`` and ``body``."""
    at, names, version = 0, None, 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            if data[at:].strip():
                raise ArcError("a header line does not end")
            return
        if end == at or data[at:end] == b"\r":  # blank lines between records
            at = end + 1
            continue
        values = data[at:end].rstrip(b"\r").decode("utf-8", "replace").split(" ")
        try:
            size = int(values[-1])
        except ValueError:
            raise ArcError("a header line has no length") from None
        body = data[end + 1 : end + 1 + size]
        if size < 0 or len(body) < size:
            raise ArcError("a record is shorter than its declared length")
        at = end + 1 + size
        if names is None:
            lines = body.decode("utf-8", "replace").split("\n")
            if not values[0].startswith("filedesc://") or len(lines) < 2 or not lines[0][:1].isdigit():
                raise ArcError("the file has no version block")
            version, names = int(lines[0].split(" ")[0]), lines[1].split()
            if version not in FIELDS or names != FIELDS[version].split():
                raise ArcError("the version is not known")
            continue
        if len(values) < len(names):
            raise ArcError("a header line lacks fields")
        extra = len(values) - len(names)  # blanks that a writer left in the URL
        values = [" ".join(values[: extra + 1]), *values[extra + 1 :]]
        yield {n.lower(): v for n, v in zip(names, values, strict=True)} | {"version": version, "body": body}


def warc_date(date: str) -> str:
    """A 14-digit date, or the digits there are, as a W3C date."""
    full = (date + "00000101000000"[len(date) :]) if date.isdigit() and 4 <= len(date) < 14 else date
    full = full if full.isdigit() and len(full) == 14 else "19700101000000"
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:]}Z"


def record_id(url: str, date: str, payload_digest: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join((url, date, payload_digest, key)))}>"


def warc_header(fields: list[tuple[str, str]]) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"


def convert(arc: dict, key: str) -> dict:
    """The WARC fields of an ARC record."""
    sha = digest(arc["body"])
    date = warc_date(arc["archive-date"])
    return {"id": record_id(arc["url"], date, sha, key), "date": date, "url": arc["url"], "kind": arc["content-type"], "sha": sha, "size": len(arc["body"])}


def read_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields by lower-case name, block) of every record, by declared lengths."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError("a record does not begin with its version")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")[1:]
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size
        if len(block) < size or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record is not as long as declared")
        at += 4
        yield head, block


def to_arc(pages: DataFrame, key: str, url: str, payload: str, version: int = 1) -> DataFrame:
    """(key, record): every page as the bytes of a small ARC file, dated by nothing but its version."""

    def write(batches):
        import pyarrow as pa

        head = arc_head(version)
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(a, BATCH_ROWS)
                rows = zip(part.column("url").to_pylist(), part.column("payload").to_pylist(), strict=True)
                records = [head + arc_record(version, u or "unknown:", "19960101000000", p or b"") for u, p in rows]
                yield pa.RecordBatch.from_pydict({"key": part.column("key"), "record": pa.array(records, pa.binary())})

    kind = pages.schema[key].dataType.simpleString()
    return pages.selectExpr(f"`{key}` AS key", f"`{url}` AS url", f"CAST(`{payload}` AS BINARY) AS payload").mapInArrow(write, f"key {kind}, record binary")


def convert_archives(arcs: DataFrame) -> DataFrame:
    """(key, id, date, url, kind, sha, size, block) of (key, record), the bytes of ARC files. Several
    records in a file get keys of their own only through their identifiers, which also hold the place of
    the row among its task's: store the result before using it twice."""

    def read(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        place = f"{context.partitionId() if context else 0}/"
        done = 0
        names = ("id", "date", "url", "kind", "sha", "size")
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(a, BATCH_ROWS)
                keys, rows, blocks = [], [], []
                for i, (k, data) in enumerate(zip(part.column("key").to_pylist(), part.column("record").to_pylist(), strict=True)):
                    for n, arc in enumerate(read_arc(data or b"")):
                        keys.append(i)
                        rows.append(convert(arc, f"{k}/{n}/{place}{done + i}"))
                        blocks.append(arc["body"])
                done += part.num_rows
                yield pa.RecordBatch.from_pydict(
                    {"key": part.column("key").take(pa.array(keys, pa.int64())), "block": pa.array(blocks, pa.binary())}
                    | {n: pa.array([r[n] for r in rows], pa.int64() if n == "size" else pa.string()) for n in names}
                )

    kind = arcs.schema["key"].dataType.simpleString()
    return arcs.mapInArrow(read, f"key {kind}, block binary, id string, date string, url string, kind string, sha string, size long")


def with_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds refers_to, refers_id: the record with the smallest key among those of an equal payload,
    null for that one itself (and its equals)."""
    slim = records.filter(F.col("size") >= least_bytes).select("key", "sha", "id")
    firsts = slim.groupBy("sha").agg(F.min(F.struct("key", "id")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("sha").alias("of"), F.col("f.key").alias("to"), F.col("f.id").alias("to_id"))
    later = ~F.col("key").eqNullSafe(F.col("to"))
    if firsts.count() <= BROADCAST_ROWS:
        both = records.join(F.broadcast(firsts), (F.col("sha") == F.col("of")) & (F.col("size") >= least_bytes), "left")
        revisit = F.col("of").isNotNull() & later
        return both.select(*records.columns, F.when(revisit, F.col("to")).alias("refers_to"), F.when(revisit, F.col("to_id")).alias("refers_id"))
    revisits = slim.join(firsts, F.col("sha") == F.col("of")).filter(later).select(F.col("id").alias("rid"), F.col("to").alias("refers_to"), F.col("to_id").alias("refers_id"))
    return records.join(revisits, records["id"] == revisits["rid"], "left").drop("rid")


def warc_text(records: DataFrame) -> DataFrame:
    """One string a record: header and block, without the two line ends behind it."""
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", F.col("id")), line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(revisit, F.lit(digest(b""))).otherwise(F.col("sha")))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.col("refers_id")), line("X-Refers-To-Key", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        F.when(F.col("key").isNotNull(), line("X-Record-Key", F.col("key").cast("string"))).otherwise(F.lit("")), line("X-Payload-Length", F.col("size").cast("string")),
        line("Content-Type", F.col("kind")), line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))), F.lit("\r\n"),
    )
    return records.select(F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("block").cast("string"))).alias("value"))


def write_warc(records: DataFrame, path: str, files: tuple = FILES) -> None:
    """Writes WARC files (gzip) in a folder for each class of payload sizes that there is. The text writer
    ends every record with its line separator, which is what a WARC record ends with."""
    least = -1
    for most, per_file in files:
        own = records.filter(F.col("size") > least) if most is None else records.filter((F.col("size") > least) & (F.col("size") <= most))
        if least < 0 or not own.isEmpty():
            warc_text(own).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(f"{path}/of_{per_file}")
        least = most


def read_archives(spark: SparkSession, path: str, key: str = "key", kind: str = "long", blocks: bool = False) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) and, if asked for, block of all
    records of the WARC files in a folder. Digests are checked against payloads and blocks."""

    def read(batches):
        import gzip

        import pyarrow as pa

        names = ("key", "size", "sha", "type", "to", "block")
        for batch in batches:
            for data in batch.column("content").to_pylist():
                out: dict[str, list] = {n: [] for n in names}
                for head, block in read_warc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    sha = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-block-digest"] != f"sha1:{digest(block)}" or (head["warc-type"] == "response" and digest(block) != sha):
                        raise ValueError(f"{head['warc-record-id']} does not have its digest")
                    row = (head.get("x-record-key"), int(head.get("x-payload-length", len(block))), sha, head["warc-type"], head.get("x-refers-to-key"), block if blocks else None)
                    for n, v in zip(names, row, strict=True):
                        out[n].append(v)
                yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64() if n == "size" else pa.binary() if n == "block" else pa.string()) for n, v in out.items()})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("content")
    out = files.mapInArrow(read, "key string, size long, sha string, type string, to string, block binary")
    columns = [F.col("key").cast(kind).alias(key), F.col("size").alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.col("type").alias("record_type"), F.col("to").cast(kind).alias("refers_to")]
    return out.select(*columns, *(["block"] if blocks else []))


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", version: int = 1, least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Pages as ARC records, converted to WARC files in ``path``, and what the files hold."""
    spark = pages.sparkSession
    path, shelf = path or shared_dir(spark), Shelf(spark)
    records = shelf.put("records", convert_archives(to_arc(pages, key, url, payload, version)))
    write_warc(with_revisits(records, least_bytes), path)
    shelf.drop("records")
    return read_archives(spark, path, key, pages.schema[key].dataType.simpleString())
