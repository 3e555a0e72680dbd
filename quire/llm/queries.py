"""The registered queries of this subpackage and their SQL, where SQL can express them.

Each query applies an operator with production parameters to its whole table and derives the columns
of its contract from the operator's own results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.pmod(F.col("id"), F.lit(20)) == 0, "vec_id", "embedding", k=20)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import cut_repeats

    out = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    longest = F.coalesce(F.array_max(F.transform("repeats", lambda r: r["behind"] - r["first"])), F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.size("repeats").cast("long").alias("n_repeats"), longest.alias("longest_repeat"))


def op3_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    network = train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return classify(docs, network, threshold=0.3).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import rotate

    out = rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return out.withColumn("mask", mask)


def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    dice = F.crc32(F.col("doc_id").cast("string"))
    held_out = F.coalesce(F.pmod(dice, F.lit(7)) == 2, F.lit(False))
    out = score(docs, ~held_out, F.pmod(F.floor(dice / 7), F.lit(8)) == 0)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .arc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"), "page_id", "url", "html", least_bytes=0)


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near import classes

    return classes(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "class_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import drop_common_lines

    out = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least_docs=10, least_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near_items"),
    )


def op10_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), weights=(1.0, 2.0, 3.0), top=3)
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_rp_forest, op2_substring_dedup, op3_byte_cnn_quality, op4_perspective_rotation, op5_deleted_interpolation, op6_arc_to_warc, op7_order_minhash, op8_line_dedup, op9_decontamination, op10_entropy_mixing)
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35),
k AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS h FROM p),
dup AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(generate_series(i, i + 34)) AS j FROM k SEMI JOIN dup USING (h)) GROUP BY doc_id),
o AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed, ws, gone FROM w LEFT JOIN hit USING (doc_id)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t FROM (
  SELECT doc_id, unnest(ws) AS x, unnest(generate_series(1, len(ws))) AS j FROM w) a
  ANTI JOIN (SELECT doc_id, unnest(gone) AS j FROM hit) b USING (doc_id, j) GROUP BY doc_id),
runs AS (SELECT doc_id, count(*) AS n_repeats, max(size) AS longest_repeat FROM (
  SELECT doc_id, count(*) AS size FROM (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS run FROM (SELECT doc_id, unnest(gone) AS j FROM hit)) GROUP BY doc_id, run) GROUP BY doc_id)
SELECT o.doc_id, n_words, n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(n_repeats, 0) AS n_repeats, coalesce(longest_repeat, 0) AS longest_repeat
FROM o LEFT JOIN kept USING (doc_id) LEFT JOIN runs USING (doc_id)""",
    "op4_perspective_rotation": r"""
WITH t AS (
  SELECT conv_id, CAST(floor(turn / 4096) AS BIGINT) AS segment, turn, coalesce(role, 'unknown') AS role,
    replace(replace(coalesce(text, ''), '<|im_start|>', '<|im_start |>'), '<|im_end|>', '<|im_end |>') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, text) AS r FROM t WHERE role = 'system') WHERE r = 1),
g AS (SELECT DISTINCT conv_id, segment FROM t),
a AS (
  SELECT conv_id, segment, turn, role, text, 1 AS place FROM t UNION ALL
  SELECT g.conv_id, g.segment, turn, role, text, 0 FROM g JOIN f ON g.conv_id IS NOT DISTINCT FROM f.conv_id WHERE g.segment > coalesce(f.segment, -4611686018427387904)),
x AS (
  SELECT a.conv_id, speaker, segment, turn, role, text, place, role = speaker AS own,
    CASE WHEN role = speaker THEN '<|im_start|>assistant' || chr(10) WHEN role = 'system' THEN '<|im_start|>system' || chr(10)
      ELSE '<|im_start|>user name=' || translate(replace(replace(role, '<|im_start|>', '<|im_start |>'), '<|im_end|>', '<|im_end |>'), chr(13) || chr(10), '  ') || chr(10) END AS head,
    text || '<|im_end|>' || chr(10) AS body
  FROM a JOIN s ON a.conv_id IS NOT DISTINCT FROM s.conv_id),
y AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, segment ORDER BY place, turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS behind FROM x)
SELECT conv_id, speaker, segment, CAST(count(*) FILTER (place = 1) AS INT) AS n_turns, CAST(count(*) FILTER (own) AS INT) AS n_own,
  string_agg(head || body, '' ORDER BY place, turn NULLS FIRST, role, text) AS rendered,
  coalesce(string_agg(CAST(behind - length(body) AS VARCHAR) || '-' || CAST(behind AS VARCHAR), ',' ORDER BY place, turn NULLS FIRST, role, text) FILTER (own), '') AS mask
FROM y GROUP BY conv_id, speaker, segment""",
    "op6_arc_to_warc": r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(hex, 5 * g + 1, 5))::BIGINT >> (15 - 5 * q)) & 31 AS INT), 1), '' ORDER BY g, q)
  FROM range(8) a(g), range(4) c(q)) AS payload_digest FROM p),
f AS (SELECT hex, min(page_id) AS first_id FROM p GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM b JOIN f USING (hex)""",
    "op8_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
o AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM o GROUP BY doc_id""",
    "op9_decontamination": r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents, low),
q AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark, low),
qs AS (SELECT item_id, ws, least(len(ws), 10) AS n FROM q WHERE len(ws) > 0),
qw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT *, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM qs)),
ns AS (SELECT DISTINCT n FROM qs),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, ns WHERE len(ws) >= n)),
m AS (SELECT doc_id, item_id, i, n FROM dw JOIN qw USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id),
qn AS (SELECT DISTINCT item_id, n, array_to_string(list_sort(string_split(k, ' ')), ' ') AS k FROM qw),
dn AS (SELECT DISTINCT doc_id, n, array_to_string(list_sort(string_split(k, ' ')), ' ') AS k FROM dw),
nr AS (SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM dn JOIN qn USING (n, k) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nr USING (doc_id)""",
}
