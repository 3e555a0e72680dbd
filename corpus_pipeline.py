"""A corpus from raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Whoever runs the stages writes each result as Parquet and reads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontam, lines, mixing, near, quality
from quire.llm.exchange import shared_dir

#: SQL cannot express a neural network or connected components of an alignment.
ORACLE_SQL = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bundled(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one: an operator's new columns replace none of them."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest")) if rest else docs


def unbundled(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[F.col(c if c in ("doc_id", "text") else f"_rest.`{c}`") for c in docs.columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more; it learns from the labelled ones of them."""
    usable = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0, F.lit(False))
    network = quality.train(docs, table(spark, sf_dir, "labels"), usable)
    return unbundled(quality.classify(bundled(docs), network, threshold=0.3).filter("predicted = 1"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that ten or more distinct texts hold; copies wait for the next stage."""
    out = lines.drop_common_lines(bundled(docs), lines.of_distinct_texts(docs), least_docs=10, least_chars=1)
    chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("_rest.n_chars"))
    return unbundled(out.withColumn("_rest", F.col("_rest").withField("n_chars", chars.cast(docs.schema["n_chars"].dataType))), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least id."""
    return near.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of ten consecutive words of a benchmark item."""
    return unbundled(decontam.contamination(bundled(docs), table(spark, sf_dir, "benchmark"), window=10).filter("n_hit = 0"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document appears once for each copy that its source's target calls for. The mix's own
    columns replace columns of their names."""
    out = mixing.mix(docs, weights=(1.0, 2.0, 3.0), top=3).filter("copies > 0")
    new = ["size", "source_size", "target", "copies", "copy"]
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], *new)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_dir(spark)
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
