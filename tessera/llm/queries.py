"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chroma, decontamination, jaccard, licenses, lines, masked_lm, mixing, quality, secrets, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as lines of text between tags, without each host's boilerplate lines."""
    pages = _table(spark, sf_dir, "pages").select("page_id", lines.host_of(F.col("url")).alias("host"), lines.html_lines(F.col("html")).alias("text"))
    return lines.drop_boilerplate_lines(pages, F.col("host"), counts=True)


def op2_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as a recording of 8-bit samples (the tables hold no audio), against those with ids divisible by 50.

    Rows of kind "member" give each document its class of equal fingerprints and its group of aligned classes; rows of
    kind "pair" all aligned pairs of a query's class and another class.
    """
    documents = _table(spark, sf_dir, "documents")
    prints = chroma.fingerprint_column(documents, F.col("doc_id"), F.col("text"))
    classes, pairs = chroma.align_queries(prints, F.col("id") % chroma.QUERY_MODULUS == 0)
    none = lambda kind: F.lit(None).cast(kind)
    members = classes.select(
        F.lit("member").alias("kind"), F.col("id").alias("doc_id"), "class_id", "group_id", "frames", "members", "is_query", none("long").alias("query_class_id"),
        none("int").alias("offset"), none("long").alias("votes"), none("long").alias("overlap"), none("double").alias("bit_errors"),
    )
    found = pairs.select(
        F.lit("pair").alias("kind"), none("long").alias("doc_id"), "class_id", none("long").alias("group_id"), none("long").alias("frames"), none("long").alias("members"), none("boolean").alias("is_query"),
        "query_class_id", "offset", "votes", "overlap", "bit_errors",
    )
    return members.union(found)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).drop("source")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licences(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it contains."""
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score_documents(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base_spans", lambda x: F.startswith(x, F.lit(f"{kind}:")))).cast("long")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(F.array_join("base_spans", ","), 256).alias("base_sha256"),
        F.array_join("spans", ",").alias("spans"),
        F.size("links").cast("long").alias("n_links"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_chroma_fingerprints, op3_source_mixing, op4_ngram_jaccard_join, op5_toxicity, op6_license_scan,
        op7_benchmark_decontamination, op8_masked_lm, op9_quality, op10_secret_scan,
    )
}
