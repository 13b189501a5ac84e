"""A corpus pipeline of five stages; each stage's result is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, jaccard, lines, mixing, toxicity
from tessera.llm.common import drop_settled, settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A source is far larger than a web site, so a line that repeats is a smaller share of it, on more documents.
LINE_RATIO, LINE_PAGES = 0.005, 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["lang", "source", "n_chars", "text"])
    return scored.where("predicted = 0").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; n_chars follows the text."""
    kept = lines.drop_boilerplate_lines(docs, F.col("source"), max_ratio=LINE_RATIO, min_pages=LINE_PAGES, texts=2)
    changed = F.length("text").cast("long")
    return kept.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(changed)).select(COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id; texts without words are no group."""
    classes = jaccard.jaccard_classes(docs)
    # Rows that repeat an id are one document: they stay or go together.
    dropped = settle(classes.where("component_id is not null and doc_id is not null and component_id != doc_id").select(F.col("doc_id").alias("__dropped")).distinct(), "dropped")
    return docs.join(dropped, F.col("doc_id") == F.col("__dropped"), "left_anti").select(COLUMNS)


def drop_benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark text."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents with the words that the mix takes of each."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_benchmark_texts),
    ("source_mixing", mix_sources),
]

#: A trained classifier and a latent space are not SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        after = settle(stage(spark, docs, sf_dir), f"pipeline-{number}-{name}")
        if number:
            drop_settled(docs)
        docs = after
    return docs
