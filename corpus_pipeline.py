"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Each stage takes what the one before has kept; all but the last return the columns of documents. n_chars follows the text.
Rows without an id take part as far as the stage's operator lets them, and stay where it has no verdict on them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import table, written
from tallyspark.llm.decontamination import leaks
from tallyspark.llm.jaccard_join import jaccard_components
from tallyspark.llm.line_dedup import line_dedup
from tallyspark.llm.packing import pack_documents
from tallyspark.llm.quality import quality
from tallyspark.llm.queries import vocabulary
from tallyspark.session import scratch


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but those whose doc_id is in `gone`; rows without an id stay, spread by their texts."""
    key: list[Column] = [F.col("doc_id").isNull().alias("__none"), F.coalesce("doc_id", F.xxhash64("text")).alias("__key")]
    lost = gone.where("doc_id is not null").select(*key[:1], F.col("doc_id").alias("__key")).distinct()
    return docs.select("*", *key).join(lost.hint("shuffle_hash"), ["__none", "__key"], "left_anti").select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    names = docs.columns
    row = [F.xxhash64(*names).alias("__a"), F.xxhash64(F.lit("second"), *names).alias("__b")]
    judged = quality(docs.select("*", *row), table(spark, sf_dir, "labels"), carry=("__a", "__b"))
    rejected = judged.where(~F.col("keep")).select("__a", "__b").distinct()
    return docs.select("*", *row).join(rejected.hint("shuffle_hash"), ["__a", "__b"], "left_anti").select(*names)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that many documents hold; a null text becomes empty."""
    return line_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id."""
    return _without(docs, jaccard_components(docs).where("doc_id <> component_id").select("doc_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return _without(docs, leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece of a document."""
    return pack_documents(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: SQL expresses neither the classifier nor the template search; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is a table; what it needed on the way is deleted once that is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, keep=True)
    return docs
