"""Readers of flat sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_rows(spark: SparkSession, path: str, pattern: str, fields: Mapping[str, int]) -> DataFrame:
    """Lines that fit a pattern, with its groups by name; lines that don't are dropped."""
    lines = spark.read.text(path)
    return lines.where(F.col("value").rlike(pattern)).select(*(F.regexp_extract("value", pattern, g).alias(n) for n, g in fields.items()))


def database(spark: SparkSession, url: str, tables: Mapping[str, str], **options: str) -> dict[str, DataFrame]:
    """Tables of a relational store; filters and columns are pushed down."""
    return {n: spark.read.format("jdbc").options(url=url, dbtable=t, **options).load() for n, t in tables.items()}


def attach_children(parents: DataFrame, children: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """parents with an array of their children, in order; null where there are none. A parent's children are few (games of a match, points of a game)."""
    rest = [order, *(c for c in children.columns if c not in (key, order))]
    grouped = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
    return parents.join(grouped, key, "left")
