"""Outputs: bucketed documents, pruning of what is stale, and writing only what has changed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..operators.incremental import row_hash


def write_buckets(rows: DataFrame, key: str, size: int, path: str) -> None:
    """Many small documents a file: rows by floor(key / size), each file's rows in order of key. Only buckets with rows are overwritten."""
    x = rows.withColumn("bucket", F.floor(F.col(key) / size))
    x.repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").json(path)


def write_boards(rows: DataFrame, parts: Sequence[str], order: Sequence[str], path: str) -> None:
    """One folder for each combination of parts; other folders stay."""
    rows.repartition(*parts).sortWithinPartitions(*parts, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def write_details(details: DataFrame, keys: Sequence[str], path: str, compression: str = "none") -> None:
    """Nested documents, a file for each: folders by keys (the last may be `part`), which `sources.details.read_details` reads by its partitioned layout, also as gzip. Only folders with rows are overwritten."""
    details.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy(*keys).json(path)


def documents(rows: DataFrame, key: str, name: str = "document") -> DataFrame:
    """(key, document): each row as JSON."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias(name))


def stale(outputs: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Outputs that the index no longer has."""
    return outputs.join(index.select(key), key, "left_anti")


def changed(new: DataFrame, old: DataFrame, key: str, ignored: Sequence[str] = ("generated_at",)) -> DataFrame:
    """Rows of new whose content, but for the ignored columns, the old output doesn't have."""
    sign = lambda d: row_hash([c for c in d.columns if c != key], ignored).alias("__h")
    known = old.select(key, sign(old))
    return new.withColumn("__h", sign(new)).join(known, [key, "__h"], "left_anti").drop("__h")


def without_fields(rows: DataFrame, internal: Callable[[str], bool]) -> DataFrame:
    """rows without every column and nested field whose name is internal."""

    def keep(kind, col):
        if isinstance(kind, StructType):
            return F.when(col.isNotNull(), F.struct(*(keep(f.dataType, col[f.name]).alias(f.name) for f in kind if not internal(f.name))))
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
            return F.transform(col, lambda x: keep(kind.elementType, x))
        return col

    return rows.select(*(keep(f.dataType, F.col(f.name)).alias(f.name) for f in rows.schema if not internal(f.name)))


def sitemap(rows: DataFrame, hidden: DataFrame, loc: str = "loc") -> DataFrame:
    """Distinct locations that aren't hidden, in order."""
    return rows.dropDuplicates([loc]).join(hidden.select(loc), loc, "left_anti").orderBy(loc)


def read_output(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
