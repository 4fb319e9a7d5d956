"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import as_table, shared_dir  # noqa: F401

#: The white space that separates words and pads lines, in every operator here.
SPACE = " \t\n\x0b\x0c\r"
#: Cuts lineage: a DataFrame as a table in the shared folder.
written = as_table
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches_for(size: int, batch_bytes: int) -> int:
    """How many batches texts of so many bytes are dealt to: of batch_bytes each, beyond a terabyte of 8 * sqrt(size), so that what a batch sends to a bucket doesn't shrink to nothing."""
    return max(1, -(-size // max(batch_bytes, 8 * math.isqrt(size))))


def dealing_key(id_col: str = "id", text_col: str = "text") -> Column:
    """By what rows are dealt to batches: the id's hash, and the text's where there is no id, so that a table without ids is no single batch."""
    return F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col))


def ascii_lower(col: Column) -> Column:
    """A-Z only; lower() does just that, and faster, where the text is pure ASCII."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))
