"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

A line's key is the line without white space at both ends and with A-Z lower-cased. Keys of at least
``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines, except those of
the largest id that holds the key. The rest stays in place, joined by a line feed.

Edge cases: a null or empty text is one empty line. Rows that share an id count as one document, and each of
them loses the same lines. A row without an id is returned whole: it counts as no document and loses nothing.
An empty table gives an empty result. Columns other than id and text aren't looked at.

Scale: only hashes and ids of long lines are shuffled for the count; it is pre-aggregated, and counts (hash, id)
pairs before hashes, so a line that a third of the documents hold is spread by id. Finding the lines to drop joins
each line's place with the few repeated hashes (AQE splits a hot hash). The texts move once, joined by id and text. A text
is reassembled from the stretches between its dropped positions, so the work on one grows with its lines, not their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, written


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def _digest(line: Column) -> Column:
    """128 bits of a line's key, as two longs."""
    key = ascii_lower(_trimmed(line))
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(id, h, drops): for each text that loses lines, by id and hash of the text, their positions from 0, in order."""
    # The hash stands below the explode, or it would be computed for each line.
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), _lines(F.col(text_col)).alias("lines")).select("id", "h", F.posexplode("lines").alias("pos", "line"))
    # Two steps, so that the cheaper test goes first.
    lines = lines.where(F.char_length("line") >= min_chars).where(F.char_length(_trimmed(F.col("line"))) >= min_chars)
    long = lines.select("id", "h", "pos", _digest(F.col("line")).alias("d")).select("id", "h", "pos", "d.a", "d.b")
    often = long.groupBy("a", "b").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).drop("n")
    # A table, so that the join stands between plain shuffles and AQE can broadcast it or split a hot hash.
    often = written(often, "often")
    return long.join(often, ["a", "b"]).where(F.col("id") != F.col("keeper")).groupBy("id", "h").agg(F.array_sort(F.collect_set("pos")).alias("drops"))


def _without(text: Column, drops: Column) -> Column:
    """The text's lines but those at the positions `drops`: the stretches before each of them and after the last."""

    def join(x: Column) -> Column:
        ends = F.arrays_zip(F.concat(F.array(F.lit(-1)), x["drops"]).alias("a"), F.concat(x["drops"], F.array(F.size(x["lines"]))).alias("b"))
        return F.array_join(F.flatten(F.transform(F.filter(ends, lambda e: e["b"] > e["a"] + 1), lambda e: F.slice(x["lines"], e["a"] + 2, e["b"] - e["a"] - 1))), "\n")

    # Inside a lambda a struct's field is read, where an expression would be split again for every stretch.
    return F.transform(F.array(F.struct(_lines(text).alias("lines"), drops.alias("drops"))), join)[0]


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with text_col replaced by what stays of it, and `line_stats`, a struct of n_lines and n_dropped."""
    drops = repeated_lines(docs, id_col, text_col, min_chars, min_docs).select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("drops").alias("__drops"))
    text, gone = F.coalesce(F.col(text_col), F.lit("")), F.col("__drops")
    n_lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    joined = docs.join(drops.hint("shuffle_hash"), (docs[id_col] == F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__h")), "left")
    stats = F.struct(n_lines.alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"))
    kept = F.when(gone.isNull(), text).otherwise(_without(text, gone))
    return joined.withColumn("line_stats", stats).withColumn(text_col, kept).drop("__id", "__h", "__drops")
