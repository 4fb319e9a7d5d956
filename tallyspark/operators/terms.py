"""Dictionaries of terms, looked up in whole texts by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The lower-case words of a text; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def dictionary_hits(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str, label: str, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(key, place, n_words, phrase, label): where a term's words stand in a text, but those inside a longer hit; places count words from 0.

    Runs of words, as long as some term, are joined to the terms by equality, so the dictionary may have any size; it is broadcast if its measured
    size (its phrases and 64 bytes a row) is at most `broadcast_bytes`, and else both sides are shuffled. Only the distinct lengths of terms reach the driver. A term of several labels has the smallest one, terms without a word or label are none.
    Overlapping hits stay, as neither is the longer one's part. Keys are to be unique.
    """
    known = terms.select(words(F.col(term)).alias("__w"), F.col(label).alias("label")).where(F.size("__w") > 0)
    known = known.groupBy(F.array_join("__w", " ").alias("phrase"), F.size("__w").alias("n_words")).agg(F.min("label").alias("label")).where("label is not null")
    sizes = {r["n_words"]: r["size"] for r in known.groupBy("n_words").agg(F.sum(F.octet_length("phrase") + 64).alias("size")).collect()}
    lengths = sorted(sizes)
    if not lengths:
        return texts.select(key).limit(0).select(key, F.lit(0).alias("place"), F.lit(0).alias("n_words"), F.lit("").alias("phrase"), F.lit(None).cast(known.schema["label"].dataType).alias("label"))

    def runs(n: int) -> Column:
        starts = F.when(F.size("__w") >= n, F.sequence(F.lit(0), F.size("__w") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("place"), F.lit(n).alias("n_words"), F.array_join(F.slice("__w", i + 1, F.lit(n)), " ").alias("phrase")))

    cut = texts.select(key, words(F.col(text)).alias("__w"))
    each = cut.select(key, F.explode(F.flatten(F.array(*map(runs, lengths)))).alias("x")).select(key, "x.*")
    looked_up = known.select("phrase", "label")
    hits = each.join(F.broadcast(looked_up) if sum(sizes.values()) <= broadcast_bytes else looked_up, "phrase")
    end = F.col("place") + F.col("n_words")
    before = Window.partitionBy(key).orderBy("place", F.desc("n_words")).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(end).over(before), F.lit(-1))
    return hits.withColumn("__reached", reached).where(F.col("__reached") < end).select(key, "place", "n_words", "phrase", "label")
