"""Rows out of texts: links, claims and lint findings, by built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, has_any, link_kind

ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>"""


def links(pages: DataFrame, keys: Sequence[str], html: str = "html", keywords: Sequence[str] = ("result", "record", "score")) -> DataFrame:
    """(keys, href, title, kind, keyword): distinct links of a page with an http, relative or other usable target; images only if they name a keyword."""
    each = pages.select(*keys, F.explode(F.regexp_extract_all(F.col(html), F.lit(ANCHOR), 0)).alias("a"))
    x = each.select(*keys, collapse(F.regexp_extract("a", ANCHOR, 1)).alias("href"), collapse(F.regexp_replace(F.regexp_extract("a", ANCHOR, 2), "<[^>]*>", "")).alias("title"))
    x = x.where((F.col("href") != "") & ~F.lower("href").rlike("^(javascript|mailto):"))
    x = x.withColumn("kind", link_kind(F.col("href"))).withColumn("keyword", has_any(F.concat_ws(" ", "title", "href"), keywords))
    return x.where((F.col("kind") != "image") | F.col("keyword")).distinct()


def claims(texts: DataFrame, key: str, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """(key, claim, value, place): every match of each named pattern's first group, by its place among that pattern's matches in the text."""
    out = None
    for name, pattern in patterns.items():
        x = texts.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), 1)).alias("place", "value")).select(key, F.lit(name).alias("claim"), "value", "place")
        out = x if out is None else out.unionByName(x)
    return out


def carry_subject(sentences: DataFrame, keys: Sequence[str], order: str, subject: Column) -> DataFrame:
    """sentences with the last subject named in the text so far."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return sentences.withColumn("subject", F.last(subject, ignorenulls=True).over(w))


def verify(made: DataFrame, facts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Claims with verdict: confirmed, contradicted, or unknown where there is no fact."""
    x = made.join(facts.select(*keys, F.col(value).alias("__fact")), list(keys), "left")
    return x.withColumn("verdict", F.when(F.col("__fact").isNull(), "unknown").when(F.col("__fact") == F.col(value), "confirmed").otherwise("contradicted")).drop("__fact")


def lint(texts: DataFrame, key: str, text: str, rules: Mapping[str, str]) -> DataFrame:
    """(key, rule, n): how often each rule's pattern occurs, where it does."""
    counts = F.array(*(F.struct(F.lit(r).alias("rule"), F.size(F.regexp_extract_all(F.col(text), F.lit(p), 0)).cast("long").alias("n")) for r, p in rules.items()))
    return texts.select(key, F.explode(counts).alias("x")).select(key, "x.*").where("n > 0")
