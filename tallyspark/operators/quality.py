"""Data quality: referential findings, integrity checks, homonym detectors and health counts. Findings are rows (rule, severity, key, detail)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import count_where


def finding(rows: DataFrame, rule: str, severity: str, key: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def findings(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str, rule: str, severity: str, detail: Column) -> DataFrame:
    """Rows whose key no parent has."""
    known = parents.select(F.col(parent_key).alias("__p")).distinct()
    return finding(rows.join(known, F.col(key) == F.col("__p"), "left_anti"), rule, severity, F.col(key), detail)


def childless(parents: DataFrame, rows: DataFrame, parent_key: str, key: str, rule: str, severity: str) -> DataFrame:
    """Parents without rows."""
    used = rows.select(F.col(key).alias("__k")).distinct()
    return finding(parents.join(used, F.col(parent_key) == F.col("__k"), "left_anti"), rule, severity, F.col(parent_key), F.lit("unused"))


def duplicates(rows: DataFrame, keys: Sequence[str], rule: str, severity: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return finding(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), rule, severity, F.concat_ws("/", *keys), F.col("n"))


def outside(rows: DataFrame, key: Column, bad: Column, rule: str, severity: str, detail: Column) -> DataFrame:
    return finding(rows.where(bad), rule, severity, key, detail)


def validate_entries(participants: DataFrame, entries: DataFrame, matches: DataFrame, results: DataFrame, slots: DataFrame, category: Sequence[str], pair_category: Column, singles_category: Column) -> DataFrame:
    """The nine rules on a category's documents.

    participants: category, id. entries: category, entry, ids (array). matches: category, match, entries (array). results: category,
    entry. slots: category, slot, grp, place and entry (null where the draw names a group place that nobody holds).
    """
    c = F.concat_ws("/", *category)
    key = F.concat_ws("#", c, F.col("entry").cast("string"))
    seats = entries.select(*category, "entry", F.explode("ids").alias("id"))
    known = entries.select(*category, "entry").distinct()
    used = matches.select(*category, "match", F.explode("entries").alias("entry"))
    return findings(
        [
            outside(entries.where(pair_category), key, F.size("ids") == 1, "pair-single-player", "error", F.size("ids")),
            duplicates(seats, [*category, "entry", "id"], "duplicate-player-id", "error"),
            outside(entries.where(singles_category), key, F.size("ids") > 1, "singles-multi-player", "error", F.size("ids")),
            finding(seats.join(participants.select(*category, "id").distinct(), [*category, "id"], "left_anti"), "unknown-participant", "error", key, F.col("id")),
            finding(participants.join(seats.select(*category, "id").distinct(), [*category, "id"], "left_anti"), "orphan-participant", "warning", F.concat_ws("#", c, "id"), F.lit("unused")),
            finding(used.join(known, [*category, "entry"], "left_anti"), "match-entry-not-found", "error", key, F.col("match")),
            finding(results.join(known, [*category, "entry"], "left_anti"), "result-entry-not-found", "error", key, F.lit("result")),
            finding(slots.groupBy(*category).agg(F.count("*").alias("n")).where(F.col("n").bitwiseAND(F.col("n") - 1) != 0), "knockout-draw-parity", "error", c, F.col("n")),
            finding(slots.where("grp is not null AND entry is null"), "knockout-draw-unresolved", "warning", F.concat_ws("#", c, F.col("slot").cast("string")), F.concat_ws("-", "grp", F.col("place").cast("string"))),
        ]
    )


def recomputed(detail: DataFrame, stored: DataFrame, keys: Sequence[str], value: Column, column: str, tolerance: float = 0.0) -> DataFrame:
    """Stored values that differ from the sum of their details: stored, computed."""
    sums = detail.groupBy(*keys).agg(F.sum(value).alias("computed"))
    x = stored.select(*keys, F.col(column).alias("stored")).join(sums, list(keys))
    return x.where(F.abs(F.col("stored") - F.col("computed")) > tolerance)


def stage_conflicts(rows: DataFrame, name: str, year: str, ordinal: str, gap: int = 2) -> DataFrame:
    """Names that appear in one year at life stages so far apart that they are different people."""
    return rows.groupBy(name, year).agg(F.min(ordinal).alias("low"), F.max(ordinal).alias("high")).where(F.col("high") - F.col("low") >= gap)


def empty_intersections(rows: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """Groups whose intervals have no point in common."""
    return rows.groupBy(*keys).agg(F.max(low).alias("latest_start"), F.min(high).alias("earliest_end")).where("latest_start > earliest_end")


def in_two_places(rows: DataFrame, keys: Sequence[str], place: str) -> DataFrame:
    """Groups with several values where one person can have one only."""
    return rows.groupBy(*keys).agg(F.count_distinct(place).alias("places")).where("places > 1")


def merge_candidates(rows: DataFrame, block: str, core: Column, name: str) -> DataFrame:
    """Different names of a block with an equal core."""
    return rows.groupBy(block, core.alias("core")).agg(F.array_sort(F.collect_set(name)).alias("names")).where(F.size("names") >= 2)


def health(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, n): how many rows meet each condition, in one pass."""
    counts = rows.agg(*(count_where(c).alias(n) for n, c in checks.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in checks))).alias("x")).select("x.*")
