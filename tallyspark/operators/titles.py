"""Titles and major results of persons, by an explicit list of tournaments.

entries: person, tournament, category, discipline, year, date, placement, and entry, which orders what is equal else
(then tournament and category do).
listed: tournament (unique), label, short, major (a group of tournaments, or null).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Placements that count as a major result, best first.
MAJOR_PLACEMENTS = ("winner", "runnerup", "best4", "best8")


def _of_list(entries: DataFrame, listed: DataFrame) -> DataFrame:
    return entries.select("person", "tournament", "category", "discipline", "year", "date", "placement", "entry").join(listed.select("tournament", "label", "short", "major"), "tournament")


def listed_titles(entries: DataFrame, listed: DataFrame) -> DataFrame:
    """The listed tournaments' titles, each with nth (of its person, tournament and category), defended (won the year before as well) and streak (years in a row up to it)."""
    key = ["person", "tournament", "category"]
    w = Window.partitionBy(*key)
    x = _of_list(entries, listed).where("placement = 'winner'")
    x = x.withColumn("nth", F.row_number().over(w.orderBy("year", "date", "entry"))).withColumn("defended", F.count("*").over(w.orderBy("year").rangeBetween(-1, -1)) > 0)
    x = x.withColumn("__first", F.col("year") - F.dense_rank().over(w.orderBy("year")))
    x = x.withColumn("streak", F.dense_rank().over(Window.partitionBy(*key, "__first").orderBy("year")))
    return x.drop("__first", "placement", "major")


def title_groups(titles: DataFrame) -> DataFrame:
    """Titles of a person by tournament, that with the latest title first: place, count, years (latest first), disciplines (by their latest title), badge."""
    latest = F.max(F.struct("year", "date", "entry")).alias("latest")
    each = titles.groupBy("person", "tournament", "label", "short", "discipline").agg(F.count("*").alias("n"), F.collect_set("year").alias("ys"), latest)
    named = F.collect_list(F.when(F.col("discipline").isNotNull() & (F.col("discipline") != ""), F.struct("latest", "discipline")))
    x = each.groupBy("person", "tournament", "label", "short").agg(
        F.sum("n").alias("count"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("ys"))), False).alias("years"),
        F.transform(F.sort_array(named, False), lambda d: d["discipline"]).alias("disciplines"),
        F.max("latest").alias("latest"),
    )
    badge = F.when(F.col("count") > 1, F.concat("short", F.lit(" winner "), F.col("count").cast("string"), F.lit(" times"))).otherwise(F.concat("short", F.lit(" winner")))
    w = Window.partitionBy("person").orderBy(F.desc("latest"), "tournament")
    return x.withColumn("badge", badge).withColumn("place", F.row_number().over(w)).drop("latest")


def major_results(entries: DataFrame, listed: DataFrame, order: Sequence[str]) -> DataFrame:
    """The last eight or better in tournaments of a major group, by group in the given order (others last, by name), best first and then latest first: group_place, place."""
    x = _of_list(entries, listed).where(F.col("major").isNotNull() & F.col("placement").isin(*MAJOR_PLACEMENTS))
    rank: Column = F.array_position(F.array(*map(F.lit, MAJOR_PLACEMENTS)), F.col("placement"))
    known = F.array_position(F.array(*map(F.lit, order)), F.col("major")) if order else F.lit(0)
    x = x.withColumn("rank", rank.cast("int")).withColumn("__known", F.when(known == 0, len(order) + 1).otherwise(known))
    best = Window.partitionBy("person", "major").orderBy("rank", F.desc("year"), F.desc_nulls_last("date"), "entry", "tournament", "category")
    groups = Window.partitionBy("person").orderBy("__known", "major")
    return x.withColumn("place", F.row_number().over(best)).withColumn("group_place", F.dense_rank().over(groups)).drop("__known", "placement").withColumn("placement", F.get(F.array(*map(F.lit, MAJOR_PLACEMENTS)), F.col("rank") - 1))


def firsts(entries: DataFrame, listed: DataFrame) -> DataFrame:
    """(person, event, tournament, label, category, year, date): the first entry in a listed tournament and the first title there; entries without a date come first."""
    x = _of_list(entries, listed)
    when = F.struct(F.coalesce(F.col("date"), F.to_date(F.lit("0001-01-01"))), "entry", "tournament", "category")
    row = F.struct("tournament", "label", "category", "year", "date")
    both = x.groupBy("person").agg(F.min_by(row, when).alias("first_listed"), F.min_by(row, F.when(F.col("placement") == "winner", when)).alias("first_listed_title"))
    events = F.array(*(F.struct(F.lit(e).alias("event"), F.col(e).alias("of")) for e in ("first_listed", "first_listed_title")))
    return both.select("person", F.explode(events).alias("x")).where("x.of is not null").select("person", "x.event", "x.of.*")
