"""Ordered sequences: islands, streaks, running state, neighbours and comparisons of periods.

Windows are partitioned by the sequence's keys (a player, a match, a user), whose rows Spark sorts with spilling. Order columns
must be total within a key, as Spark's sort isn't stable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import count_where


def _ordered(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def _so_far(keys: Sequence[str], order: Sequence[str]):
    return _ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def _before(keys: Sequence[str], order: Sequence[str]):
    return _ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)


def year_islands(rows: DataFrame, keys: Sequence[str], year: str, least: int = 2) -> DataFrame:
    """Runs of consecutive years: first_year, last_year and length, of those with `least` years."""
    own = rows.select(*keys, year).distinct()
    marked = own.withColumn("__island", F.col(year) - F.row_number().over(_ordered(keys, [year])))
    runs = marked.groupBy(*keys, "__island").agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count("*").alias("length"))
    return runs.where(F.col("length") >= least).drop("__island")


def streak_ending_at(rows: DataFrame, keys: Sequence[str], year: str, at: int, least: int = 1) -> DataFrame:
    """The run of years that ends at the given one."""
    return year_islands(rows.where(F.col(year) <= at), keys, year, least).where(F.col("last_year") == at)


def streak_stopped(rows: DataFrame, keys: Sequence[str], year: str, at: int, least: int = 3) -> DataFrame:
    """Runs of at least so many years that ended the year before, with nothing at the given one."""
    return year_islands(rows.where(F.col(year) <= at), keys, year, least).where(F.col("last_year") == at - 1)


def edition_runs(rows: DataFrame, keys: Sequence[str], edition: str, holder: str) -> DataFrame:
    """Longest run of each holder over adjacent editions in the list, whatever calendar years lie between; the first of equals."""
    w = _ordered(keys, [edition])
    x = rows.withColumn("__new", (~F.col(holder).eqNullSafe(F.lag(holder).over(w))).cast("int")).withColumn("__island", F.sum("__new").over(_so_far(keys, [edition])))
    runs = x.groupBy(*keys, holder, "__island").agg(F.count("*").alias("length"), F.min(edition).alias("first_edition"), F.max(edition).alias("last_edition"))
    best = runs.groupBy(*keys, holder).agg(F.max_by(F.struct("length", "first_edition", "last_edition"), F.struct("length", -F.col("first_edition"))).alias("b"))
    return best.select(*keys, holder, "b.*")


def result_streaks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], outcome: Column, target: str, skipped: Column, at: str) -> DataFrame:
    """The longest run of a target outcome: length and the `at` of its first and last row; the first of equals.

    Skipped rows neither count nor break; any other outcome breaks.
    """
    x = rows.select(*keys, *order, F.col(at).alias("__at"), outcome.alias("__r"), F.coalesce(skipped, F.lit(False)).alias("__skip")).where("NOT __skip")
    x = x.withColumn("__island", F.sum(F.when(F.col("__r").eqNullSafe(target), 0).otherwise(1)).over(_so_far(keys, order)))
    x = x.where(F.col("__r") == target)
    runs = x.groupBy(*keys, "__island").agg(F.count("*").alias("length"), F.min("__at").alias("first_at"), F.max("__at").alias("last_at"))
    return runs.groupBy(*keys).agg(F.max_by(F.struct("length", "first_at", "last_at"), F.struct("length", -F.col("__island"))).alias("b")).select(*keys, "b.*")


def segments(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Runs of an equal value: number from 1, the value, length, first and last `order[0]`."""
    w = _ordered(keys, order)
    x = rows.withColumn("__new", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    x = x.withColumn("segment", F.sum("__new").over(_so_far(keys, order)))
    return x.groupBy(*keys, "segment", value).agg(F.count("*").alias("length"), F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"))


def longest_segments(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Of each value its longest run, the first of equals."""
    runs = segments(rows, keys, order, value)
    return runs.groupBy(*keys, value).agg(F.max_by(F.struct("length", "first_at", "last_at"), F.struct("length", -F.col("segment"))).alias("b")).select(*keys, value, "b.*")


def running_score(rows: DataFrame, keys: Sequence[str], order: Sequence[str], winner: Column, sides: Sequence[str] = ("A", "B")) -> DataFrame:
    """rows with before_X and after_X for each side: what it has won in the sequence without and with the row."""
    out = rows.withColumn("__w", winner)
    for s in sides:
        hit = F.when(F.col("__w") == s, 1).otherwise(0)
        out = out.withColumn(f"before_{s}", F.coalesce(F.sum(hit).over(_before(keys, order)), F.lit(0))).withColumn(f"after_{s}", F.col(f"before_{s}") + hit)
    return out.drop("__w")


def lost_runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], won: Column, marks: Sequence[int] = (3, 4), pressure: int = 2) -> DataFrame:
    """Longest run of losses, how many runs reached each mark, and what became of the points after `pressure` losses or more.

    A null `won` neither counts nor ends a run.
    """
    x = rows.select(*keys, *order, won.alias("__won"))
    x = x.withColumn("__wins", F.sum(F.when(F.col("__won"), 1).otherwise(0)).over(_so_far(keys, order)))
    run = F.sum(F.when(~F.col("__won"), 1).otherwise(0)).over(_so_far([*keys, "__wins"], order))
    x = x.withColumn("__run", run)
    x = x.withColumn("__prior", F.coalesce(F.lag("__run").over(_ordered(keys, order)), F.lit(0)))
    lost = F.col("__won") == F.lit(False)
    return x.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(lost, F.col("__run"))), F.lit(0)).alias("longest_lost"),
        *(count_where(lost & (F.col("__run") == m)).alias(f"reached_{m}") for m in marks),
        count_where((F.col("__prior") >= pressure) & F.col("__won")).alias("recovered"),
        count_where(F.col("__prior") >= pressure).alias("under_pressure"),
    )


def lead_holds(rows: DataFrame, game: Sequence[str], order: Sequence[str], keys: Sequence[str], gained: Column, won_game: Column, lead: int = 2) -> DataFrame:
    """Of games in which the side once led by `lead`, how many it won. gained: 1, -1 or 0 a point; won_game: the same in all rows of a game."""
    x = rows.withColumn("__lead", F.sum(gained).over(_so_far(game, order))).withColumn("__won", won_game)
    games = x.groupBy(*game, *(k for k in keys if k not in game)).agg(F.max("__lead").alias("__top"), F.first("__won").alias("__won"))
    led = games.where(F.col("__top") >= lead)
    return led.groupBy(*keys).agg(count_where(F.col("__won")).alias("held"), F.count("*").alias("led"))


def comebacks(rows: DataFrame, game: Sequence[str], order: Sequence[str], gained: Column) -> DataFrame:
    """For each game the most that its eventual winner was behind. gained: 1 for side A, -1 for side B."""
    x = rows.withColumn("__diff", F.sum(gained).over(_so_far(game, order))).withColumn("__pos", F.row_number().over(_ordered(game, order)))
    out = x.groupBy(*game).agg(F.max_by("__diff", "__pos").alias("final"), F.min("__diff").alias("low"), F.max("__diff").alias("high"))
    return out.withColumn("deficit", F.when(F.col("final") > 0, F.greatest(-F.col("low"), F.lit(0))).when(F.col("final") < 0, F.greatest(F.col("high"), F.lit(0)))).drop("low", "high")


def neighbours(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """rows with their place from 1 and the columns of the rows before and after."""
    w = _ordered(keys, order)
    out = rows.withColumn("place", F.row_number().over(w))
    for c in columns:
        out = out.withColumn(f"{c}_before", F.lag(c).over(w)).withColumn(f"{c}_after", F.lead(c).over(w))
    return out


def extremes(rows: DataFrame, keys: Sequence[str], value: Column, max_ties: int = 3, largest: bool = True) -> DataFrame:
    """All rows that hold their group's extreme value, unless more than max_ties do: then it is no rarity and none is given.

    Extreme and tie counts are pre-aggregated; rows are joined with one row for each group, not ranked.
    """
    x = rows.withColumn("__v", value)
    ties = x.groupBy(*keys, "__v").agg(F.count("*").alias("ties"))
    pick = F.max if largest else F.min
    top = ties.groupBy(*keys).agg(pick(F.when(F.col("__v").isNotNull(), F.struct("__v", "ties"))).alias("t")).select(*keys, F.col("t.__v").alias("__v"), F.col("t.ties").alias("ties")).where(F.col("ties") <= max_ties)
    return x.join(top, [*keys, "__v"]).drop("__v")


def recent_against_previous(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], part: Column, whole: Column, sizes: Sequence[int] = (5, 3, 1)) -> DataFrame:
    """Sums over each key's latest N rows and the N before, N the largest size of which two fit. order: latest first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = rows.select(*keys, part.alias("__p"), whole.alias("__w"), F.row_number().over(w).alias("__n"))
    total = x.withColumn("__all", F.max("__n").over(Window.partitionBy(*keys)))
    n = F.when(F.col("__all") < 2 * min(sizes), None)
    for s in sorted(sizes, reverse=True):
        n = n.when(F.col("__all") >= 2 * s, s)
    x = total.withColumn("span", n).where(F.col("__n") <= 2 * F.col("span")).withColumn("__now", F.col("__n") <= F.col("span"))
    s = lambda c, now: F.sum(F.when(F.col("__now") == now, F.col(c)))
    return x.groupBy(*keys, "span").agg(s("__p", True).alias("recent_part"), s("__w", True).alias("recent_whole"), s("__p", False).alias("previous_part"), s("__w", False).alias("previous_whole"))


def latest_against_all(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column) -> DataFrame:
    """The latest value and the mean of all earlier ones; keys with one row have none of these."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = rows.select(*keys, value.alias("__v"), F.row_number().over(w).alias("__n"))
    return x.groupBy(*keys).agg(F.max(F.when(F.col("__n") == 1, F.col("__v"))).alias("latest"), F.avg(F.when(F.col("__n") > 1, F.col("__v"))).alias("earlier_mean"))


def nth_and_gap(rows: DataFrame, keys: Sequence[str], year: str, order: Sequence[str]) -> DataFrame:
    """rows with nth (1 for a key's first) and gap, the years since the one before."""
    w = _ordered(keys, order)
    return rows.withColumn("nth", F.row_number().over(w)).withColumn("gap", F.col(year) - F.lag(year).over(w))


def first_events(rows: DataFrame, keys: Sequence[str], order: Sequence[str], events: dict[str, Column], value: str) -> DataFrame:
    """For each named event the value of the first row in which it holds."""
    position = F.struct(*order)
    return rows.groupBy(*keys).agg(*(F.min_by(value, F.when(c, position)).alias(n) for n, c in events.items()))


def self_best(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows that beat everything before them, with that best; a key's first row doesn't count."""
    best = F.max(value).over(_before(keys, order))
    return rows.withColumn("best_before", best).where(F.col(value) > F.col("best_before"))


def change_points(rows: DataFrame, keys: Sequence[str], year: str, team: str) -> DataFrame:
    """Second and later teams of each key with the year of their first appearance."""
    spans = rows.where(F.col(team).isNotNull()).groupBy(*keys, team).agg(F.min(year).alias("from_year"), F.max(year).alias("to_year"))
    return spans.withColumn("place", F.row_number().over(_ordered(keys, ["from_year", team]))).where("place > 1")


def renumber(rows: DataFrame, keys: Sequence[str], order: Sequence[str], number: str) -> DataFrame:
    """Dense numbers from 1."""
    return rows.withColumn(number, F.row_number().over(_ordered(keys, order)))


def latest_value(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The value of each key's last row that has one."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias(value))


def percentile_floor(rows: DataFrame, keys: Sequence[str], value: str, share: float, least: int = 50, width: float = 1.0) -> DataFrame:
    """The value of the k-th best row, k = floor(n * share) counted from 0, of groups with at least `least` rows.

    Exact in two steps, so that no task sorts a whole group: counts by steps of `width` tell in which step the row lies, and only that step's
    values are ordered.
    """
    x = rows.where(F.col(value).isNotNull()).select(*keys, value, F.floor(F.col(value) / width).alias("__step"))
    w = Window.partitionBy(*keys)
    down = lambda c: w.orderBy(F.desc(c)).rowsBetween(Window.unboundedPreceding, 0)
    steps = x.groupBy(*keys, "__step").agg(F.count("*").alias("__c")).withColumn("__all", F.sum("__c").over(w)).withColumn("__end", F.sum("__c").over(down("__step")))
    k = F.floor(F.col("__all") * share)
    hit = steps.where((F.col("__all") >= least) & (F.col("__end") > k) & (F.col("__end") - F.col("__c") <= k)).select(*keys, "__step", (k - F.col("__end") + F.col("__c")).alias("__rest"))
    fine = x.join(hit, [*keys, "__step"]).groupBy(*keys, value, "__rest").agg(F.count("*").alias("__c")).withColumn("__end", F.sum("__c").over(down(value)))
    return fine.where(F.col("__end") > F.col("__rest")).groupBy(*keys).agg(F.max(value).alias("floor_value"))


def merge_intervals(rows: DataFrame, keys: Sequence[str], start: str, end: str, gap: float = 0) -> DataFrame:
    """Unions of intervals that overlap or lie at most `gap` apart: start, end and how many they hold."""
    w = _ordered(keys, [start, end])
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = rows.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)).withColumn("__run", F.sum("__new").over(_so_far(keys, [start, end])))
    return x.groupBy(*keys, "__run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__run")


def unique_slugs(rows: DataFrame, keys: Sequence[str], slug: Column, order: Sequence[str], name: str = "slug") -> DataFrame:
    """rows with a slug that is unique within keys: equal ones get -2, -3, ... in order."""
    x = rows.withColumn("__s", slug)
    n = F.row_number().over(_ordered([*keys, "__s"], order))
    return x.withColumn(name, F.when(n == 1, F.col("__s")).otherwise(F.concat_ws("-", "__s", n.cast("string")))).drop("__s")
