"""Ranks, top lists and league tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from .aggregates import count_where


def competition_rank(rows: DataFrame, keys: Sequence[str], *best_first: Column, name: str = "rnk") -> DataFrame:
    """Equals share a rank and the next ones skip places (1, 1, 3)."""
    return rows.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(*best_first)))


def rank_of_rounded(rows: DataFrame, keys: Sequence[str], value: str, places: int = 1, name: str = "rnk") -> DataFrame:
    """Ranks by the half-up rounded value, so equals after rounding share a rank."""
    return rows.withColumn("__r", half_up(F.col(value), places)).withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("__r")))).drop("__r")


def top_k(rows: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group, with their place. Spark prunes before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def league_table(matches: DataFrame, league: Sequence[str], a: str, b: str, score_a: str, score_b: str, mini_difference: bool = False) -> DataFrame:
    """Standings: wins, then wins in matches among teams of equal wins, then difference, then points, then team.

    With mini_difference the difference in those matches comes before the whole one. The mini-league joins matches with both teams' wins,
    an equi-join by team, so no pairs of teams are made.
    """
    side = lambda x, y, p, q: F.struct(F.col(x).alias("team"), F.col(y).alias("other"), F.col(p).alias("own"), F.col(q).alias("against"))
    s = matches.select(*league, F.explode(F.array(side(a, b, score_a, score_b), side(b, a, score_b, score_a))).alias("s")).select(*league, "s.*")
    won = F.col("own") > F.col("against")
    totals = s.groupBy(*league, "team").agg(F.count("*").alias("played"), count_where(won).alias("won"), count_where(F.col("own") < F.col("against")).alias("lost"), F.sum("own").alias("points_won"), F.sum("against").alias("points_lost"))
    wins = totals.select(*league, "team", F.col("won").alias("__w"))
    both = s.join(wins, [*league, "team"]).join(wins.select(*league, F.col("team").alias("other"), F.col("__w").alias("__ow")), [*league, "other"]).where("__w = __ow")
    mini = both.groupBy(*league, "team").agg(count_where(won).alias("mini_won"), F.sum(F.col("own") - F.col("against")).alias("mini_difference"))
    out = totals.join(mini, [*league, "team"], "left").fillna(0, ["mini_won", "mini_difference"]).withColumn("difference", F.col("points_won") - F.col("points_lost"))
    order = [F.desc("won"), F.desc("mini_won"), *([F.desc("mini_difference")] if mini_difference else []), F.desc("difference"), F.desc("points_won"), F.asc("team")]
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*league).orderBy(*order)))


def season_points(entries: DataFrame, player: str, season: Sequence[str], score: Column, team: str | None = None, n: int = 3) -> DataFrame:
    """Leaderboards: the sum of each player's n best entries of a season, ranked by it, equals by their best single entry."""
    w = Window.partitionBy(player, *season).orderBy(F.desc("__score"))
    x = entries.select(player, *season, *([team] if team else []), score.alias("__score"))
    best = x.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).groupBy(player, *season).agg(half_up(F.sum("__score")).alias("points"), F.count("*").alias("counted"), F.max("__score").alias("best"))
    return competition_rank(best, season, F.desc("points"), F.desc("best"))
