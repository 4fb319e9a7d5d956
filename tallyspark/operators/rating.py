"""Ratings over a whole history of matches, in rating periods.

Ratings depend on all matches before, of any player, so no grouping by player can compute them. Here time is cut into periods: all
matches of a period use the ratings at its start, and a player's changes within it add up. If no player plays twice in a
period, that is exactly the sequential rating. A period is one set of joins over its own matches and the players; the state is a table
in the shared folder, so lineage doesn't grow with the number of periods, and no task sees more than its share of the matches.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import expected_score
from ..session import as_table
from .sequences import percentile_floor

# K by tier.
K_BY_TIER = {"major": 40.0, "national": 32.0, "local": 24.0}


def period_ratings(matches: DataFrame, k: Mapping[str, float] = K_BY_TIER, initial: float = 1500.0, scale: float = 400.0, established: int = 10, upset_chance: float = 0.15, top_share: float = 0.05, least_pool: int = 50, places: int = 9) -> tuple[DataFrame, DataFrame]:
    """(ratings, upsets).

    matches: period, match, side_a and side_b (arrays of players), a_won (boolean), tier. A side's rating is its players' mean.
    ratings: player, rating, played, won. upsets: matches whose winner had at most upset_chance by ratings before the period, all of whose
    players were established, and whose loser was at or above the rating that the top share of established players has.
    """
    spark = matches.sparkSession
    m = as_table(matches.select("period", "match", "side_a", "side_b", "a_won", "tier"), "matches")
    state = spark.createDataFrame([], "player string, rating double, played long, won long")
    upsets: list[DataFrame] = []
    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for pair in k.items() for v in pair)), F.col("tier")), F.lit(k.get("national", 32.0)))
    # Periods are few (weeks or days of the history), whatever the number of matches.
    for (period,) in m.select("period").distinct().orderBy("period").collect():
        own = m.where(F.col("period") == period)
        seats = own.select("match", "tier", "a_won", F.explode(F.concat(F.transform("side_a", lambda p: F.struct(p.alias("player"), F.lit(True).alias("a"))), F.transform("side_b", lambda p: F.struct(p.alias("player"), F.lit(False).alias("a"))))).alias("s")).select("match", "tier", "a_won", "s.player", "s.a")
        seats = seats.join(state, "player", "left").withColumn("rating", F.coalesce("rating", F.lit(initial))).fillna(0, ["played", "won"])
        mean = lambda a: F.avg(F.when(F.col("a") == a, F.col("rating")))
        sides = seats.groupBy("match", "tier", "a_won").agg(mean(True).alias("ra"), mean(False).alias("rb"), F.min("played").alias("least_played"))
        sides = as_table(sides.withColumn("chance_a", expected_score(F.col("ra"), F.col("rb"), scale)), "sides")
        floor = percentile_floor(state.where(F.col("played") >= established).withColumn("__one", F.lit(1)), ["__one"], "rating", top_share, least_pool)
        winner_chance = F.when(F.col("a_won"), F.col("chance_a")).otherwise(1 - F.col("chance_a"))
        loser = F.when(F.col("a_won"), F.col("rb")).otherwise(F.col("ra"))
        # One number; none while too few are established.
        bar = floor.first()
        rare = sides.where((winner_chance <= upset_chance) & (F.col("least_played") >= established))
        upsets.append(rare.where(loser >= F.lit(bar["floor_value"] if bar else None).cast("double")).select(F.lit(period).alias("period"), "match", F.round(winner_chance, 3).alias("chance"), F.round(F.abs(F.col("ra") - F.col("rb"))).cast("long").alias("rating_gap")))
        change = weight * (F.when(F.col("a_won"), 1.0).otherwise(0.0) - F.col("chance_a"))
        seat = seats.select("match", "player", "a").join(sides.select("match", "a_won", change.alias("change")), "match")
        moved = seat.groupBy("player").agg(F.sum(F.when(F.col("a"), F.col("change")).otherwise(-F.col("change"))).alias("change"), F.count("*").alias("n"), F.sum((F.col("a") == F.col("a_won")).cast("long")).alias("w"))
        joined = state.join(moved, "player", "full_outer")
        state = as_table(joined.select("player", F.round(F.coalesce("rating", F.lit(initial)) + F.coalesce("change", F.lit(0.0)), places).alias("rating"), (F.coalesce("played", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("played"), (F.coalesce("won", F.lit(0)) + F.coalesce("w", F.lit(0))).cast("long").alias("won")), "ratings")
    none = spark.createDataFrame([], "period long, match long, chance double, rating_gap long")
    return state, reduce(DataFrame.unionByName, upsets) if upsets else none
