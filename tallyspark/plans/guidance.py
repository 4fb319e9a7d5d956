"""Queries of hints, cards and points to review: a user's events are a match in games of six points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import guidance as U
from ..sources.tables import table
from .registry import query

_POINTS = """
WITH e AS (SELECT *, floor(value)::BIGINT AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
p AS (SELECT user_id AS match, n // 6 + 1 AS game, n % 6 + 1 AS point, CASE WHEN event_type IN ('purchase', 'signup') THEN 'A' WHEN event_type = 'error' THEN 'B' WHEN v % 7 = 0 THEN NULL WHEN v % 2 = 0 THEN 'A' ELSE 'B' END AS w,
  CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS serving, v % 12 + 1 AS rally, event_id % 3 = 0 AS fault, event_id % 15 = 0 AS df,
  CASE WHEN event_id % 15 = 0 THEN 'double_fault' ELSE ['net', 'out', 'smash_winner', 'net', 'service_ace'][v % 5 + 1] END AS result, CASE WHEN v % 3 = 0 THEN '1' ELSE '0' END AS seat FROM e),
b AS (SELECT *, count(*) FILTER (WHERE w = 'A') OVER q AS a_before, count(*) FILTER (WHERE w = 'B') OVER q AS b_before FROM p WINDOW q AS (PARTITION BY match, game ORDER BY point ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, coalesce(w = side, false) AS won, coalesce(w <> side, false) AS lost, serving = side AS serves, CASE WHEN df THEN 0 ELSE rally END AS r, result IN ('net', 'out', 'double_fault') AS err, side || '-' || seat AS loser,
  CASE WHEN side = 'A' THEN a_before ELSE b_before END AS own, CASE WHEN side = 'A' THEN b_before ELSE a_before END AS other FROM (SELECT *, unnest(['A', 'B']) AS side FROM b)),
i AS (SELECT match, w, game, point, row_number() OVER (PARTITION BY match ORDER BY game, point) - row_number() OVER (PARTITION BY match, w ORDER BY game, point) AS g FROM p),
k AS (SELECT match, CASE WHEN w = 'A' THEN 'B' ELSE 'A' END AS side, count(*) AS length, min((game, point)) AS first_at, max((game, point)) AS last_at FROM i WHERE w IS NOT NULL GROUP BY match, w, g QUALIFY row_number() OVER (PARTITION BY match, w ORDER BY count(*) DESC, min((game, point))) = 1),
c AS (SELECT match, side, unnest(['points', 'first_serve_in', 'first_serve_points', 'second_serve_points', 'receive_points', 'rally_short', 'rally_medium', 'rally_long', 'game_points', 'saved_game_points']) AS metric,
  unnest([count(*), count(*) FILTER (WHERE serves), count(*) FILTER (WHERE serves AND NOT fault), count(*) FILTER (WHERE serves AND fault), count(*) FILTER (WHERE NOT serves), count(*) FILTER (WHERE r BETWEEN 1 AND 4), count(*) FILTER (WHERE r BETWEEN 5 AND 8), count(*) FILTER (WHERE r >= 9),
    count(*) FILTER (WHERE own >= 3 AND own - other >= 1), count(*) FILTER (WHERE other >= 3 AND other - own >= 1)]) AS whole,
  unnest([count(*) FILTER (WHERE won), count(*) FILTER (WHERE serves AND NOT fault), count(*) FILTER (WHERE won AND serves AND NOT fault), count(*) FILTER (WHERE won AND serves AND fault), count(*) FILTER (WHERE won AND NOT serves), count(*) FILTER (WHERE won AND r BETWEEN 1 AND 4), count(*) FILTER (WHERE won AND r BETWEEN 5 AND 8), count(*) FILTER (WHERE won AND r >= 9),
    count(*) FILTER (WHERE won AND own >= 3 AND own - other >= 1), count(*) FILTER (WHERE won AND other >= 3 AND other - own >= 1)]) AS part,
  count(*) FILTER (WHERE serves AND df) AS dfs, count(*) AS n_all, count(*) FILTER (WHERE won) AS n_won, count(*) FILTER (WHERE serves AND NOT fault) AS n_in, count(*) FILTER (WHERE serves) AS n_served,
  count(*) FILTER (WHERE won AND result IN ('smash_winner', 'service_ace')) AS winners, count(*) FILTER (WHERE won AND err) AS gifts FROM s GROUP BY match, side),
r AS (SELECT *, part * 100.0::DOUBLE / nullif(whole, 0) AS value, n_won * 100.0::DOUBLE / n_all - part * 100.0::DOUBLE / nullif(whole, 0) AS fall FROM c)
"""

#: metric: limit, drop, sample, strong value, strong drop, base, cap
_RATES = """
t(metric, lim, dlim, smp, sval, sdrop, base, cap) AS (VALUES ('first_serve_in', 55, NULL, 5, 45, NULL, 48, 12), ('first_serve_points', 45, 12, 5, NULL, 12, 52, 12), ('second_serve_points', 40, NULL, 3, 30, NULL, 56, 0), ('receive_points', 40, 12, 5, NULL, 12, 44, 12),
  ('rally_short', 40, 12, 5, NULL, 12, 42, 10), ('rally_medium', 40, 12, 5, NULL, 12, 42, 10), ('rally_long', 40, 12, 5, NULL, 12, 42, 10), ('game_points', 40, 12, 3, NULL, 12, 50, 8), ('saved_game_points', 35, NULL, 3, 25, NULL, 45, 8)),
h1 AS (SELECT match, side, metric AS rule, NULL AS detail, part, whole, value, fall AS "drop", CASE WHEN metric = 'second_serve_points' THEN whole + dfs ELSE whole END AS sample, smp,
    coalesce(value < sval, false) OR coalesce(fall >= sdrop, false) OR (metric = 'second_serve_points' AND dfs >= 3) AS strong,
    base + greatest(CASE WHEN dlim IS NULL THEN lim - value ELSE fall END, 0) + CASE WHEN metric = 'second_serve_points' THEN 4 * dfs ELSE 0 END + least(whole, cap) AS priority
  FROM r JOIN t USING (metric) WHERE whole > 0 AND (value < lim OR coalesce(fall >= dlim, false) OR (metric = 'second_serve_points' AND dfs >= 2)) AND (metric <> 'first_serve_points' OR n_in * 100.0::DOUBLE / n_served >= 55)),
h2 AS (SELECT match, side, 'lost_streak', NULL, length, n, length::DOUBLE, NULL, length, 5, length >= 7, 54.0::DOUBLE + 3 * length FROM k JOIN (SELECT match, count(*) AS n FROM p GROUP BY 1) USING (match) WHERE length >= 5),
er AS (SELECT match, side, result, count(*) AS n, sum(count(*)) OVER (PARTITION BY match, side)::BIGINT AS whole, row_number() OVER (PARTITION BY match, side ORDER BY count(*) DESC, result) AS place FROM s WHERE lost AND err GROUP BY 1, 2, 3),
h3 AS (SELECT match, side, 'error_share', result, n, whole, n * 100.0::DOUBLE / whole AS v, NULL, n, 3, v >= 55, 40 + v * 0.5::DOUBLE + 3 * n FROM er WHERE place <= 2 AND n >= 3 AND n * 100.0::DOUBLE / whole >= 40),
pl AS (SELECT match, side, loser, count(*) AS n, sum(count(*)) OVER (PARTITION BY match, side)::BIGINT AS whole, row_number() OVER (PARTITION BY match, side ORDER BY count(*) DESC, loser) AS place FROM s WHERE lost AND err AND match % 4 <> 0 GROUP BY 1, 2, 3),
h4 AS (SELECT match, side, 'player_share', loser, n, whole, n * 100.0::DOUBLE / whole AS v, NULL, n, 3, v >= 70, 38 + v * 0.5::DOUBLE + 3 * n FROM pl WHERE place = 1 AND n >= 3 AND n * 100.0::DOUBLE / whole >= 60),
h AS (SELECT match, side, rule, detail, part, whole, value, "drop", CASE WHEN sample < smp THEN 'low' WHEN strong AND sample >= 2 * smp THEN 'high' ELSE 'medium' END AS confidence, round(priority, 6) AS priority FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3 UNION ALL SELECT * FROM h4)),
hints AS (SELECT *, row_number() OVER (PARTITION BY match, side ORDER BY priority DESC, rule, detail NULLS FIRST) AS place FROM h QUALIFY place <= 3)
"""


def _log(spark, d):
    """Points, games and players of the given events; the games' winners don't matter as no game decides a match."""
    v, e = F.floor("value").cast("long"), F.col("event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, d, "events").withColumn("v", v).withColumn("n", (F.row_number().over(w) - 1).cast("long"))
    won = F.when(e.isin("purchase", "signup"), "A").when(e == "error", "B").when(F.col("v") % 7 == 0, None).when(F.col("v") % 2 == 0, "A").otherwise("B")
    kinds = F.array(*map(F.lit, ("net", "out", "smash_winner", "net", "service_ace")))
    double = F.col("event_id") % 15 == 0
    points = x.select(
        F.col("user_id").alias("match"),
        (F.floor(F.col("n") / 6) + 1).alias("game"),
        (F.col("n") % 6 + 1).alias("point"),
        won.alias("winner"),
        F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("serving"),
        (F.col("v") % 12 + 1).cast("int").alias("rally"),
        (F.col("event_id") % 3 == 0).alias("first_serve_fault"),
        double.alias("double_fault"),
        F.when(double, "double_fault").otherwise(F.get(kinds, (F.col("v") % 5).cast("int"))).alias("result"),
        F.concat(F.when(won == "A", "B").when(won == "B", "A"), F.when(F.col("v") % 3 == 0, "-1").otherwise("-0")).alias("loser_player"),
    )
    games = points.groupBy("match", "game").agg(F.max("winner").alias("winner")).withColumn("best_of", F.lit(2_000_001))
    seats = F.when(F.col("match") % 4 == 0, F.array(F.lit("-0"))).otherwise(F.array(F.lit("-0"), F.lit("-1")))
    players = points.select("match").distinct().select("match", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("side"), seats.alias("s")).select("match", "side", F.explode("s").alias("s"))
    return points, games, players.select("match", "side", F.concat("side", "s").alias("player"))


def _facts(spark, d):
    points, games, players = _log(spark, d)
    sides, streaks = U.sides_of(points, games), U.lost_streaks(points)
    return sides, streaks, U.side_facts(sides, streaks, players)


@query(_POINTS + "," + _RATES + 'SELECT match, side, rule, detail, part, whole, round(value, 6) AS value, round("drop", 6) AS "drop", confidence, priority, place FROM hints')
def improvement_hints(spark, d):
    """The three most urgent of the twelve kinds of hints for each side of each match."""
    x = U.improvement_hints(_facts(spark, d)[2])
    return x.withColumn("value", F.round("value", 6)).withColumn("drop", F.round("drop", 6))


@query(
    _POINTS
    + """,
m AS (SELECT match, side, max(CASE metric WHEN 'first_serve_points' THEN part END) AS fp, max(CASE metric WHEN 'first_serve_points' THEN whole END) AS fw, max(CASE metric WHEN 'game_points' THEN part END) AS gp, max(CASE metric WHEN 'game_points' THEN whole END) AS gw,
  max(CASE metric WHEN 'rally_short' THEN part END) AS sp, max(CASE metric WHEN 'rally_short' THEN whole END) AS sw, max(CASE metric WHEN 'rally_long' THEN part END) AS lp, max(CASE metric WHEN 'rally_long' THEN whole END) AS lw, max(winners) AS wi, max(gifts) AS gi, max(n_all) AS n, coalesce(max(length), 0) AS st
  FROM r LEFT JOIN k USING (match, side) GROUP BY 1, 2),
f AS (SELECT *, fp * 100.0::DOUBLE / nullif(fw, 0) AS fv, gp * 100.0::DOUBLE / nullif(gw, 0) AS gv, sp * 100.0::DOUBLE / nullif(sw, 0) - lp * 100.0::DOUBLE / nullif(lw, 0) AS sv FROM m)
SELECT match, side, 'service' AS card, CASE WHEN fw = 0 THEN 'none' WHEN fw < 5 THEN 'low' ELSE 'ok' END AS reliability, fp AS part, fw AS whole, NULL::BIGINT AS other_part, NULL::BIGINT AS other_whole, CASE WHEN fw < 5 THEN NULL WHEN fv >= 60 THEN 'wins points' WHEN fv < 45 THEN 'look at what follows' ELSE 'look at the start' END AS verdict FROM f
UNION ALL SELECT match, side, 'key_moments', CASE WHEN gw = 0 THEN 'none' WHEN gw < 3 THEN 'low' ELSE 'ok' END, gp, gw, NULL, NULL, CASE WHEN gw < 3 THEN NULL WHEN gv >= 50 THEN 'takes them' ELSE 'look at them' END FROM f
UNION ALL SELECT match, side, 'momentum', 'ok', st, n, NULL, NULL, CASE WHEN st >= 5 THEN 'long streak lost' ELSE 'look at pauses' END FROM f
UNION ALL SELECT match, side, 'rallies', CASE WHEN sw + lw = 0 THEN 'none' WHEN least(sw, lw) < 5 THEN 'low' ELSE 'ok' END, sp, sw, lp, lw, CASE WHEN least(sw, lw) < 5 THEN NULL WHEN sv >= 10 THEN 'short ones' WHEN sv <= -10 THEN 'long ones' ELSE 'alike' END FROM f
UNION ALL SELECT match, side, 'endings', 'ok', wi, n, gi, n, CASE WHEN wi - gi >= 3 THEN 'own winners' WHEN wi - gi <= -3 THEN 'errors of the other' ELSE 'alike' END FROM f
"""
)
def guide_cards(spark, d):
    """Five summaries for each side of each match."""
    return U.guide_cards(_facts(spark, d)[2])


@query(
    _POINTS
    + ","
    + _RATES
    + """,
nx AS (SELECT s.*, first_at IS NOT NULL AND (game, point) BETWEEN first_at AND last_at AS inside FROM s LEFT JOIN k USING (match, side)),
y AS (SELECT *, own >= 3 AND own - other >= 1 AS gp, lost AND err AS missed, serves AND fault AND lost AS faulted, lead(lost AND err) OVER q AS n_missed, lead(result) OVER q AS n_result, lead(loser) OVER q AS n_loser, lead(own >= 3 AND own - other >= 1) OVER q AS n_gp, lag(lost AND own >= 3 AND own - other >= 1) OVER q AS l_gp_lost,
  lead(inside) OVER q AS n_in, lag(inside) OVER q AS l_in FROM nx WINDOW q AS (PARTITION BY match, side ORDER BY game, point)),
z AS (SELECT match, side, game, point, rule, detail, unnest(CASE rule
  WHEN 'first_serve_in' THEN [CASE WHEN serves AND fault THEN 'faults' END, CASE WHEN faulted THEN 'lost on second serve' END]
  WHEN 'first_serve_points' THEN [CASE WHEN serves AND NOT fault AND lost THEN 'lost on first serve' END, CASE WHEN lost AND r BETWEEN 1 AND 4 THEN 'short rallies lost' END, CASE WHEN lost AND result IN ('smash_winner', 'service_ace') THEN 'ended by the other' END]
  WHEN 'second_serve_points' THEN [CASE WHEN faulted THEN 'lost on second serve' END, CASE WHEN serves AND df THEN 'double faults' END, CASE WHEN faulted AND r BETWEEN 1 AND 4 THEN 'short rallies lost' END]
  WHEN 'receive_points' THEN [CASE WHEN NOT serves AND lost AND rally = 3 THEN 'lost at the third stroke' END, CASE WHEN NOT serves AND lost AND fault THEN 'lost to second serves' END, CASE WHEN NOT serves AND lost AND r BETWEEN 1 AND 4 THEN 'short rallies lost' END]
  WHEN 'rally_short' THEN [CASE WHEN lost AND r BETWEEN 1 AND 4 THEN 'lost' END, CASE WHEN missed AND r BETWEEN 1 AND 4 THEN 'lost by error' END]
  WHEN 'rally_medium' THEN [CASE WHEN lost AND r BETWEEN 5 AND 8 THEN 'lost' END, CASE WHEN missed AND r BETWEEN 5 AND 8 THEN 'lost by error' END]
  WHEN 'rally_long' THEN [CASE WHEN lost AND r >= 9 THEN 'lost' END]
  WHEN 'game_points' THEN [CASE WHEN gp THEN 'game points' END, CASE WHEN n_gp THEN 'before a game point' END, CASE WHEN l_gp_lost THEN 'after one was lost' END]
  WHEN 'saved_game_points' THEN [CASE WHEN other >= 3 AND other - own >= 1 THEN 'game points of the other' END, CASE WHEN other >= 3 AND other - own >= 1 AND lost THEN 'lost' END]
  WHEN 'lost_streak' THEN [CASE WHEN NOT inside AND n_in THEN 'before' END, CASE WHEN inside THEN 'in it' END, CASE WHEN NOT inside AND l_in THEN 'after' END]
  WHEN 'error_share' THEN [CASE WHEN n_missed AND n_result = detail THEN 'before' END, CASE WHEN missed AND serves AND result = detail THEN 'serving' END, CASE WHEN missed AND NOT serves AND result = detail THEN 'receiving' END, CASE WHEN missed AND inside AND result = detail THEN 'in the streak' END]
  ELSE [CASE WHEN n_missed AND n_loser = detail THEN 'before' END, CASE WHEN missed AND loser = detail THEN 'ended' END] END) AS review FROM y JOIN hints USING (match, side))
SELECT match, side, rule, detail, review, game, point FROM z WHERE review IS NOT NULL
"""
)
def review_points(spark, d):
    """The points behind each side's hints, by group."""
    sides, streaks, facts = _facts(spark, d)
    return U.review_points(sides, streaks, U.improvement_hints(facts))
