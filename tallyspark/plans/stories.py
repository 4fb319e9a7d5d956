"""Queries of stories over knockout draws: customers in blocks of 64 numbers are the field of a cup, a year is an edition, and in each match the dearer order of the year wins.

The last year is being played: of a cup's rounds only the first 1 + cup % 6 are decided.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stories as S
from ..session import as_table
from ..sources.tables import table
from .registry import query
from .results import orders

YEAR, ROUNDS = 2001, 6


def knockout(spark, d):
    """(members, matches): members (cup, yr, entry, player, team), matches (cup, yr, round, winner, loser, final)."""
    o = orders(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left")
    best = o.groupBy(F.floor(F.col("o_custkey") / 64).alias("cup"), "yr", F.col("o_custkey").alias("entry")).agg(F.max("o_totalprice").alias("price"), F.min("c_nationkey").alias("team"))
    # Who sits where after each round: the strongest of the slots below.
    seats = best.select("cup", "yr", "entry", "price", F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))).alias("r"))
    sits = seats.withColumn("slot", F.expr("shiftright(entry % 64, r)")).groupBy("cup", "yr", "r", "slot").agg(F.max(F.struct("price", "entry")).alias("s"))
    met = sits.groupBy("cup", "yr", (F.col("r") + 1).cast("long").alias("round"), F.expr("shiftright(slot, 1)").alias("slot")).agg(F.max("s").alias("w"), F.min("s").alias("l"), F.count("*").alias("n")).where("n = 2")
    played = (F.col("yr") < YEAR) | (F.col("round") <= 1 + F.col("cup") % 6)
    matches = met.select("cup", "yr", "round", F.when(played, F.col("w.entry")).alias("winner"), F.col("l.entry").alias("loser"), F.lit(ROUNDS).alias("final"))
    # Tables, as every detector reads both.
    return as_table(best.select("cup", "yr", "entry", F.col("entry").alias("player"), "team"), "members"), as_table(matches, "matches")


def team_history(spark, d):
    """(cup, yr, name, score): nations of a cup by the sum of their orders: first, second, the next two, the next four."""
    o = orders(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    total = o.groupBy(F.floor(F.col("o_custkey") / 64).alias("cup"), "yr", F.col("c_nationkey").cast("string").alias("name")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    place = F.row_number().over(Window.partitionBy("cup", "yr").orderBy(F.desc("cents"), "name"))
    score = F.when(F.col("place") == 1, 100).when(F.col("place") == 2, 90).when(F.col("place") <= 4, 80).when(F.col("place") <= 8, 70)
    return total.withColumn("place", place).where("place <= 8").select("cup", "yr", "name", score.cast("long").alias("score"))


_DRAWS = f"""
WITH best AS MATERIALIZED (SELECT o_custkey // 64 AS cup, year(o_orderdate)::BIGINT AS yr, o_custkey AS entry, max(o_totalprice) AS price, min(c_nationkey) AS team FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
sits AS (SELECT cup, yr, r, (entry % 64) >> r AS slot, max((price, entry)) AS s FROM best, range(0, {ROUNDS}) t(r) GROUP BY 1, 2, 3, 4),
met AS (SELECT cup, yr, r + 1 AS round, slot >> 1 AS slot, max(s) AS w, min(s) AS l FROM sits GROUP BY 1, 2, 3, 4 HAVING count(*) = 2),
m AS MATERIALIZED (SELECT cup, yr, round, CASE WHEN yr < {YEAR} OR round <= 1 + cup % 6 THEN w[2] END AS winner, l[2] AS loser FROM met),
placed AS (SELECT cup, yr, entry, max(score) AS score FROM (
  SELECT cup, yr, loser AS entry, CASE {ROUNDS} - round WHEN 0 THEN 90 WHEN 1 THEN 80 WHEN 2 THEN 70 END AS score FROM m WHERE winner IS NOT NULL
  UNION ALL SELECT cup, yr, winner, 100 FROM m WHERE round = {ROUNDS} AND winner IS NOT NULL) WHERE score IS NOT NULL GROUP BY 1, 2, 3),
players AS MATERIALIZED (SELECT cup, yr, entry::VARCHAR AS name, score FROM placed),
teams AS MATERIALIZED (SELECT p.cup, p.yr, team::VARCHAR AS name, max(score) AS score FROM placed p JOIN best b ON b.cup = p.cup AND b.yr = p.yr AND b.entry = p.entry WHERE team IS NOT NULL GROUP BY 1, 2, 3)"""


@query(
    f"""{_DRAWS},
cur AS (SELECT * FROM m WHERE yr = {YEAR} AND winner IS NOT NULL),
ent AS (SELECT cup, entry, team::VARCHAR AS team FROM best WHERE yr = {YEAR}),
f0 AS (SELECT e.cup, e.entry, e.team, (SELECT max(round) FROM cur c WHERE c.cup = e.cup AND c.winner = e.entry) AS won_at, (SELECT max((round, winner)) FROM cur c WHERE c.cup = e.cup AND c.loser = e.entry) AS lost FROM ent e),
f AS MATERIALIZED (SELECT *, count(*) FILTER (WHERE lost IS NULL) OVER (PARTITION BY cup) AS remaining, CASE WHEN lost IS NOT NULL THEN 'out' WHEN won_at IS NOT NULL THEN 'alive' ELSE 'unknown' END AS state FROM f0 WHERE cup IN (SELECT cup FROM cur)),
g AS MATERIALIZED (SELECT *, CASE WHEN remaining <= 2 THEN 90 WHEN remaining <= 4 THEN 80 WHEN remaining <= 8 THEN 70 END AS sure FROM f),
last AS (SELECT cup, max(yr) AS last_year FROM best WHERE yr < {YEAR} GROUP BY 1),
runs AS (SELECT cup, name, count(*) AS run FROM (SELECT p.cup, name, last_year - yr AS back, row_number() OVER (PARTITION BY p.cup, name ORDER BY yr DESC) - 1 AS k FROM players p JOIN last l ON l.cup = p.cup WHERE yr < {YEAR}) WHERE back = k GROUP BY 1, 2),
pb AS (SELECT cup, name, max(score) AS best FROM players WHERE yr < {YEAR} GROUP BY 1, 2),
tb AS (SELECT cup, name, max(score) AS best, max(yr) FILTER (WHERE score = 100) AS title FROM teams WHERE yr < {YEAR} GROUP BY 1, 2),
wp AS (SELECT p.cup, name FROM players p JOIN last l ON l.cup = p.cup AND yr = last_year),
wt AS (SELECT t.cup, name FROM teams t JOIN last l ON l.cup = t.cup AND yr = last_year),
there AS (SELECT DISTINCT g.cup, team, sure, best, title FROM g JOIN tb ON tb.cup = g.cup AND tb.name = team WHERE state <> 'out' AND sure IS NOT NULL)
SELECT g.cup, 'watched-eliminated' AS kind, entry::VARCHAR AS subject, lost[1] AS round, coalesce(run, 0) AS value, NULL::BIGINT AS prior, lost[2] AS other FROM g JOIN wp ON wp.cup = g.cup AND wp.name = entry::VARCHAR LEFT JOIN runs r ON r.cup = g.cup AND r.name = wp.name WHERE state = 'out'
UNION ALL SELECT g.cup, 'watched-advancing', entry::VARCHAR, won_at, NULL, NULL, NULL FROM g JOIN wp ON wp.cup = g.cup AND wp.name = entry::VARCHAR WHERE state = 'alive'
UNION ALL SELECT g.cup, 'watched-self-best', entry::VARCHAR, won_at, sure, best, (sure = best)::INT FROM g JOIN wp ON wp.cup = g.cup AND wp.name = entry::VARCHAR JOIN pb ON pb.cup = g.cup AND pb.name = wp.name WHERE state = 'alive' AND sure >= best
UNION ALL SELECT cup, 'watched-title-watch', team, NULL, sure, title, {YEAR} - title FROM there WHERE title IS NOT NULL
UNION ALL SELECT cup, 'watched-school-peak', team, NULL, sure, best, (sure = best)::INT FROM there WHERE sure >= best
UNION ALL SELECT g.cup, 'watched-school-progress', team, NULL, count(*) FILTER (WHERE state = 'alive'), count(*) FILTER (WHERE state = 'out'), count(*) FILTER (WHERE state = 'unknown') FROM g JOIN wt ON wt.cup = g.cup AND wt.name = team GROUP BY 1, 3 HAVING count(*) FILTER (WHERE state <> 'unknown') > 0
"""
)
def stories_in_progress(spark, d):
    """Who of those watched is out, goes on or has matched their best while the last year's draws are being played."""
    members, matches = knockout(spark, d)
    placed = S.placings(matches, ["cup", "yr"])
    players, teams = (S.history_of(placed, members, ["cup", "yr"], n) for n in ("player", "team"))
    return S.in_progress(members, matches, players, teams, YEAR)


@query(
    f"""{_DRAWS},
y AS (SELECT cup, yr, name, 'p' AS k FROM players WHERE yr < {YEAR} UNION ALL SELECT cup, yr, name, 't' FROM teams WHERE yr < {YEAR}),
runs AS (SELECT k, cup, name, min(yr) AS first_year, max(yr) AS last_year, count(*) AS n FROM (SELECT *, yr - row_number() OVER (PARTITION BY k, cup, name ORDER BY yr) AS i FROM y) GROUP BY k, cup, name, i),
v AS (SELECT cup, yr, round, winner, least(winner, loser) AS a, greatest(winner, loser) AS b FROM m WHERE winner IS NOT NULL),
now AS (SELECT cup, a, b, min(round) AS round, min_by(winner, round) AS winner FROM v WHERE yr = {YEAR - 1} GROUP BY 1, 2, 3),
past AS (SELECT cup, a, b, max((yr, round, winner)) AS p FROM v WHERE yr < {YEAR - 1} GROUP BY 1, 2, 3)
SELECT cup, CASE k WHEN 'p' THEN 'best8-streak' ELSE 'school-best8-streak' END AS kind, name AS subject, NULL::BIGINT AS round, n AS value, first_year AS prior, NULL::BIGINT AS other FROM runs WHERE last_year = {YEAR - 1} AND n >= CASE k WHEN 'p' THEN 3 ELSE 4 END
UNION ALL SELECT n.cup, 'pair-rematch', n.a || ',' || n.b, n.round, p[1], p[2], (n.winner <> p[3])::INT FROM now n JOIN past x ON x.cup = n.cup AND x.a = n.a AND x.b = n.b
"""
)
def stories_finished(spark, d):
    """Runs of years among the last eight, of players and teams, and pairs that have met again."""
    members, matches = knockout(spark, d)
    placed = S.placings(matches, ["cup", "yr"])
    players, teams = (S.history_of(placed, members, ["cup", "yr"], n) for n in ("player", "team"))
    return S.finished(matches, players, teams, YEAR - 1)


@query(
    f"""{_DRAWS},
tot AS (SELECT o_custkey // 64 AS cup, year(o_orderdate)::BIGINT AS yr, c_nationkey::VARCHAR AS name, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
ev AS (SELECT cup, yr, name FROM tot QUALIFY row_number() OVER (PARTITION BY cup, yr ORDER BY cents DESC, name) <= 8),
both_ AS (SELECT DISTINCT e.cup, e.yr, e.name FROM ev e JOIN teams t ON t.cup = e.cup AND t.yr = e.yr AND t.name = e.name WHERE e.yr < {YEAR}),
runs AS (SELECT cup, name, min(yr) AS first_year, max(yr) AS last_year, count(*) AS n FROM (SELECT *, yr - row_number() OVER (PARTITION BY cup, name ORDER BY yr) AS i FROM both_) GROUP BY cup, name, i)
SELECT cup, 'school-both-events' AS kind, name AS subject, NULL::BIGINT AS round, n AS value, first_year AS prior, NULL::BIGINT AS other FROM runs WHERE last_year = {YEAR - 1} AND n >= 3
"""
)
def stories_both_events(spark, d):
    """Teams among the last eight of both the team event and the draw, three years in a row or more."""
    members, matches = knockout(spark, d)
    teams = S.history_of(S.placings(matches, ["cup", "yr"]), members, ["cup", "yr"], "team")
    return S.both_events(team_history(spark, d), teams, YEAR - 1)
