"""Queries of ordered sequences: events of a user are points (purchase and signup won, error lost), orders of a customer are a career."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequences as S
from ..sources.tables import table
from .registry import query
from .results import lines, orders

ORDER = ["ts", "event_id"]


def winner() -> Column:
    return F.when(F.col("event_type").isin("purchase", "signup"), "A").when(F.col("event_type") == "error", "B")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("day", F.to_date("ts")).withColumn("w", winner())


WINNER = "CASE WHEN event_type IN ('purchase', 'signup') THEN 'A' WHEN event_type = 'error' THEN 'B' END"
YEARS = "SELECT DISTINCT o_custkey, year(o_orderdate)::BIGINT AS yr FROM orders"
ISLANDS = "SELECT o_custkey, min(yr) AS first_year, max(yr) AS last_year, count(*) AS length FROM (SELECT *, yr - row_number() OVER (PARTITION BY o_custkey ORDER BY yr) AS g FROM y) GROUP BY o_custkey, g"


@query(f"WITH y AS ({YEARS}), i AS ({ISLANDS}) SELECT * FROM i WHERE length >= 2")
def year_streaks(spark, d):
    return S.year_islands(orders(spark, d), ["o_custkey"], "yr")


@query(f"WITH y AS ({YEARS} WHERE year(o_orderdate) <= 2000), i AS ({ISLANDS}) SELECT * FROM i WHERE last_year = 2000")
def streak_ending_at(spark, d):
    return S.streak_ending_at(orders(spark, d), ["o_custkey"], "yr", 2000)


@query(f"WITH y AS ({YEARS} WHERE year(o_orderdate) <= 1999), i AS ({ISLANDS}) SELECT * FROM i WHERE last_year = 1998 AND length >= 3")
def streak_stopped(spark, d):
    return S.streak_stopped(orders(spark, d), ["o_custkey"], "yr", 1999)


@query(
    """
WITH x AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS g FROM orders),
r AS (SELECT o_custkey, o_orderstatus, count(*) AS length, min(o_orderkey) AS first_edition, max(o_orderkey) AS last_edition FROM x GROUP BY o_custkey, o_orderstatus, g),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY length DESC, first_edition) AS k FROM r)
SELECT o_custkey, o_orderstatus, length, first_edition, last_edition FROM k WHERE k = 1
"""
)
def edition_runs(spark, d):
    return S.edition_runs(orders(spark, d), ["o_custkey"], "o_orderkey", "o_orderstatus")


@query(
    """
WITH x AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'win' WHEN event_type = 'error' THEN 'lose' ELSE 'draw' END AS r FROM events WHERE event_type <> 'view'),
g AS (SELECT *, sum(CASE WHEN r = 'win' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM x),
runs AS (SELECT user_id, island, count(*) AS length, min(ts) AS first_at, max(ts) AS last_at FROM g WHERE r = 'win' GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, island) AS k FROM runs)
SELECT user_id, length, first_at, last_at FROM k WHERE k = 1
"""
)
def win_streak_skip_break(spark, d):
    outcome = F.when(F.col("w") == "A", "win").when(F.col("w") == "B", "lose").otherwise("draw")
    return S.result_streaks(events(spark, d), ["user_id"], ORDER, outcome, "win", F.col("event_type") == "view", "ts")


@query(
    """
WITH n AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM n)
SELECT user_id, segment::BIGINT AS segment, event_type, count(*) AS length, min(ts) AS first_at, max(ts) AS last_at FROM s GROUP BY user_id, segment, event_type
"""
)
def momentum_segments(spark, d):
    return S.segments(events(spark, d), ["user_id"], ORDER, "event_type")


@query(
    """
WITH n AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM n),
r AS (SELECT user_id, event_type, segment, count(*) AS length, min(ts) AS first_at, max(ts) AS last_at FROM s GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY length DESC, segment) AS k FROM r)
SELECT user_id, event_type, length, first_at, last_at FROM k WHERE k = 1
"""
)
def longest_segments(spark, d):
    return S.longest_segments(events(spark, d), ["user_id"], ORDER, "event_type")


@query(
    f"""
WITH x AS (SELECT event_id, user_id, ts, {WINNER} AS w FROM events),
c AS (SELECT *, count(*) FILTER (WHERE w = 'A') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after_a, count(*) FILTER (WHERE w = 'B') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after_b FROM x)
SELECT event_id, user_id, after_a - CASE WHEN w = 'A' THEN 1 ELSE 0 END AS "before_A", after_a AS "after_A", after_b - CASE WHEN w = 'B' THEN 1 ELSE 0 END AS "before_B", after_b AS "after_B" FROM c
"""
)
def running_score(spark, d):
    return S.running_score(events(spark, d), ["user_id"], ORDER, F.col("w")).select("event_id", "user_id", "before_A", "after_A", "before_B", "after_B")


@query(
    f"""
WITH x AS (SELECT user_id, ts, event_id, {WINNER} AS w FROM events),
g AS (SELECT *, sum(CASE WHEN w = 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS wins FROM x),
r AS (SELECT *, sum(CASE WHEN w = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, wins ORDER BY ts, event_id) AS run FROM g),
p AS (SELECT *, coalesce(lag(run) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS prior FROM r)
SELECT user_id, coalesce(max(run) FILTER (WHERE w = 'B'), 0)::BIGINT AS longest_lost, count(*) FILTER (WHERE w = 'B' AND run = 3) AS reached_3, count(*) FILTER (WHERE w = 'B' AND run = 4) AS reached_4,
       count(*) FILTER (WHERE prior >= 2 AND w = 'A') AS recovered, count(*) FILTER (WHERE prior >= 2) AS under_pressure
FROM p GROUP BY user_id
"""
)
def lost_streak_stats(spark, d):
    return S.lost_runs(events(spark, d), ["user_id"], ORDER, F.col("w") == "A")


@query(
    f"""
WITH x AS (SELECT user_id, ts::DATE AS day, ts, event_id, {WINNER} AS w FROM events),
l AS (SELECT *, sum(CASE w WHEN 'A' THEN 1 WHEN 'B' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS lead FROM x),
g AS (SELECT user_id, day, max(lead) AS top, max_by(lead, (ts, event_id)) AS last FROM l GROUP BY 1, 2)
SELECT user_id, count(*) FILTER (WHERE last > 0) AS held, count(*) AS led FROM g WHERE top >= 2 GROUP BY 1
"""
)
def lead_holds(spark, d):
    from pyspark.sql import Window

    gained = F.when(F.col("w") == "A", 1).when(F.col("w") == "B", -1).otherwise(0)
    x = events(spark, d).withColumn("total", F.sum(gained).over(Window.partitionBy("user_id", "day")))
    return S.lead_holds(x, ["user_id", "day"], ORDER, ["user_id"], gained, F.col("total") > 0)


@query(
    f"""
WITH x AS (SELECT user_id, ts::DATE AS day, ts, event_id, {WINNER} AS w FROM events),
l AS (SELECT *, sum(CASE w WHEN 'A' THEN 1 WHEN 'B' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS lead FROM x),
g AS (SELECT user_id, day, min(lead)::BIGINT AS low, max(lead)::BIGINT AS high, max_by(lead, (ts, event_id))::BIGINT AS final FROM l GROUP BY 1, 2)
SELECT user_id, day, final, CASE WHEN final > 0 THEN greatest(-low, 0) WHEN final < 0 THEN greatest(high, 0) END AS deficit FROM g
"""
)
def comebacks(spark, d):
    gained = F.when(F.col("w") == "A", 1).when(F.col("w") == "B", -1).otherwise(0)
    return S.comebacks(events(spark, d), ["user_id", "day"], ORDER, gained)


@query(
    """
WITH r AS (SELECT event_id, event_type, ts::DATE AS day, floor(value) AS v FROM events),
k AS (SELECT *, rank() OVER (PARTITION BY event_type, day ORDER BY v DESC) AS k FROM r),
t AS (SELECT *, count(*) OVER (PARTITION BY event_type, day) AS ties FROM k WHERE k = 1)
SELECT event_id, event_type, day, v, ties FROM t WHERE ties <= 3
"""
)
def extreme_with_ties(spark, d):
    x = events(spark, d).select("event_id", "event_type", "day", F.floor("value").cast("double").alias("v"))
    return S.extremes(x, ["event_type", "day"], F.col("v"))


@query(
    """
WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY user_id) AS whole FROM events),
s AS (SELECT *, CASE WHEN whole >= 10 THEN 5 WHEN whole >= 6 THEN 3 WHEN whole >= 2 THEN 1 END AS span FROM n)
SELECT user_id, span, sum((event_type = 'purchase')::INT) FILTER (WHERE n <= span)::BIGINT AS recent_part, count(*) FILTER (WHERE n <= span) AS recent_whole,
       sum((event_type = 'purchase')::INT) FILTER (WHERE n > span)::BIGINT AS previous_part, count(*) FILTER (WHERE n > span) AS previous_whole
FROM s WHERE n <= 2 * span GROUP BY user_id, span
"""
)
def recent_vs_previous(spark, d):
    return S.recent_against_previous(events(spark, d), ["user_id"], [F.desc("ts"), F.desc("event_id")], (F.col("event_type") == "purchase").cast("long"), F.lit(1).cast("long"))


@query(
    """
WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, max(value) FILTER (WHERE n = 1) AS latest, round(avg(value) FILTER (WHERE n > 1), 6) AS earlier_mean FROM n GROUP BY 1
"""
)
def latest_vs_all(spark, d):
    x = S.latest_against_all(events(spark, d), ["user_id"], [F.desc("ts"), F.desc("event_id")], F.col("value"))
    return x.withColumn("earlier_mean", F.round("earlier_mean", 6))


@query(
    """
SELECT o_orderkey, o_custkey, year(o_orderdate)::BIGINT AS yr, row_number() OVER w AS nth, year(o_orderdate)::BIGINT - lag(year(o_orderdate)::BIGINT) OVER w AS gap
FROM orders WHERE o_orderstatus = 'F' WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
"""
)
def nth_and_gap(spark, d):
    x = S.nth_and_gap(orders(spark, d).where("o_orderstatus = 'F'"), ["o_custkey"], "yr", ["o_orderdate", "o_orderkey"])
    return x.select("o_orderkey", "o_custkey", "yr", F.col("nth").cast("long").alias("nth"), "gap")


@query(
    """
SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS debut, min_by(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus = 'F') AS first_win,
       min_by(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderpriority = '1-URGENT') AS first_urgent FROM orders GROUP BY 1
"""
)
def first_events(spark, d):
    return S.first_events(orders(spark, d), ["o_custkey"], ["o_orderdate", "o_orderkey"], {"debut": F.lit(True), "first_win": F.col("o_orderstatus") == "F", "first_urgent": F.col("o_orderpriority") == "1-URGENT"}, "o_orderkey")


@query(
    """
WITH b AS (SELECT o_orderkey, o_custkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM orders)
SELECT * FROM b WHERE o_totalprice > best_before
"""
)
def self_best(spark, d):
    return S.self_best(orders(spark, d).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").drop("o_orderdate")


@query(
    """
WITH s AS (SELECT l_partkey, l_suppkey, min(year(l_shipdate))::BIGINT AS from_year, max(year(l_shipdate))::BIGINT AS to_year FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY from_year, l_suppkey) AS place FROM s)
SELECT * FROM k WHERE place > 1
"""
)
def change_points(spark, d):
    return S.change_points(lines(spark, d), ["l_partkey"], "yr", "l_suppkey").withColumn("place", F.col("place").cast("long"))


@query(
    """
SELECT conv_id, turn, row_number() OVER w AS place, lag(role) OVER w AS role_before, lead(role) OVER w AS role_after
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
"""
)
def conversation_turn_lag(spark, d):
    x = S.neighbours(table(spark, d, "conversations"), ["conv_id"], ["turn", "role", "text"], ["role"])
    return x.select("conv_id", "turn", F.col("place").cast("long").alias("place"), "role_before", "role_after")


@query(
    """
WITH n AS (SELECT o_custkey % 20 AS grp, o_totalprice, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_totalprice DESC) - 1 AS k, count(*) OVER (PARTITION BY o_custkey % 20) AS n FROM orders)
SELECT grp, o_totalprice AS floor_value FROM n WHERE n >= 50 AND k = floor(n * 0.05)
"""
)
def percentile_floor(spark, d):
    return S.percentile_floor(orders(spark, d).withColumn("grp", F.col("o_custkey") % 20), ["grp"], "o_totalprice", 0.05, width=1000.0)


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS line FROM lineitem
"""
)
def renumber(spark, d):
    x = S.renumber(lines(spark, d), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "line")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", F.col("line").cast("long").alias("line"))


@query("SELECT o_custkey, max_by(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority FROM orders GROUP BY 1")
def latest_value(spark, d):
    return S.latest_value(orders(spark, d), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderpriority")
