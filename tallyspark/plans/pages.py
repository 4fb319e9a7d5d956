"""Queries of what pages show."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import join_name, recover_team
from ..operators import pages as G
from ..sources.tables import table
from .registry import query
from .results import lines, orders
from .sequences import WINNER, events

YEARS = range(1995, 2002)


def _roster(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("team"), F.col("s_suppkey").alias("member"))


@query(
    """
WITH x AS (SELECT DISTINCT l_orderkey, l_returnflag, l_suppkey FROM lineitem)
SELECT s_nationkey AS team, count(DISTINCT l_orderkey) AS events, count(*) FILTER (WHERE l_returnflag = 'A') AS champions, count(*) FILTER (WHERE l_returnflag = 'R') AS runners_up, count(*) FILTER (WHERE l_returnflag IN ('A', 'R')) AS top8, count(*) AS entries FROM x JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1
"""
)
def team_summary(spark, d):
    x = lines(spark, d).groupBy("l_orderkey", "l_returnflag").agg(F.collect_list("l_suppkey").alias("players"))
    x = x.withColumn("result", F.when(F.col("l_returnflag") == "A", "winner").when(F.col("l_returnflag") == "R", "runnerup").otherwise("round"))
    return G.team_summary(x, _roster(spark, d), "l_orderkey", "players", "result", "team", "member")


@query("SELECT s_nationkey AS team, count(DISTINCT l_orderkey) AS matches FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def team_matches(spark, d):
    x = lines(spark, d).groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("players"))
    return G.team_matches(x, _roster(spark, d), "l_orderkey", "players", "team", "member")


_CELLS = ", ".join(f'min(champion) FILTER (WHERE yr = {y}) AS "{y}"' for y in YEARS)


@query(f"WITH c AS (SELECT o_orderpriority, year(o_orderdate)::BIGINT AS yr, max_by(o_custkey, (o_totalprice, o_custkey)) AS champion FROM orders GROUP BY 1, 2) SELECT o_orderpriority, {_CELLS} FROM c GROUP BY 1")
def champion_table(spark, d):
    c = orders(spark, d).groupBy("o_orderpriority", "yr").agg(F.max_by("o_custkey", F.struct("o_totalprice", "o_custkey")).alias("champion"))
    return G.champion_table(c, "o_orderpriority", "yr", "champion", YEARS)


@query(
    """
WITH e AS (SELECT o_custkey % 10 AS region, year(o_orderdate)::BIGINT AS yr, o_orderpriority AS tournament, -floor(o_totalprice / 50000)::BIGINT AS place, o_custkey AS team FROM orders),
r AS (SELECT *, rank() OVER (PARTITION BY region ORDER BY yr DESC, tournament, place) AS n FROM e)
SELECT DISTINCT region, yr, tournament, place, team FROM r WHERE n = 1
"""
)
def top_teams(spark, d):
    e = orders(spark, d).select((F.col("o_custkey") % 10).alias("region"), "yr", F.col("o_orderpriority").alias("tournament"), (-F.floor(F.col("o_totalprice") / 50000)).cast("long").alias("place"), F.col("o_custkey").alias("team"))
    return G.top_teams(e, ["region"], "yr", "tournament", "place", "team")


@query(
    f"""
WITH x AS (SELECT user_id, ts, event_id, {WINNER} AS w FROM events), y AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, w ORDER BY ts, event_id) AS island FROM x WHERE w IS NOT NULL),
r AS (SELECT user_id, w, island, count(*) AS length, min(event_id) AS some, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event FROM y GROUP BY 1, 2, 3)
SELECT user_id, w, length, first_event, last_event FROM r WHERE length = (SELECT max(length) FROM r)
"""
)
def point_streaks(spark, d):
    r = G.longest_runs_across(events(spark, d).select("user_id", "ts", "event_id", "w"), "user_id", ["ts", "event_id"], "w")
    return r.select("user_id", "w", "length", F.col("first.event_id").alias("first_event"), F.col("last.event_id").alias("last_event"))


@query("SELECT p_partkey // 500 AS page, p_partkey, p_name, CASE WHEN p_partkey % 9 > 0 THEN p_brand END AS p_brand FROM part")
def packed_pages(spark, d):
    """Packed and unpacked again; the packed form has its own tests."""
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 500).alias("page"), "p_partkey", "p_name", F.when(F.col("p_partkey") % 9 > 0, F.col("p_brand")).alias("p_brand"))
    return G.unpack_strings(G.pack_strings(p, ["page"], ["p_name", "p_brand"], ["p_partkey"]), ["page"], ["p_name", "p_brand"], ["p_partkey"])


@query(
    """
WITH s AS (SELECT l_orderkey, year(min(l_shipdate))::BIGINT AS yr, l_returnflag AS flag, list_sort(list(DISTINCT l_suppkey % 7)) AS m FROM lineitem GROUP BY l_orderkey, l_returnflag)
SELECT l_orderkey, yr FROM s WHERE flag = 'A' AND NOT EXISTS (SELECT 1 FROM s t WHERE t.flag = 'R' AND t.yr = s.yr AND t.m = s.m)
"""
)
def untold_stories(spark, d):
    s = lines(spark, d).groupBy("l_orderkey", F.col("l_returnflag").alias("flag")).agg(F.min("yr").alias("yr"), F.collect_list(F.col("l_suppkey") % 7).alias("members"))
    return G.without_told(s.where("flag = 'A'"), s.where("flag = 'R'"), "members", ["yr"]).select("l_orderkey", "yr")


@query(
    """
WITH m AS (SELECT p_brand, p_name AS stage, p_partkey, l_orderkey FROM part LEFT JOIN lineitem ON l_partkey = p_partkey),
c AS (SELECT p_brand FROM m WHERE l_orderkey IS NOT NULL GROUP BY p_brand, stage, l_orderkey HAVING count(DISTINCT p_partkey) > 1)
SELECT DISTINCT p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM c)
"""
)
def mergeable_brands(spark, d):
    p = table(spark, d, "part").select("p_brand", F.col("p_name").alias("stage"), "p_partkey")
    m = p.join(lines(spark, d).select("l_orderkey", "l_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return G.mergeable(m, "p_brand", "stage", "p_partkey", "l_orderkey")


@query("SELECT 'all' AS scope, event_type, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT month(ts)::VARCHAR, event_type, count(*) FROM events GROUP BY 1, 2")
def scope_pools(spark, d):
    return G.in_scopes(events(spark, d), F.month("ts")).groupBy("scope", "event_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'")
def published_insights(spark, d):
    o = orders(spark, d).select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "published").otherwise("draft").alias("state"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("verified_at"), F.array("o_orderpriority").alias("paragraphs"))
    return G.published(o).select("o_orderkey")


@query("SELECT user_id, event_id AS attempt, value AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS n FROM events) WHERE n = 1")
def best_attempts(spark, d):
    return G.best_attempt(events(spark, d).select("user_id", F.col("event_id").alias("attempt"), F.col("value").alias("score")), ["user_id"], "attempt", "score")


@query("SELECT s_suppkey, trim(s_name) || ' ' || trim(n_name) AS joined, replace(n_name, '_', ' ') AS team, CASE WHEN s_suppkey % 2 = 0 THEN trim(r_name) END AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def recovered_names(spark, d):
    """Names joined, and teams recovered from ids that were taken for them."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    regions = [r[0] for r in table(spark, d, "region").select("r_name").collect()]
    plain = F.replace("n_name", F.lit("_"), F.lit(" "))
    raw = F.concat(F.lit("__"), plain, F.lit("_"), plain, F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("_"), "r_name")).otherwise(""), F.lit("_"))
    got = recover_team(raw, {r: r[:2] for r in regions})
    return s.select("s_suppkey", join_name(F.col("s_name"), F.col("n_name")).alias("joined"), got["team"].alias("team"), got["region"].alias("region"))


@query(
    """
WITH m AS (SELECT least(l_suppkey % 40, l_partkey % 40) AS side_a, greatest(l_suppkey % 40, l_partkey % 40) AS side_b, year(l_shipdate)::BIGINT AS yr FROM lineitem WHERE l_linenumber >= 6)
SELECT side_a, side_b, count(*) AS times, min(yr) AS first_year FROM m WHERE side_a <> side_b GROUP BY 1, 2 HAVING count(*) >= 3 AND bool_or(yr = 2000)
"""
)
def recurring_matchups(spark, d):
    x = lines(spark, d).select((F.col("l_suppkey") % 40).alias("a"), (F.col("l_partkey") % 40).alias("b"), "yr", "l_linenumber")
    return G.recurring_matchups(x, "a", "b", "yr", F.col("l_linenumber") >= 6, 2000)


@query(
    """
WITH c AS (SELECT o_orderpriority AS cup, year(o_orderdate)::BIGINT AS yr, arg_max(o_custkey % 3, (o_totalprice, o_custkey)) AS champion FROM orders GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER x AS title_count, lag(yr) OVER x AS previous_year FROM c WHERE yr <= 2000 WINDOW x AS (PARTITION BY cup, champion ORDER BY yr))
SELECT cup, yr, champion, title_count, previous_year, row_number() OVER (PARTITION BY cup, champion, yr - title_count ORDER BY yr) AS in_a_row FROM t QUALIFY yr = 2000
"""
)
def title_stories(spark, d):
    c = orders(spark, d).groupBy(F.col("o_orderpriority").alias("cup"), "yr").agg(F.max_by(F.col("o_custkey") % 3, F.struct("o_totalprice", "o_custkey")).alias("champion"))
    return G.title_stories(c, ["cup"], "yr", "champion", 2000)
