"""Queries of history: suppliers and customers as entities over seasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import first_match
from ..operators import history as H
from ..sources.tables import table
from .registry import query
from .results import lines, orders
from .sequences import events


@query(
    """
WITH e AS (SELECT DISTINCT o_custkey % 20 AS cup, year(o_orderdate)::BIGINT AS yr FROM orders),
w AS (SELECT o_custkey % 20 AS cup, year(o_orderdate)::BIGINT AS yr, min(o_custkey) AS champion FROM orders WHERE o_totalprice > 400000 GROUP BY 1, 2),
c AS (SELECT e.cup, e.yr, champion FROM e LEFT JOIN w ON w.cup = e.cup AND w.yr = e.yr)
SELECT *, lag(champion) OVER x AS before, lag(yr) OVER x AS year_before, champion = lag(champion) OVER x AS defended FROM c WINDOW x AS (PARTITION BY cup ORDER BY yr)
"""
)
def title_defence(spark, d):
    o = orders(spark, d).withColumn("cup", F.col("o_custkey") % 20)
    return H.title_defence(H.champions(o, o, ["cup"], "yr", F.col("o_totalprice") > 400000, "o_custkey"), ["cup"], "yr")


@query(
    """
WITH b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_shipdate < '1998-01-01'),
n AS (SELECT l_partkey, min(l_orderkey % 9) AS e FROM lineitem WHERE l_shipdate >= '2001-07-01' GROUP BY 1),
x AS (SELECT l_orderkey, count(*) AS members, count(e) AS present, count(DISTINCT e) AS entries FROM b LEFT JOIN n ON n.l_partkey = b.l_partkey GROUP BY 1)
SELECT *, CASE WHEN present = 0 THEN 'absent' WHEN entries >= 2 THEN 'split' WHEN present = members THEN 'intact' ELSE 'partial' END AS fate FROM x
"""
)
def pair_fates(spark, d):
    x = lines(spark, d)
    field = x.where("l_shipdate >= '2001-07-01'").select("l_partkey", (F.col("l_orderkey") % 9).alias("entry"))
    return H.pair_fates(x.where("l_shipdate < '1998-01-01'"), field, ["l_orderkey"], "l_partkey", "entry")


@query(
    """
WITH p AS (SELECT o_custkey, max((floor(o_totalprice), o_orderdate)) AS b FROM orders WHERE o_orderdate >= '1999-01-01' AND o_orderdate < '2000-01-01' GROUP BY 1),
f AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderdate >= '2000-01-01' AND o_orderdate < '2000-07-01'),
x AS (SELECT f.o_custkey, f.o_orderpriority, b[1]::BIGINT AS score, b[2] AS o_orderdate FROM f JOIN p ON p.o_custkey = f.o_custkey WHERE f.o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY score DESC, o_orderdate DESC, o_custkey) AS place FROM x) SELECT * FROM k WHERE place <= 8
"""
)
def recent_achievers(spark, d):
    o = orders(spark, d)
    shown = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    x = H.achievers(o.where("yr = 1999"), o.where("o_orderdate >= '2000-01-01' AND o_orderdate < '2000-07-01'"), shown, "o_custkey", F.floor("o_totalprice"), "o_orderdate", 8, ["o_orderpriority"])
    return x.withColumn("place", F.col("place").cast("long"))


@query(
    """
WITH j AS (SELECT l_partkey, max(year(l_shipdate))::BIGINT AS last_junior, max_by(l_suppkey, (year(l_shipdate), l_suppkey)) AS junior_team FROM lineitem WHERE l_returnflag = 'A' AND l_shipdate < '1998-01-01' GROUP BY 1),
s AS (SELECT l_partkey, min(year(l_shipdate))::BIGINT AS first_senior, min_by(l_suppkey, (year(l_shipdate), l_suppkey)) AS senior_team FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT j.l_partkey, last_junior, junior_team, first_senior, senior_team FROM j JOIN s ON s.l_partkey = j.l_partkey WHERE first_senior - last_junior BETWEEN 1 AND 5 AND j.l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 7)
"""
)
def pathways(spark, d):
    x = lines(spark, d)
    homonyms = table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return H.pathways(x.where("l_returnflag = 'A' AND l_shipdate < '1998-01-01'"), x.where("l_returnflag = 'R'"), "l_partkey", "yr", "l_suppkey", homonyms)


@query(
    """
WITH s AS (SELECT l_partkey, l_suppkey, year(l_shipdate)::BIGINT AS yr FROM lineitem WHERE l_shipdate < '1997-01-01'), l AS (SELECT l_partkey, max(yr) AS last_year FROM s GROUP BY 1),
a AS (SELECT x.l_partkey, year(l_shipdate)::BIGINT AS yr, l_suppkey, l_quantity::BIGINT AS score FROM lineitem x JOIN l ON l.l_partkey = x.l_partkey AND year(l_shipdate) > last_year WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.l_partkey = x.l_partkey AND s.l_suppkey = x.l_suppkey))
SELECT l_partkey, max_by(score, (score, yr, l_suppkey)) AS score, max_by(yr, (score, yr, l_suppkey)) AS yr, max_by(l_suppkey, (yr, l_suppkey)) AS current_team FROM a GROUP BY 1
"""
)
def alumni(spark, d):
    x = lines(spark, d).withColumn("score", F.col("l_quantity").cast("long"))
    return H.alumni(x.where("l_shipdate < '1997-01-01'"), x, "l_partkey", "yr", "l_suppkey", "score")


@query(
    """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'ongoing' WHEN l_returnflag = 'A' THEN 'round' ELSE 'winner' END AS kind, l_linenumber AS rnd FROM lineitem),
a AS (SELECT *, sum((kind = 'ongoing')::INT) OVER (PARTITION BY l_orderkey)::BIGINT AS alive FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, alive, CASE WHEN kind <> 'ongoing' THEN kind WHEN alive = 4 THEN 'best4' WHEN alive = 8 THEN 'best8' ELSE 'round' END AS final_kind, CASE WHEN kind = 'ongoing' AND alive NOT IN (4, 8) THEN rnd END AS final_round FROM a
"""
)
def abandoned_standings(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "ongoing").when(F.col("l_returnflag") == "A", "round").otherwise("winner")
    x = lines(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", kind.alias("kind"))
    return H.abandoned(x, ["l_orderkey"], "kind", F.col("l_linenumber")).drop("kind")


@query(
    """
WITH m AS (SELECT l_suppkey, year(l_shipdate)::BIGINT AS yr, max((l_linenumber, l_returnflag = 'A')) AS m FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, yr, m[1] AS deepest, m[2] AS won_it FROM m
"""
)
def deepest_standing(spark, d):
    return H.deepest_standing(lines(spark, d), ["l_suppkey", "yr"], F.col("l_linenumber"), F.col("l_returnflag") == "A")


@query(
    """
WITH t AS (SELECT p_brand, max(p_size) AS top FROM part GROUP BY 1), x AS (SELECT p.p_brand, p_partkey, p_size FROM part p JOIN t ON t.p_brand = p.p_brand AND p_size = top)
SELECT *, count(*) OVER (PARTITION BY p_brand) AS leaders FROM x QUALIFY count(*) OVER (PARTITION BY p_brand) <= 3
"""
)
def placements_in_progress(spark, d):
    return H.placements_in_progress(table(spark, d, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size", 3)


@query(
    """
WITH x AS (SELECT l_partkey, l_suppkey, CASE WHEN l_linenumber < 4 THEN l_returnflag END AS place FROM lineitem),
n AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM x GROUP BY 1, 2), a AS (SELECT l_partkey, min_by(l_suppkey, (-n, l_suppkey)) AS l_suppkey, sum(n)::BIGINT AS rows FROM n GROUP BY 1),
p AS (SELECT l_partkey, place, count(*) AS n FROM x WHERE place IS NOT NULL GROUP BY 1, 2), b AS (SELECT l_partkey, min_by(place, (-n, place)) AS place, max(n) AS top, sum(n) AS known FROM p GROUP BY 1)
SELECT a.l_partkey, l_suppkey, rows, CASE WHEN known >= 0.4 * rows AND top >= 0.5 * known THEN place END AS place FROM a LEFT JOIN b ON a.l_partkey = b.l_partkey
"""
)
def team_master(spark, d):
    x = lines(spark, d).withColumn("place", F.when(F.col("l_linenumber") < 4, F.col("l_returnflag")))
    return H.majority_name(x, ["l_partkey"], "l_suppkey", "place")


@query(
    """
SELECT user_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS event_type_set, max(ts) AS last_day FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY 1 HAVING max(value) > 400) GROUP BY 1
"""
)
def growth_targets(spark, d):
    e = events(spark, d)
    loud = e.groupBy("user_id").agg(F.max("value").alias("m")).where("m > 400")
    return H.targets(e, "user_id", ["event_type"], "ts", loud).withColumn("event_type_set", F.array_join("event_type_set", ","))


@query(
    """
SELECT l_suppkey, NULL::BIGINT AS yr, count(*) AS n, 'l_suppkey' AS "by" FROM lineitem GROUP BY 1 UNION ALL SELECT NULL, year(l_shipdate)::BIGINT, count(*), 'yr' FROM lineitem GROUP BY 2
"""
)
def two_groupings(spark, d):
    return H.two_groupings(lines(spark, d), ["l_suppkey"], ["yr"], [F.count("*").alias("n")])


@query(
    """
WITH y AS (SELECT DISTINCT o_custkey, year(o_orderdate)::BIGINT AS yr FROM orders WHERE year(o_orderdate) <= 2000), i AS (SELECT o_custkey, max(yr) AS last_year, count(*) AS length FROM (SELECT *, yr - row_number() OVER (PARTITION BY o_custkey ORDER BY yr) AS g FROM y) GROUP BY o_custkey, g),
b AS (SELECT o_custkey, year(o_orderdate)::BIGINT AS yr, max(floor(o_totalprice))::BIGINT AS best FROM orders GROUP BY 1, 2), p AS (SELECT *, max(best) OVER (PARTITION BY o_custkey ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM b)
SELECT 'title-won' AS kind, o_custkey, count(*) AS value FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) = 2000 GROUP BY 2
UNION ALL SELECT 'streak', o_custkey, length FROM i WHERE last_year = 2000 AND length >= 3 UNION ALL SELECT 'streak-stopped', o_custkey, length FROM i WHERE last_year = 1999 AND length >= 3
UNION ALL SELECT 'self-best', o_custkey, best FROM p WHERE yr = 2000 AND best > prior
"""
)
def stories(spark, d):
    o = orders(spark, d).withColumn("score", F.floor("o_totalprice"))
    return H.stories(o.where("o_orderstatus = 'F'"), o, "o_custkey", "yr", "score", 2000)


@query(
    """
WITH r AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'undecided' WHEN o_totalprice < 5000 THEN 'too small' WHEN o_custkey % 10 = 0 THEN 'excluded' END AS skipped FROM orders) SELECT skipped, count(*) AS n FROM r WHERE skipped IS NOT NULL GROUP BY 1
"""
)
def replay_skips(spark, d):
    return H.replay_sequence(orders(spark, d), ["o_orderdate", "o_orderkey"], [("undecided", F.col("o_orderstatus") != "P"), ("too small", F.col("o_totalprice") >= 5000), ("excluded", F.col("o_custkey") % 10 != 0)])[1]


@query(
    r"""
SELECT page_id, CASE WHEN regexp_matches(url, '//(www|blog)\.') THEN 'site' WHEN regexp_matches(url, '/en/') THEN 'english' WHEN regexp_matches(url, '\.html') THEN 'file' ELSE 'other' END AS page_type FROM pages
"""
)
def page_types(spark, d):
    return table(spark, d, "pages").select("page_id", first_match(F.col("url"), [("site", r"//(www|blog)\."), ("english", "/en/"), ("file", r"\.html")], "other").alias("page_type"))


@query(
    """
WITH a AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS l, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS b FROM orders)
SELECT x.o_custkey, x.o_orderkey AS latest_o_orderkey, x.o_totalprice AS latest_o_totalprice, y.o_orderkey AS best_o_orderkey, y.o_totalprice AS best_o_totalprice FROM a x JOIN a y ON x.o_custkey = y.o_custkey WHERE x.l = 1 AND y.b = 1
"""
)
def latest_and_best(spark, d):
    return H.latest_and_best(orders(spark, d), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], [F.desc("o_totalprice"), F.asc("o_orderkey")], ["o_orderkey", "o_totalprice"])


@query(
    """
SELECT year(l_shipdate)::BIGINT AS yr, count(DISTINCT l_orderkey) AS entries, count(DISTINCT CASE WHEN l_linenumber < 7 THEN l_suppkey END) AS teams, count(DISTINCT l_partkey) AS players, count(*) FILTER (WHERE l_linenumber >= 7) AS without_team FROM lineitem GROUP BY 1
"""
)
def entry_overview(spark, d):
    x = lines(spark, d).withColumn("team", F.when(F.col("l_linenumber") < 7, F.col("l_suppkey")))
    return H.entry_overview(x, ["yr"], "l_orderkey", "team", "l_partkey")


# Of three neighbours the first two meet, so frames can be numbered by place.
@query(
    """
WITH x AS (SELECT p_partkey // 96 AS draw, p_partkey AS entry, p_partkey % 96 // 3 * 2 + CASE WHEN p_partkey % 96 % 3 = 2 THEN 1 ELSE 0 END AS frame FROM part),
f AS (SELECT draw, frame, count(*) AS n FROM x GROUP BY 1, 2), s AS (SELECT draw, count(*) AS size FROM f GROUP BY 1)
SELECT x.draw, x.entry, CASE WHEN size & (size - 1) <> 0 THEN NULL WHEN f.n = 2 THEN 'packing' WHEN o.n = 2 THEN 'seed' ELSE 'extra' END AS type
FROM x JOIN f ON f.draw = x.draw AND f.frame = x.frame JOIN s ON s.draw = x.draw LEFT JOIN f o ON o.draw = x.draw AND o.frame = xor(x.frame, 1)
"""
)
def entry_types(spark, d):
    """Seed, extra or packing of each entry of a draw; unit tests hold it against a loop."""
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 96).alias("draw"), F.col("p_partkey").alias("entry"))
    first = p.where("entry % 3 = 0").select("draw", F.col("entry").alias("p"), (F.col("entry") + 1).alias("q"))
    return H.entry_types(p, first, ["draw"], "entry")


@query(
    """
WITH i AS (SELECT user_id, ts::DATE AS day, floor(value)::BIGINT AS x0, floor(value)::BIGINT + 10 AS x1 FROM events),
n AS (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY user_id, day ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 0 ELSE 1 END AS fresh FROM i),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, day ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT user_id, day, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM r GROUP BY user_id, day, run
"""
)
def merged_intervals(spark, d):
    from ..operators.sequences import merge_intervals

    x = events(spark, d).select("user_id", "day", F.floor("value").alias("x0")).withColumn("x1", F.col("x0") + 10)
    return merge_intervals(x, ["user_id", "day"], "x0", "x1", 2)


@query(
    """
WITH s AS (SELECT p_partkey, p_size, lower(replace(p_name, ' ', '-')) AS s FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY p_size, s ORDER BY p_partkey) AS n FROM s)
SELECT p_partkey, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS slug FROM n
"""
)
def unique_slugs(spark, d):
    from ..operators.sequences import unique_slugs as slugs

    return slugs(table(spark, d, "part"), ["p_size"], F.lower(F.regexp_replace("p_name", " ", "-")), ["p_partkey"]).select("p_partkey", "slug")


@query(
    """
WITH a AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey % 5)) AS s FROM lineitem GROUP BY 1), g AS (SELECT s, count(*) AS n, list_sort(list(l_orderkey))[1:2] AS f FROM a GROUP BY 1)
SELECT l_orderkey, n - 1 AS meetings, CASE WHEN f[1] = l_orderkey THEN f[2] ELSE f[1] END AS first_other FROM a JOIN g ON a.s = g.s
"""
)
def equal_sets(spark, d):
    from ..operators.joins import set_meetings

    x = lines(spark, d).groupBy("l_orderkey").agg(F.collect_list(F.col("l_suppkey") % 5).alias("members"))
    return set_meetings(x, "l_orderkey", "members").select("l_orderkey", "meetings", "first_other")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority = '1-URGENT' AND year(o_orderdate) IN (1997, 1999)")
def facet_filter(spark, d):
    from ..operators.joins import faceted

    x = faceted(orders(spark, d), {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT"], "yr": [1997, 1999], "o_custkey": []})
    return x.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(
    """
WITH t AS (SELECT o_custkey % 20 AS cup, year(o_orderdate)::BIGINT AS yr, max(o_custkey) AS champion FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
l AS (SELECT o_custkey % 20 AS cup, year(o_orderdate)::BIGINT AS yr, o_custkey AS loser, o_orderkey FROM orders WHERE o_orderstatus = 'O'),
k AS (SELECT l.*, row_number() OVER (PARTITION BY l.cup, l.yr ORDER BY o_orderkey) AS k FROM l JOIN t ON t.cup = l.cup AND t.yr + 1 = l.yr AND t.champion = l.loser)
SELECT cup, yr, loser, o_orderkey FROM k WHERE k = 1
"""
)
def champion_defeats(spark, d):
    o = orders(spark, d).withColumn("cup", F.col("o_custkey") % 20)
    titles = o.where("o_orderstatus = 'F'").groupBy("cup", "yr").agg(F.max("o_custkey").alias("champion"))
    losses = o.where("o_orderstatus = 'O'").select("cup", "yr", F.col("o_custkey").alias("loser"), "o_orderkey")
    return H.champion_defeats(titles, losses, ["cup"], "yr", "champion", "loser", [F.asc("o_orderkey")]).select("cup", "yr", "loser", "o_orderkey")


@query(
    """
SELECT l_suppkey AS to_team, l_partkey % 25 AS from_team, count(DISTINCT l_orderkey) AS members FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) >= 2
"""
)
def feeder_groups(spark, d):
    x = lines(spark, d).select(F.col("l_suppkey").alias("to_team"), (F.col("l_partkey") % 25).alias("from_team"), "l_orderkey")
    return H.feeders(x, "from_team", "to_team", "l_orderkey")


@query(
    """
WITH m AS (SELECT o_orderkey, [o_custkey % 30, o_custkey % 7] AS a, [o_orderkey % 30, o_orderkey % 11] AS b, o_orderstatus = 'F' AS w FROM orders WHERE o_orderstatus <> 'P'),
t AS (SELECT *, list_has_any(a, [3, 5, 8]) AS ia, list_has_any(b, [3, 5, 8]) AS ib FROM m)
SELECT o_orderkey, CASE WHEN ia THEN w ELSE NOT w END AS won FROM t WHERE ia OR ib
"""
)
def team_oriented(spark, d):
    o = orders(spark, d).where("o_orderstatus <> 'P'")
    m = o.select("o_orderkey", F.array(F.col("o_custkey") % 30, F.col("o_custkey") % 7).alias("a"), F.array(F.col("o_orderkey") % 30, F.col("o_orderkey") % 11).alias("b"), (F.col("o_orderstatus") == "F").alias("w"))
    return H.oriented(m, F.array(*(F.lit(i).cast("long") for i in (3, 5, 8))), "a", "b", F.col("w")).select("o_orderkey", "won")


@query(
    """
WITH s AS (SELECT p_partkey // 8 AS draw, p_partkey % 8 AS slot, p_partkey AS entry FROM part)
SELECT draw, r AS round, slot >> r AS slot, min(entry) AS entry FROM s, range(0, 4) t(r) GROUP BY draw, r, slot >> r
"""
)
def draw_winners(spark, d):
    """Draws of eight in which the smaller number always wins: results for all who could meet, then the rounds."""
    from ..operators.graph import draw_winners as rounds

    s = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 8).alias("draw"), (F.col("p_partkey") % 8).alias("slot"), F.col("p_partkey").alias("entry"))
    field = s.groupBy("draw").agg(F.collect_list("entry").alias("entries"))
    won = field.select("draw", "entries", F.explode("entries").alias("winner")).select("draw", "winner", F.explode("entries").alias("loser")).where("winner < loser")
    return rounds(s, won, ["draw"], 3).select("draw", F.col("round").cast("long").alias("round"), "slot", "entry")
