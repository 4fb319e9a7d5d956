"""Queries of point logs, identity and changes: events of a user are points, days are games."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import history as H
from ..operators import incremental as I
from ..operators import points as P
from ..operators import quality as Q
from ..sources.tables import table
from .registry import query
from .sequences import WINNER, events


def point_log(spark, d):
    """match (user), game (day of the year), point, winner, rally, double_fault, serving; and its games."""
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    x = events(spark, d).select(F.col("user_id").alias("match"), F.dayofyear("ts").cast("long").alias("game"), F.row_number().over(w).alias("point"), F.col("w").alias("winner"), F.floor("value").cast("int").alias("rally"), F.lit(False).alias("double_fault"), F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("serving"))
    games = x.groupBy("match", "game").agg(F.max_by("winner", F.when(F.col("winner").isNotNull(), F.col("point"))).alias("winner")).withColumn("best_of", F.lit(9))
    return x, games


@query(
    f"""
WITH x AS (SELECT user_id AS match, dayofyear(ts) <= 15 AS early, {WINNER} AS w, event_id % 2 = 0 AS serves FROM events),
m AS (SELECT match, early, 'points' AS metric, count(*) FILTER (WHERE w = 'A') AS part, count(*) AS whole FROM x WHERE w IS NOT NULL GROUP BY 1, 2
 UNION ALL SELECT match, early, 'on_serve', count(*) FILTER (WHERE w = 'A' AND serves), count(*) FILTER (WHERE serves) FROM x WHERE w IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN whole > 0 THEN 100.0 * part / whole END AS rate FROM m),
j AS (SELECT a.match, a.metric, a.part, a.whole, round(a.rate, 4) AS rate, round(b.rate, 4) AS rate_before, b.whole AS whole_before, a.rate - b.rate AS delta, least(a.whole, b.whole) AS low FROM r a JOIN r b ON a.match = b.match AND a.metric = b.metric AND NOT a.early AND b.early)
SELECT match, metric, part, whole, rate, rate_before, whole_before, round(delta, 4) AS delta, CASE WHEN delta IS NULL THEN NULL WHEN abs(delta) < 2 THEN 'stable' WHEN delta > 0 THEN 'improved' ELSE 'declined' END AS trend,
  CASE WHEN low < 5 THEN 'low' WHEN low < 10 THEN 'medium' ELSE 'high' END AS confidence FROM j
"""
)
def growth_comparison(spark, d):
    x, games = point_log(spark, d)
    side = P.by_side(P.reconstruct(x, games)).where("side = 'A'")
    half = lambda early: P.combine(P.side_metrics(side.where((F.col("game") <= 15) == early), ["match"]), ["match"])
    out = P.compare(half(False), half(True), ["match"]).where("metric IN ('points', 'on_serve')")
    return out.select("match", "metric", "part", "whole", F.round("rate", 4).alias("rate"), F.round("rate_before", 4).alias("rate_before"), "whole_before", F.round("delta", 4).alias("delta"), "trend", "confidence")


@query(
    f"""
WITH x AS (SELECT user_id AS match, dayofyear(ts) AS game, {WINNER} AS w, event_id % 2 = 0 AS serves, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) = 1 AS opens FROM events),
s AS (SELECT match, game <= 15 AS early, w = 'A' AS won, serves, opens FROM x WHERE w IS NOT NULL),
m AS (SELECT match, early, 'on_serve' AS metric, count(*) FILTER (WHERE won AND serves) AS part, count(*) FILTER (WHERE serves) AS whole FROM s GROUP BY 1, 2
 UNION ALL SELECT match, early, 'on_return', count(*) FILTER (WHERE won AND NOT serves), count(*) FILTER (WHERE NOT serves) FROM s GROUP BY 1, 2
 UNION ALL SELECT match, early, 'first_point', count(*) FILTER (WHERE won AND opens), count(*) FILTER (WHERE opens) FROM s GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN whole > 0 THEN 100.0 * part / whole END AS rate FROM m),
j AS (SELECT a.match, a.metric, a.rate - b.rate AS delta FROM r a JOIN r b ON a.match = b.match AND a.metric = b.metric AND NOT a.early AND b.early),
t AS (SELECT match, metric, row_number() OVER (PARTITION BY match ORDER BY delta, metric) AS n FROM j WHERE abs(delta) >= 2 AND delta < 0),
w AS (SELECT match, metric, sum(part) AS part, sum(whole) AS whole FROM m GROUP BY 1, 2)
SELECT match, 'theme' AS kind, CASE metric WHEN 'on_serve' THEN 'serve' WHEN 'on_return' THEN 'return' ELSE 'starts' END AS name FROM t WHERE n <= 3
UNION ALL SELECT match, 'hint', CASE metric WHEN 'on_serve' THEN 'weak serve' WHEN 'on_return' THEN 'weak return' ELSE 'slow start' END FROM w WHERE whole >= 5 AND 100.0 * part / whole < CASE metric WHEN 'on_serve' THEN 50 ELSE 45 END
"""
)
def practice_themes(spark, d):
    """Up to three themes for metrics that declined, and hints by threshold."""
    x, games = point_log(spark, d)
    side = P.by_side(P.reconstruct(x, games)).where("side = 'A'")
    m = P.side_metrics(side, ["match"])
    half = lambda early: P.combine(P.side_metrics(side.where((F.col("game") <= 15) == early), ["match"]), ["match"])
    themes = spark.createDataFrame([("on_serve", "serve"), ("on_return", "return"), ("first_point", "starts")], "metric string, theme string")
    t = P.practice_themes(P.compare(half(False), half(True), ["match"]), ["match"], themes).select("match", F.lit("theme").alias("kind"), F.col("theme").alias("name"))
    h = P.hints(m, ["match"], [("weak serve", "on_serve", F.col("rate") < 50), ("weak return", "on_return", F.col("rate") < 45), ("slow start", "first_point", F.col("rate") < 45)]).select("match", F.lit("hint").alias("kind"), F.col("hint").alias("name"))
    return t.unionByName(h)


@query(
    """
WITH x AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'net' WHEN 'view' THEN 'out' WHEN 'click' THEN 'double_fault' END AS result FROM events), c AS (SELECT user_id, result, count(*) AS n FROM x WHERE result IS NOT NULL GROUP BY 1, 2)
SELECT user_id, result, n, round(100.0 * n / sum(n) OVER (PARTITION BY user_id), 6) AS share FROM c
"""
)
def error_breakdown(spark, d):
    result = F.when(F.col("event_type") == "error", "net").when(F.col("event_type") == "view", "out").when(F.col("event_type") == "click", "double_fault").otherwise("smash_winner")
    return P.error_breakdown(events(spark, d).withColumn("result", result), ["user_id"]).withColumn("share", F.round("share", 6))


@query(
    f"""
WITH x AS (SELECT user_id AS match, dayofyear(ts)::BIGINT AS game, {WINNER} AS w, floor(value)::BIGINT AS rally, ts, event_id FROM events),
r AS (SELECT 'longest_rally' AS event, match, game, rally AS value FROM x WHERE rally >= 9 AND rally = (SELECT max(rally) FROM x)),
n AS (SELECT match, game, count(*) AS value FROM x GROUP BY 1, 2), l AS (SELECT 'longest_game' AS event, match, game, value FROM n WHERE value >= 9 AND value = (SELECT max(value) FROM n)),
s AS (SELECT *, sum(CASE w WHEN 'A' THEN 1 WHEN 'B' THEN -1 ELSE 0 END) OVER (PARTITION BY match, game ORDER BY ts, event_id)::BIGINT AS diff FROM x),
g AS (SELECT match, game, max_by(diff, (ts, event_id)) AS final, min(diff) AS low, max(diff) AS high FROM s GROUP BY 1, 2), f AS (SELECT match, game, CASE WHEN final > 0 THEN greatest(-low, 0) WHEN final < 0 THEN greatest(high, 0) END AS value FROM g),
c AS (SELECT 'largest_comeback' AS event, match, game, value FROM f WHERE value >= 2 AND value = (SELECT max(value) FROM f)), u AS (SELECT * FROM r UNION ALL SELECT * FROM l UNION ALL SELECT * FROM c)
SELECT event, match, game, value FROM u QUALIFY count(*) OVER (PARTITION BY event) <= 3
"""
)
def rare_events(spark, d):
    return P.rare_events(point_log(spark, d)[0])


@query(
    """
WITH RECURSIVE p AS (SELECT p_partkey AS node, p_partkey // 2 AS up FROM part WHERE p_partkey > 0), t AS (SELECT 0::BIGINT AS node, 0 AS depth UNION ALL SELECT p.node, depth + 1 FROM t JOIN p ON p.up = t.node)
SELECT node, CASE WHEN depth % 2 = 0 THEN 'boys' ELSE 'girls' END AS value FROM t
"""
)
def opposite_closure(spark, d):
    p = table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("a"), F.floor(F.col("p_partkey") / 2).alias("b"))
    known = table(spark, d, "part").where("p_partkey = 0").select(F.col("p_partkey").alias("node"), F.lit("boys").alias("value"))
    return G.opposite_closure(p, known, ("boys", "girls"))


@query(
    """
WITH RECURSIVE m AS (SELECT p_size, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n FROM part),
e AS (SELECT a.p_size, a.p_partkey::VARCHAR AS a, b.p_partkey::VARCHAR AS b FROM m a JOIN m b ON a.p_size = b.p_size AND b.n = a.n + 1 WHERE (a.p_partkey + b.p_partkey) % 5 <> 0),
n AS (SELECT p_size, a, b FROM e UNION SELECT p_size, b, a FROM e), r AS (SELECT p_size, p_partkey::VARCHAR AS node, p_partkey::VARCHAR AS seen FROM m UNION SELECT r.p_size, r.node, n.b FROM r JOIN n ON n.p_size = r.p_size AND n.a = r.seen)
SELECT p_size, node::BIGINT AS p_partkey, min(seen) AS cluster FROM r GROUP BY 1, 2
"""
)
def greedy_merge(spark, d):
    m = table(spark, d, "part").select("p_size", "p_partkey")
    after = F.lead("p_partkey").over(Window.partitionBy("p_size").orderBy("p_partkey"))
    shared = m.select("p_size", F.col("p_partkey").alias("a"), after.alias("b")).where("b is not null")
    return G.greedy_merge(m, shared, "p_size", "p_partkey", shared.where("(a + b) % 5 = 0"))


@query(
    """
WITH o AS (SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_partkey % 7 <> 0), n AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN p_name || '!' ELSE p_name END AS p_name, p_retailprice + 1 AS p_retailprice FROM part WHERE p_partkey % 5 <> 0)
SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'added' WHEN n.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL OUTER JOIN n ON o.p_partkey = n.p_partkey WHERE o.p_partkey IS NULL OR n.p_partkey IS NULL OR o.p_name <> n.p_name
"""
)
def changed_rows(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    new = p.where("p_partkey % 5 <> 0").withColumn("p_name", F.when(F.col("p_partkey") % 11 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))).withColumn("p_retailprice", F.col("p_retailprice") + 1)
    return I.changed_rows(p.where("p_partkey % 7 <> 0"), new, ["p_partkey"], ignored=["p_retailprice"])


@query(
    """
SELECT p_brand, string_split(p_name, ' ')[1] AS core, array_to_string(list_sort(list(DISTINCT p_name)), ',') AS names FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_name) >= 2
"""
)
def merge_candidates(spark, d):
    x = Q.merge_candidates(table(spark, d, "part"), "p_brand", F.split("p_name", " ")[0], "p_name")
    return x.withColumn("names", F.array_join("names", ","))


@query(
    """
WITH p AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'service_ace' WHEN 'error' THEN 'double_fault' WHEN 'view' THEN 'receive_error' ELSE 'smash_winner' END AS result, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'A' ELSE 'B' END AS s,
  CASE WHEN event_id % 5 = 0 THEN 'B-0-y' END AS wp, CASE WHEN event_id % 7 = 0 THEN 'A-0-x' END AS lp FROM events),
w AS (SELECT *, result IN ('double_fault', 'receive_error') AS err, CASE s WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' END AS o FROM p)
SELECT event_id, s AS serving_team, coalesce(CASE WHEN err THEN CASE substr(lp, 1, 1) WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' END ELSE substr(wp, 1, 1) END, CASE WHEN result IN ('service_ace', 'receive_error') THEN s WHEN result = 'double_fault' THEN o END) AS winner_team,
  CASE WHEN s IS NOT NULL AND result IN ('service_ace', 'double_fault') THEN 1 WHEN s IS NOT NULL AND result = 'receive_error' THEN 2 END AS rally_count FROM w
"""
)
def inferred_points(spark, d):
    null = lambda kind: F.lit(None).cast(kind)
    e = F.col("event_type")
    x = events(spark, d).select(
        "event_id",
        F.when(e == "purchase", "service_ace").when(e == "error", "double_fault").when(e == "view", "receive_error").otherwise("smash_winner").alias("result"),
        F.when(F.col("event_id") % 3 == 1, "A").when(F.col("event_id") % 3 == 2, "B").alias("ctx_serving_team"),
        F.when(F.col("event_id") % 5 == 0, "B-0-y").alias("winner_player"),
        F.when(F.col("event_id") % 7 == 0, "A-0-x").alias("loser_player"),
        null("string").alias("serving_team"), null("string").alias("winner_team"), null("int").alias("rally_count"), null("boolean").alias("first_serve_fault"), null("string").alias("ctx_server"), null("string").alias("ctx_receiver"),
    )
    return H.infer_point(x, P.ERRORS).select("event_id", "serving_team", "winner_team", "rally_count")
