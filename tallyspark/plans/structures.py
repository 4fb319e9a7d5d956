"""Queries of graphs, league tables, ratings, mining, quality and incremental maintenance."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import incremental as I
from ..operators import mining as M
from ..operators import points as P
from ..operators import quality as Q
from ..operators import rating as E
from ..operators.ranking import league_table
from ..sources.tables import table
from .registry import query
from .results import lines, orders
from .sequences import WINNER, events


@query(
    """
WITH m AS (SELECT l_returnflag AS league, l_suppkey % 12 AS a, l_partkey % 12 AS b, l_quantity::BIGINT AS sa, (l_linenumber * 7)::BIGINT AS sb FROM lineitem WHERE l_suppkey % 12 <> l_partkey % 12),
s AS (SELECT league, a AS team, b AS other, sa AS own, sb AS against FROM m UNION ALL SELECT league, b, a, sb, sa FROM m),
t AS (SELECT league, team, count(*) AS played, count(*) FILTER (WHERE own > against) AS won, count(*) FILTER (WHERE own < against) AS lost, sum(own)::BIGINT AS points_won, sum(against)::BIGINT AS points_lost FROM s GROUP BY 1, 2),
h AS (SELECT s.league, s.team, count(*) FILTER (WHERE own > against) AS mini_won, sum(own - against)::BIGINT AS mini_difference FROM s JOIN t x ON x.league = s.league AND x.team = s.team JOIN t y ON y.league = s.league AND y.team = s.other AND x.won = y.won GROUP BY 1, 2),
f AS (SELECT t.*, coalesce(mini_won, 0) AS mini_won, coalesce(mini_difference, 0) AS mini_difference, points_won - points_lost AS difference FROM t LEFT JOIN h ON h.league = t.league AND h.team = t.team)
SELECT *, row_number() OVER (PARTITION BY league ORDER BY won DESC, mini_won DESC, difference DESC, points_won DESC, team) AS place FROM f
"""
)
def standings_minileague(spark, d):
    m = lines(spark, d).where("l_suppkey % 12 <> l_partkey % 12")
    m = m.select(F.col("l_returnflag").alias("league"), (F.col("l_suppkey") % 12).alias("a"), (F.col("l_partkey") % 12).alias("b"), F.col("l_quantity").cast("long").alias("sa"), (F.col("l_linenumber") * 7).cast("long").alias("sb"))
    return league_table(m, ["league"], "a", "b", "sa", "sb").withColumn("place", F.col("place").cast("long"))


@query(
    """
WITH RECURSIVE e AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER w AS b, datediff('day', o_orderdate, lead(o_orderdate) OVER w) AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
n AS (SELECT a, b FROM e WHERE gap <= 60 UNION SELECT b, a FROM e WHERE gap <= 60),
r AS (SELECT a AS node, a AS seen FROM n UNION SELECT r.node, n.b FROM r JOIN n ON r.seen = n.a)
SELECT node, min(seen) AS component FROM r GROUP BY 1
"""
)
def connected_components(spark, d):
    from pyspark.sql import Window

    # An order and the customer's next one belong together if at most 60 days lie between them.
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    e = orders(spark, d).select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b"), F.datediff(F.lead("o_orderdate").over(w), "o_orderdate").alias("gap"))
    return G.connected_components(e.where("gap <= 60"))


@query(
    """
WITH RECURSIVE p AS (SELECT p_partkey AS node, p_partkey // 2 AS previous, p_size AS grp FROM part WHERE p_partkey > 0),
d AS (SELECT 0::BIGINT AS node, 0 AS depth UNION ALL SELECT p.node, d.depth + 1 FROM d JOIN p ON p.previous = d.node)
SELECT node, max(depth)::BIGINT AS depth FROM d GROUP BY 1
"""
)
def bracket_depth(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.lit(1).alias("file"))
    edges = p.where("node > 0").withColumn("previous", F.floor(F.col("node") / 2))
    return G.depths(edges, p, ["file"]).select("node", F.col("depth").cast("long").alias("depth"))


@query(
    """
WITH e AS (SELECT p_partkey // 64 AS draw, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'seed' ELSE 'packing' END AS kind FROM part),
r AS (SELECT *, sum(CASE WHEN kind = 'seed' THEN 1 ELSE 0 END) OVER (PARTITION BY draw ORDER BY p_partkey) AS run FROM e),
k AS (SELECT *, sum(CASE WHEN kind = 'packing' THEN 1 ELSE 0 END) OVER (PARTITION BY draw, run ORDER BY p_partkey) - 1 AS inside FROM r),
w AS (SELECT draw, run, count(*) FILTER (WHERE kind = 'seed') * 2 + ((count(*) FILTER (WHERE kind = 'packing') + 1) // 2) * 2 AS width FROM r GROUP BY 1, 2),
s AS (SELECT draw, run, coalesce(sum(width) OVER (PARTITION BY draw ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w)
SELECT k.draw, k.p_partkey, k.kind, (s.start + CASE WHEN kind = 'packing' THEN inside + CASE WHEN k.run > 0 THEN 2 ELSE 0 END ELSE 0 END)::BIGINT AS slot FROM k JOIN s ON s.draw = k.draw AND s.run = k.run
"""
)
def draw_slots(spark, d):
    e = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 64).alias("draw"), "p_partkey", F.when(F.col("p_partkey") % 3 == 0, "seed").otherwise("packing").alias("kind"))
    return G.draw_slots(e, ["draw"], "p_partkey", "kind")


@query(
    """
WITH k AS (SELECT x.* FROM (SELECT l_returnflag AS flag, l_linestatus AS status, CASE WHEN l_linenumber < 7 THEN l_linenumber::VARCHAR END AS line, CASE WHEN l_quantity > 48 THEN 'top' WHEN l_quantity > 5 THEN 'mid' ELSE 'low' END AS qty FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'O' AND l_quantity > 48)) x),
u AS (SELECT 'flag=' || flag AS a, 'line=' || line AS b FROM k WHERE line IS NOT NULL UNION ALL SELECT 'flag=' || flag, 'qty=' || qty FROM k UNION ALL SELECT 'flag=' || flag, 'status=' || status FROM k
  UNION ALL SELECT 'line=' || line, 'qty=' || qty FROM k WHERE line IS NOT NULL UNION ALL SELECT 'line=' || line, 'status=' || status FROM k WHERE line IS NOT NULL UNION ALL SELECT 'qty=' || qty, 'status=' || status FROM k),
c AS (SELECT string_split(a, '=')[1] AS fa, string_split(b, '=')[1] AS fb, a, b, count(*) AS n FROM u GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY fa, fb) AS universe, sum(n) OVER (PARTITION BY fa, fb, a) AS ma, sum(n) OVER (PARTITION BY fa, fb, b) AS mb FROM c)
SELECT a || ' & ' || b AS pattern, n, universe::BIGINT AS universe, (20000 * ma::HUGEINT * mb + universe) // (2 * universe) / 10000.0 AS expected, (2000000 * n::HUGEINT * universe + ma::HUGEINT * mb) // (2 * ma::HUGEINT * mb) / 1000000.0 AS lift FROM m
"""
)
def lift_pairs(spark, d):
    x = lines(spark, d).where("NOT (l_returnflag = 'R' AND l_linestatus = 'O' AND l_quantity > 48)")
    x = x.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.when(F.col("l_linenumber") < 7, F.col("l_linenumber").cast("string")).alias("line"), F.when(F.col("l_quantity") > 48, "top").when(F.col("l_quantity") > 5, "mid").otherwise("low").alias("qty"))
    return M.exact_lift(M.pattern_lattice(x, ["flag", "status", "line", "qty"], [2])).select("pattern", "n", "universe", "expected", "lift")


_FEATURES = ("hour", "kind", "price", "weekday")


def _rare_sql(few: int, least: int, lift: float, tighten: float, most: int, scope: str) -> str:
    by = f"PARTITION BY {scope}" if scope else ""
    keys = f"{scope}, " if scope else ""

    def cells(s: tuple[str, ...]) -> str:
        product = " * ".join(f"(sum(n) OVER (PARTITION BY {keys}{f}))::HUGEINT" for f in s)
        power = " * ".join([f"(sum(n) OVER ({by}))::HUGEINT"] * (len(s) - 1))
        return f"SELECT {keys}[{', '.join(s)}] AS atoms, n, (sum(n) OVER ({by}))::BIGINT AS universe, {product} AS p, {power} AS u FROM (SELECT {keys}{', '.join(s)}, count(*) AS n FROM k GROUP BY ALL)"

    every = " UNION ALL ".join(cells(s) for n in range(2, most + 1) for s in combinations(_FEATURES, n))
    same = f"low.{scope} = f.{scope} AND " if scope else ""
    return f"""
WITH k AS (SELECT event_type AS scope, 'hour=' || hour(ts) AS hour, 'kind=' || {"user_id % 5" if scope else "event_type"} AS kind, 'price=' || CASE WHEN value > 50 THEN 'dear' ELSE 'cheap' END AS price, 'weekday=' || (dayofweek(ts) + 1) AS weekday FROM events),
p AS (SELECT *, p::DOUBLE / u::DOUBLE AS e, (n * u)::DOUBLE / p::DOUBLE AS l, len(atoms) AS size FROM ({every})),
c AS (SELECT *, l <= {lift} * {tighten}::DOUBLE ** (size - 2) AS low FROM p WHERE n <= {few}),
f AS (SELECT *, low AND e >= {least} AS rare FROM c)
SELECT {keys}array_to_string(atoms, ' & ') AS pattern, n::BIGINT AS n, universe, (20000 * p + u) // (2 * u) / 10000.0 AS expected, (2000000 * n * u + p) // (2 * p) / 1000000.0 AS lift,
  CASE WHEN rare AND EXISTS (SELECT 1 FROM c low WHERE {same}low.low AND low.size = f.size - 1 AND list_has_all(f.atoms, low.atoms)) THEN 'reducible' WHEN rare THEN 'rare' ELSE 'complex' END AS verdict FROM f
"""


def _event_features(spark, d, kind):
    return events(spark, d).select(F.col("event_type").alias("scope"), kind.alias("kind"), F.dayofweek("ts").alias("weekday"), F.hour("ts").alias("hour"), F.when(F.col("value") > 50, "dear").otherwise("cheap").alias("price"))


@query(_rare_sql(40, 45, 0.95, 0.7, 3, ""))
def rare_patterns(spark, d):
    """Lift mining of up to three conditions with its reducible patterns."""
    x = M.rare_patterns(_event_features(spark, d, F.col("event_type")), list(_FEATURES), 3, 40, 45.0, 0.95)
    return M.exact_lift(x).select("pattern", "n", "universe", "expected", "lift", "verdict")


@query(_rare_sql(4, 6, 0.9, 0.9, 4, "scope"))
def rare_patterns_scoped(spark, d):
    """The same up to four conditions within each kind of event, the scope."""
    x = M.rare_patterns(_event_features(spark, d, F.col("user_id") % 5), list(_FEATURES), 4, 4, 6.0, 0.9, 0.9, scope=["scope"])
    return M.exact_lift(x).select("scope", "pattern", "n", "universe", "expected", "lift", "verdict")


@query(
    """
WITH f AS (
 SELECT 'order-without-lines' AS rule, 'warning' AS severity, o_orderkey::VARCHAR AS key, 'unused' AS detail FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
 UNION ALL SELECT 'customer-without-orders', 'warning', c_custkey::VARCHAR, 'unused' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
 UNION ALL SELECT 'line-without-order', 'error', l_orderkey::VARCHAR, l_linenumber::VARCHAR FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
 UNION ALL SELECT 'duplicate-line', 'error', l_orderkey || '/' || l_linenumber, count(*)::VARCHAR FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
 UNION ALL SELECT 'shipped-before-order', 'error', l_orderkey::VARCHAR, l_linenumber::VARCHAR FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate)
SELECT * FROM f
"""
)
def validation_findings(spark, d):
    o, x = orders(spark, d), lines(spark, d)
    early = x.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return Q.findings(
        [
            Q.childless(o, x, "o_orderkey", "l_orderkey", "order-without-lines", "warning"),
            Q.childless(table(spark, d, "customer"), o, "c_custkey", "o_custkey", "customer-without-orders", "warning"),
            Q.orphans(x, o, "l_orderkey", "o_orderkey", "line-without-order", "error", F.col("l_linenumber")),
            Q.duplicates(x, ["l_orderkey", "l_linenumber"], "duplicate-line", "error"),
            Q.outside(early, F.col("l_orderkey"), F.col("l_shipdate") < F.col("o_orderdate"), "shipped-before-order", "error", F.col("l_linenumber")),
        ]
    )


@query(
    """
SELECT user_id, ts::DATE AS day, max(value) AS latest_start, min(value + 60) AS earliest_end FROM events GROUP BY 1, 2 HAVING max(value) > min(value + 60)
"""
)
def interval_conflict(spark, d):
    return Q.empty_intersections(events(spark, d).withColumn("high", F.col("value") + 60), ["user_id", "day"], "value", "high")


@query("SELECT l_partkey, year(l_shipdate)::BIGINT AS yr, count(DISTINCT l_suppkey) AS places FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1")
def in_two_places(spark, d):
    return Q.in_two_places(lines(spark, d), ["l_partkey", "yr"], "l_suppkey")


@query(
    """
SELECT 'dear' AS "check", count(*) FILTER (WHERE o_totalprice > 400000) AS n FROM orders UNION ALL SELECT 'open', count(*) FILTER (WHERE o_orderstatus = 'O') FROM orders UNION ALL SELECT 'urgent', count(*) FILTER (WHERE o_orderpriority = '1-URGENT') FROM orders
"""
)
def health_counts(spark, d):
    return Q.health(orders(spark, d), {"dear": F.col("o_totalprice") > 400000, "open": F.col("o_orderstatus") == "O", "urgent": F.col("o_orderpriority") == "1-URGENT"})


@query(
    """
WITH s AS (SELECT l_orderkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS computed FROM lineitem GROUP BY 1)
SELECT o_orderkey AS l_orderkey, round(o_totalprice * 100)::BIGINT AS stored, computed FROM orders JOIN s ON l_orderkey = o_orderkey WHERE round(o_totalprice * 100)::BIGINT <> computed
"""
)
def score_integrity(spark, d):
    stored = orders(spark, d).select(F.col("o_orderkey").alias("l_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return Q.recomputed(lines(spark, d), stored, ["l_orderkey"], F.round(F.col("l_extendedprice") * 100).cast("long"), "cents")


@query(
    """
WITH o AS (SELECT o_orderkey, o_custkey % 40 || '/' || year(o_orderdate) AS key FROM orders WHERE o_orderkey % 10 <> 0),
n AS (SELECT o_orderkey, o_custkey % 40 || '/' || year(o_orderdate) AS key FROM orders WHERE o_orderkey % 10 <> 1 OR o_custkey % 40 > 20),
k AS (SELECT key, list_sort(list(o_orderkey)) AS s FROM o GROUP BY 1), l AS (SELECT key, list_sort(list(o_orderkey)) AS s FROM n GROUP BY 1)
SELECT coalesce(k.key, l.key) AS key, CASE WHEN k.key IS NULL THEN 'added' WHEN l.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM k FULL OUTER JOIN l ON k.key = l.key WHERE k.key IS NULL OR l.key IS NULL OR k.s <> l.s
"""
)
def manifest_diff(spark, d):
    o = orders(spark, d)
    key = F.concat_ws("/", (F.col("o_custkey") % 40).cast("string"), F.col("yr").cast("string"))
    old, new = o.where("o_orderkey % 10 <> 0"), o.where("o_orderkey % 10 <> 1 OR o_custkey % 40 > 20")
    return I.difference(I.manifest(old, key), I.manifest(new, key))


@query("SELECT l_suppkey, count(*) AS n, sum(l_quantity)::BIGINT AS qty FROM lineitem GROUP BY 1")
def incremental_refresh(spark, d):
    """Totals of a first part of the lines, refreshed for the suppliers that the rest affects: as if computed at once."""
    x = lines(spark, d)
    fold = lambda r: r.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    affected = x.where("l_shipdate >= '2001-06-01'").select("l_suppkey").distinct()
    return I.refresh(fold(x.where("l_shipdate < '2001-06-01'")), fold(x), affected, ["l_suppkey"])


#: The events' history has five weeks; the Spark side takes as many as there are.
_WEEKS = 5
_UPSETS = {"established": 3, "upset_chance": 0.49, "top_share": 0.3, "least_pool": 20}


def _elo_sql(periods: int, result: str) -> str:
    m = "SELECT event_id AS match, user_id::VARCHAR AS a, 'k' || (props->>'$.k') AS b, event_type <> 'error' AS a_won, (ts::DATE - DATE '2024-01-01') // 7 AS period, CASE event_type WHEN 'purchase' THEN 40.0 WHEN 'signup' THEN 32.0 ELSE 24.0 END AS k FROM events"
    parts = [f"m AS MATERIALIZED ({m})", "s0 AS (SELECT NULL::VARCHAR AS player, 1500.0::DOUBLE AS rating, 0::BIGINT AS played, 0::BIGINT AS won WHERE false)"]
    for p in range(periods):
        parts.append(f"c{p} AS MATERIALIZED (SELECT period, match, a, b, a_won, ra, rb, known, k * (a_won::INT - ea) AS d, CASE WHEN a_won THEN ea ELSE 1 - ea END AS chance FROM (SELECT m.*, coalesce(x.rating, 1500) AS ra, coalesce(y.rating, 1500) AS rb, least(coalesce(x.played, 0), coalesce(y.played, 0)) AS known, 1 / (1 + pow(10, (coalesce(y.rating, 1500) - coalesce(x.rating, 1500)) / 400)) AS ea FROM m LEFT JOIN s{p} x ON x.player = a LEFT JOIN s{p} y ON y.player = b WHERE period = {p}))")
        parts.append(f"v{p} AS (SELECT player, sum(d) AS d, count(*) AS n, sum(w) AS w FROM (SELECT a AS player, d, a_won::INT AS w FROM c{p} UNION ALL SELECT b, -d, (NOT a_won)::INT FROM c{p}) GROUP BY 1)")
        parts.append(f"b{p} AS (SELECT CASE WHEN len(r) >= {_UPSETS['least_pool']} THEN r[1 + floor(len(r) * {_UPSETS['top_share']})::INT] END AS bar FROM (SELECT list_reverse_sort(list(rating)) AS r FROM s{p} WHERE played >= {_UPSETS['established']}))")
        parts.append(f"u{p} AS (SELECT period, match, a, b, a_won, chance, abs(ra - rb) AS gap FROM c{p}, b{p} WHERE chance <= {_UPSETS['upset_chance']} AND known >= {_UPSETS['established']} AND CASE WHEN a_won THEN rb ELSE ra END >= bar)")
        parts.append(f"s{p + 1} AS MATERIALIZED (SELECT coalesce(s.player, v.player) AS player, round(coalesce(rating, 1500) + coalesce(d, 0), 9) AS rating, (coalesce(played, 0) + coalesce(n, 0))::BIGINT AS played, (coalesce(won, 0) + coalesce(w, 0))::BIGINT AS won FROM s{p} s FULL OUTER JOIN v{p} v ON s.player = v.player)")
    return f"WITH {', '.join(parts)} {result}"


def _matches(spark, d):
    """Every event is a match of its user against another: lost if it is an error."""
    x = events(spark, d)
    tier = F.when(F.col("event_type") == "purchase", "major").when(F.col("event_type") == "signup", "national").otherwise("local")
    week = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7)
    return x.select(week.alias("period"), F.col("event_id").alias("match"), F.array(F.col("user_id").cast("string")).alias("side_a"), F.array(F.concat(F.lit("k"), F.from_json("props", "k long")["k"].cast("string"))).alias("side_b"), (F.col("event_type") != "error").alias("a_won"), tier.alias("tier"))


@query(_elo_sql(_WEEKS, f"SELECT player, round(rating, 4) AS rating, played, won FROM s{_WEEKS}"))
def elo_replay(spark, d):
    """Ratings week by week over the whole history."""
    return E.period_ratings(_matches(spark, d))[0].withColumn("rating", F.round("rating", 4))


@query(_elo_sql(_WEEKS, "SELECT match, round(chance, 3) AS chance, round(gap)::BIGINT AS rating_gap, CASE WHEN a_won THEN a ELSE b END AS winners, CASE WHEN a_won THEN b ELSE a END AS losers FROM (" + " UNION ALL ".join(f"FROM u{p}" for p in range(_WEEKS)) + ")"))
def giant_killings(spark, d):
    """Upsets by the ratings before each week, with who won and who lost."""
    from ..operators.stories import giant_killings as killings

    m = _matches(spark, d)
    x = killings(E.period_ratings(m, **_UPSETS)[1], m)
    return x.select("match", "chance", "rating_gap", F.array_join("winners", ",").alias("winners"), F.array_join("losers", ",").alias("losers"))


@query(
    f"""
WITH x AS (SELECT user_id AS match, dayofyear(ts)::BIGINT AS game, {WINNER} AS w, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS point FROM events),
s AS (SELECT match, unnest(['A', 'B']) AS side, w, point FROM x WHERE w IS NOT NULL)
SELECT match, side, 'points' AS metric, count(*) FILTER (WHERE w = side) AS part, count(*) AS whole FROM s GROUP BY 1, 2 UNION ALL
SELECT match, side, 'first_point', count(*) FILTER (WHERE w = side AND point = 1), count(*) FILTER (WHERE point = 1) FROM s GROUP BY 1, 2
"""
)
def point_metrics(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    x = events(spark, d).select(F.col("user_id").alias("match"), F.dayofyear("ts").cast("long").alias("game"), F.row_number().over(w).alias("point"), F.col("w").alias("winner"), F.col("value").alias("rally"), F.lit(False).alias("double_fault"), F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("serving"))
    games = x.groupBy("match", "game").agg(F.max_by("winner", F.when(F.col("winner").isNotNull(), F.col("point"))).alias("winner")).withColumn("best_of", F.lit(9))
    m = P.side_metrics(P.by_side(P.reconstruct(x, games)), ["match", "side"])
    return m.where("metric IN ('points', 'first_point')").select("match", "side", "metric", "part", "whole")
