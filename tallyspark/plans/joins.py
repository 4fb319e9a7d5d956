"""Queries of joins: lookups with precedence, ranges of time, earlier seasons, returning members and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..sources.tables import table
from .registry import query
from .results import lines, orders
from .sequences import events


@query(
    """
SELECT o.o_orderkey, count(*) AS prior, max(p.o_orderdate) AS last_day, max(p.o_totalprice) AS best
FROM orders o JOIN orders p ON o.o_custkey = p.o_custkey AND p.o_orderdate >= o.o_orderdate - INTERVAL 12 MONTH AND p.o_orderdate < o.o_orderdate GROUP BY 1
"""
)
def prior_window_join(spark, d):
    o = orders(spark, d)
    before = o.select("o_custkey", F.col("o_orderdate").alias("before_day"), F.col("o_totalprice").alias("before_price"))
    x = J.within_months(o.select("o_orderkey", "o_custkey", "o_orderdate"), before, ["o_custkey"], "o_orderdate", "before_day")
    return x.groupBy("o_orderkey").agg(F.count("*").alias("prior"), F.max("before_day").alias("last_day"), F.max("before_price").alias("best"))


@query(
    """
WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), p AS (SELECT user_id, ts AS ts_before, value AS value_before FROM events WHERE event_type = 'purchase')
SELECT e.event_id, e.user_id, e.ts, p.ts_before, p.value_before FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts > p.ts_before
"""
)
def asof_previous(spark, d):
    x = events(spark, d)
    return J.as_of(x.where("event_type = 'error'").select("event_id", "user_id", "ts"), x.where("event_type = 'purchase'").select("user_id", "ts", "value"), ["user_id"], "ts", "ts", ["value"])


@query(
    """
WITH s AS (SELECT l_suppkey, year(l_shipdate)::BIGINT AS yr, count(*) AS points FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
m AS (SELECT DISTINCT l_orderkey, year(l_shipdate)::BIGINT AS yr, l_suppkey FROM lineitem)
SELECT m.l_orderkey, m.yr, count(*) AS members, avg(points) AS mean_value FROM m LEFT JOIN s ON s.l_suppkey = m.l_suppkey AND s.yr + 1 = m.yr GROUP BY 1, 2 HAVING count(*) = count(points)
"""
)
def previous_season_universal(spark, d):
    x = lines(spark, d)
    snapshot = x.where("l_returnflag = 'A'").groupBy("l_suppkey", "yr").agg(F.count("*").alias("points"))
    return J.previous_season_all(x, ["l_orderkey"], "l_suppkey", "yr", snapshot, "points")


@query(
    """
SELECT c_custkey, c_name, EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = c_custkey AND year(b.o_orderdate) = 1996) AS returning_member
FROM customer WHERE EXISTS (SELECT 1 FROM orders a WHERE a.o_custkey = c_custkey AND year(a.o_orderdate) = 1997)
"""
)
def semi_anti_returning(spark, d):
    o = orders(spark, d).withColumnRenamed("o_custkey", "c_custkey")
    now = table(spark, d, "customer").join(o.where("yr = 1997").select("c_custkey").distinct(), "c_custkey", "left_semi").select("c_custkey", "c_name")
    old, new = J.returning(now, o.where("yr = 1996"), ["c_custkey"])
    return old.withColumn("returning_member", F.lit(True)).unionByName(new.withColumn("returning_member", F.lit(False)))


@query(
    """
WITH f AS (SELECT s_suppkey, s_nationkey, s_name, s_suppkey % 7 AS exact, s_nationkey AS loose FROM supplier),
e AS (SELECT exact, min(s_suppkey) AS ev FROM f WHERE s_suppkey < 7 GROUP BY 1), l AS (SELECT loose, min(s_suppkey) AS lv FROM f GROUP BY 1 HAVING count(*) = 1)
SELECT c_custkey, coalesce(ev, lv) AS found FROM customer LEFT JOIN e ON e.exact = CASE WHEN c_custkey % 11 < 7 THEN c_custkey % 11 END LEFT JOIN l ON l.loose = c_nationkey
"""
)
def unique_fallback_join(spark, d):
    s = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") < 7, F.col("s_suppkey")).alias("want"), F.col("s_nationkey").alias("c_nationkey"), "s_suppkey")
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 < 7, F.col("c_custkey") % 11).alias("want"), "c_nationkey")
    return J.unique_fallback(c, s, "want", "c_nationkey", "s_suppkey", "found").select("c_custkey", "found")


@query(
    """
WITH a AS (SELECT n_nationkey, n_name, r_name AS alias FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0)
SELECT s_suppkey, coalesce(a.alias, n.n_name) AS label FROM supplier LEFT JOIN a ON a.n_nationkey = s_nationkey LEFT JOIN nation n ON n.n_nationkey = s_nationkey AND n.n_nationkey % 2 = 0
"""
)
def alias_precedence(spark, d):
    n = table(spark, d, "nation")
    aliases = n.where("n_nationkey % 3 = 0").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), "r_name")
    names = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return J.coalesce_lookup(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), [(aliases, "s_nationkey", "r_name"), (names, "s_nationkey", "n_name")], "label").select("s_suppkey", "label")


@query(
    """
WITH u AS (SELECT s_nationkey AS nat, s_name AS name, 0 AS src FROM supplier UNION ALL SELECT c_nationkey, c_name, 1 FROM customer),
k AS (SELECT *, row_number() OVER (PARTITION BY nat ORDER BY src, name) AS k FROM u) SELECT nat, name FROM k WHERE k = 1
"""
)
def prioritised_union(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nat"), F.col("s_name").alias("name"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nat"), F.col("c_name").alias("name"))
    return J.prioritised_union([s, c], ["nat"], F.asc("name"))


@query(
    """
WITH g AS (SELECT c_custkey, y AS yr FROM (SELECT DISTINCT c_custkey FROM customer), range(1995, 2002) t(y)),
f AS (SELECT o_custkey, year(o_orderdate)::BIGINT AS yr, count(*) AS n, min(o_orderstatus) AS first_status FROM orders GROUP BY 1, 2)
SELECT c_custkey, g.yr, coalesce(n, 0) AS n, coalesce(first_status, '-') AS first_status FROM g LEFT JOIN f ON o_custkey = c_custkey AND f.yr = g.yr
"""
)
def dense_year_grid(spark, d):
    facts = orders(spark, d).groupBy(F.col("o_custkey").alias("c_custkey"), "yr").agg(F.count("*").alias("n"), F.min("o_orderstatus").alias("first_status"))
    x = J.dense_grid(table(spark, d, "customer"), range(1995, 2002), facts, ["c_custkey"], "yr", {"n": 0, "first_status": "-"})
    return x.withColumn("yr", F.col("yr").cast("long"))


@query(
    """
WITH w AS (SELECT l_suppkey, l_partkey % 20 AS k, l_orderkey FROM lineitem),
f AS (SELECT l_orderkey, list(DISTINCT l_suppkey % 10) AS held FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, o_custkey, [o_custkey % 10, (o_custkey + 1) % 10] AS wanted FROM orders)
SELECT o_orderkey, min(l_orderkey) AS file FROM o JOIN f ON l_orderkey % 100 = o_orderkey % 100 AND list_has_all(held, wanted) GROUP BY 1
"""
)
def contains_all_link(spark, d):
    f = lines(spark, d).groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 10).alias("held")).select((F.col("l_orderkey") % 100).alias("slot"), F.col("l_orderkey").alias("file"), "held")
    o = orders(spark, d).select("o_orderkey", (F.col("o_orderkey") % 100).alias("slot"), F.array(F.col("o_custkey") % 10, (F.col("o_custkey") + 1) % 10).alias("wanted"))
    return J.holds_all(o, f, ["slot"], "wanted", "held", "file").select("o_orderkey", "file")


@query(
    """
WITH a AS (SELECT n_name AS alias, r_name AS canonical, CASE WHEN n_nationkey % 2 = 0 THEN 'BUILDING' END AS seg FROM nation JOIN region ON n_regionkey = r_regionkey
           UNION ALL SELECT n_name, 'plain ' || n_name, NULL FROM nation WHERE n_nationkey % 4 = 0),
c AS (SELECT c_custkey, n_name AS nm, c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey),
h AS (SELECT c_custkey, canonical, row_number() OVER (PARTITION BY c_custkey ORDER BY (a.seg IS NOT NULL)::INT DESC, canonical) AS k FROM c JOIN a ON c.nm = a.alias AND (a.seg IS NULL OR a.seg = c.seg))
SELECT c.c_custkey, c.nm, c.seg, coalesce(canonical, nm) AS team FROM c LEFT JOIN h ON h.c_custkey = c.c_custkey AND k = 1
"""
)
def scoped_alias(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    a = n.select(F.col("n_name").alias("alias"), F.col("r_name").alias("canonical"), F.when(F.col("n_nationkey") % 2 == 0, "BUILDING").alias("seg"))
    a = a.unionByName(n.where("n_nationkey % 4 = 0").select(F.col("n_name").alias("alias"), F.concat(F.lit("plain "), "n_name").alias("canonical"), F.lit(None).cast("string").alias("seg")))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("nm"), F.col("c_mktsegment").alias("seg"))
    return J.scoped_alias(c, a, "nm", ["seg"], "team")


@query(
    """
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity AS x0, l_quantity + 5 AS x1 FROM lineitem),
k AS (SELECT i AS "column", i * 10.0 AS c0, i * 10.0 + 10 AS c1 FROM range(0, 6) t(i)),
j AS (SELECT c.*, k."column", least(x1, c1) - greatest(x0, c0) AS overlap, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, x0 ORDER BY least(x1, c1) - greatest(x0, c0) DESC, k."column") AS n FROM c JOIN k ON least(x1, c1) > greatest(x0, c0))
SELECT l_orderkey, l_partkey, l_suppkey, x0, "column", overlap::DOUBLE AS overlap FROM j WHERE n = 1 GROUP BY ALL
"""
)
def best_overlap(spark, d):
    c = lines(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 5).alias("x1"), F.col("l_linenumber").alias("page"))
    k = spark.range(6).select(F.explode(F.lit(list(range(1, 8)))).alias("page"), F.col("id").alias("column"), (F.col("id") * 10.0).alias("c0"), (F.col("id") * 10.0 + 10).alias("c1"))
    return J.best_overlap(c, F.broadcast(k), ["page"]).select("l_orderkey", "l_partkey", "l_suppkey", "x0", "column", "overlap").distinct()


@query(
    """
WITH p AS (SELECT DISTINCT least(a.l_suppkey, b.l_suppkey) || '-' || greatest(a.l_suppkey, b.l_suppkey) AS pair, year(o_orderdate)::BIGINT AS yr
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey JOIN orders ON o_orderkey = a.l_orderkey)
SELECT pair, min(yr) AS first_year, max(yr) AS last_year, count(*) AS seasons FROM p GROUP BY 1 HAVING count(*) >= 2
"""
)
def pair_continuation(spark, d):
    from ..functions.keys import pair_key

    x = lines(spark, d).select("l_orderkey", "l_suppkey").distinct().join(orders(spark, d).select(F.col("o_orderkey").alias("l_orderkey"), "yr"), "l_orderkey")
    p = J.partners(x, ["l_orderkey", "yr"], "l_suppkey").select(pair_key(F.col("l_suppkey"), F.col("partner")).alias("pair"), "yr").distinct()
    return p.groupBy("pair").agg(F.min("yr").alias("first_year"), F.max("yr").alias("last_year"), F.count("*").alias("seasons")).where("seasons >= 2")
