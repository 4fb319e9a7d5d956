"""Queries of grouped results: orders are matches (status F won, O lost, P drawn), customers and suppliers are players."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import decay_weight
from ..operators import aggregates as A
from ..operators import ranking as R
from ..operators.joins import meetings, partners
from ..sources.tables import table
from .registry import query, rate_sql


def outcome() -> Column:
    return F.when(F.col("o_orderstatus") == "F", "win").when(F.col("o_orderstatus") == "O", "lose").otherwise("draw")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("yr", F.year("o_orderdate").cast("long"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("yr", F.year("l_shipdate").cast("long"))


@query(
    f"""
WITH f AS (
  SELECT o_custkey, year(o_orderdate)::BIGINT AS yr, count(*) FILTER (WHERE o_orderstatus = 'F') AS wins, count(*) FILTER (WHERE o_orderstatus = 'O') AS losses
  FROM orders GROUP BY 1, 2
), r AS (SELECT *, wins + losses AS total, {rate_sql("wins", "wins + losses")} AS win_rate FROM f)
SELECT *, rank() OVER (PARTITION BY yr ORDER BY win_rate DESC, wins DESC) AS rnk FROM r WHERE total > 0
"""
)
def win_loss_by_year(spark, d):
    won = A.fold_results(orders(spark, d), ["o_custkey", "yr"], outcome()).where("total > 0")
    return R.competition_rank(won, ["yr"], F.desc("win_rate"), F.desc("wins")).withColumn("rnk", F.col("rnk").cast("long"))


@query(
    f"""
WITH g AS (SELECT o_custkey, sum(o_orderkey % 7)::BIGINT AS won, sum(o_orderkey % 5)::BIGINT AS lost FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
every AS (SELECT DISTINCT o_custkey FROM orders)
SELECT e.o_custkey, coalesce(won, 0) AS won, coalesce(lost, 0) AS lost, {rate_sql("coalesce(won, 0)", "coalesce(won + lost, 0)")} AS game_rate FROM every e LEFT JOIN g ON e.o_custkey = g.o_custkey
"""
)
def games_fold(spark, d):
    return A.fold_games(orders(spark, d), ["o_custkey"], F.col("o_orderkey") % 7, F.col("o_orderkey") % 5, F.col("o_orderstatus") != "P")


@query(
    """
SELECT l_suppkey, CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE l_returnflag END AS l_returnflag, count(*) AS n, sum(l_quantity)::BIGINT AS qty, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day
FROM lineitem GROUP BY GROUPING SETS ((l_suppkey), (l_suppkey, l_returnflag))
"""
)
def career_rollup(spark, d):
    return A.roll_up(lines(spark, d), ["l_suppkey"], "l_returnflag", [F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.min("l_shipdate").alias("first_day"), F.max("l_shipdate").alias("last_day")])


@query(
    f"""
WITH s AS (
  SELECT o_custkey, year(o_orderdate)::BIGINT AS yr, count(*) FILTER (WHERE o_orderstatus = 'F') AS wins, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS total FROM orders GROUP BY 1, 2
), r AS (SELECT *, {rate_sql("wins", "total")} AS win_rate FROM s WHERE total >= 2),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY win_rate DESC, yr) AS k FROM r)
SELECT o_custkey, yr, wins, total, win_rate FROM n WHERE k = 1
"""
)
def best_season_having(spark, d):
    return A.best_season(orders(spark, d), ["o_custkey"], "yr", F.col("o_orderstatus") == "F", F.col("o_orderstatus").isin("F", "O"), 2)


@query(
    """
WITH x AS (SELECT l_orderkey, l_suppkey, min(l_shipdate) AS day FROM lineitem GROUP BY 1, 2)
SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS meetings, min(a.day) AS first_day, max(a.day) AS last_day
FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2
"""
)
def head_to_head(spark, d):
    return meetings(lines(spark, d), ["l_orderkey"], "l_suppkey", "l_shipdate")


@query(
    """
WITH x AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
p AS (SELECT a.l_suppkey, b.l_suppkey AS partner, count(*) AS together FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2)
SELECT l_suppkey, count(*) AS n_partners, sum(together)::BIGINT AS together, max(together) AS most FROM p GROUP BY 1
"""
)
def partner_agg(spark, d):
    p = partners(lines(spark, d), ["l_orderkey"], "l_suppkey").groupBy("l_suppkey", "partner").agg(F.count("*").alias("together"))
    return p.groupBy("l_suppkey").agg(F.count("*").alias("n_partners"), F.sum("together").alias("together"), F.max("together").alias("most"))


@query(
    """
WITH o AS (SELECT o_custkey % 500 AS grp, year(o_orderdate)::BIGINT AS yr, count(*) AS n_orders FROM orders GROUP BY 1, 2),
l AS (SELECT l_suppkey % 500 AS grp, year(l_shipdate)::BIGINT AS yr, count(*) AS n_lines, max(l_quantity) AS best FROM lineitem GROUP BY 1, 2)
SELECT coalesce(o.grp, l.grp) AS grp, coalesce(o.yr, l.yr) AS yr, coalesce(n_orders, 0) AS n_orders, coalesce(n_lines, 0) AS n_lines, best
FROM o FULL OUTER JOIN l ON o.grp = l.grp AND o.yr = l.yr
"""
)
def by_year_full_outer(spark, d):
    o = orders(spark, d).groupBy((F.col("o_custkey") % 500).alias("grp"), "yr").agg(F.count("*").alias("n_orders"))
    x = lines(spark, d).groupBy((F.col("l_suppkey") % 500).alias("grp"), "yr").agg(F.count("*").alias("n_lines"), F.max("l_quantity").alias("best"))
    return A.merge_groups(o, x, ["grp", "yr"], ["n_orders", "n_lines"])


@query(
    """
SELECT l_suppkey, count(DISTINCT (year(l_shipdate), l_returnflag)) AS appearances, array_to_string(list_sort(list(DISTINCT year(l_shipdate))), ',') AS seasons FROM lineitem GROUP BY 1
"""
)
def distinct_appearances(spark, d):
    x = A.appearances(lines(spark, d), ["l_suppkey"], ["yr", "l_returnflag"], F.col("yr"))
    return x.withColumn("seasons", F.array_join(F.transform("seasons", lambda y: y.cast("string")), ","))


@query(
    """
WITH n AS (SELECT l_suppkey, year(l_shipdate)::BIGINT AS yr, l_extendedprice AS s, row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate) ORDER BY l_extendedprice DESC) AS k FROM lineitem)
SELECT l_suppkey, yr, floor(sum(s) * 1000 + 0.5) / 1000.0 AS points, count(*) AS counted FROM n WHERE k <= 3 GROUP BY 1, 2
"""
)
def top_n_sum(spark, d):
    return A.top_n_sum(lines(spark, d), ["l_suppkey", "yr"], F.col("l_extendedprice"))


@query(
    """
WITH e AS (SELECT l_suppkey, year(l_shipdate)::BIGINT AS yr, l_quantity AS s, row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate) ORDER BY l_quantity DESC) AS k FROM lineitem),
p AS (SELECT l_suppkey, yr, floor(sum(s) * 1000 + 0.5) / 1000.0 AS points, count(*) AS counted, max(s) AS best FROM e WHERE k <= 3 GROUP BY 1, 2)
SELECT *, rank() OVER (PARTITION BY yr ORDER BY points DESC, best DESC) AS rnk FROM p
"""
)
def season_leaderboard(spark, d):
    return R.season_points(lines(spark, d), "l_suppkey", ["yr"], F.col("l_quantity")).withColumn("rnk", F.col("rnk").cast("long"))


@query(
    """
SELECT s_suppkey, s_nationkey, s_acctbal, rank() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000 * 1 + 0.5) DESC) AS rnk FROM supplier
"""
)
def competition_rank(spark, d):
    s = table(spark, d, "supplier").withColumn("thousands", F.col("s_acctbal") / 1000)
    return R.rank_of_rounded(s, ["s_nationkey"], "thousands", 0).select("s_suppkey", "s_nationkey", "s_acctbal", F.col("rnk").cast("long").alias("rnk"))


@query(
    """
WITH m AS (
  SELECT r_name, n_name, sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS score FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
), k AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY score DESC, n_name) AS w FROM m)
SELECT r_name, sum(score)::BIGINT AS score, count(*) AS members, min(n_name) FILTER (WHERE w = 1) AS best_n_name FROM k GROUP BY 1
"""
)
def region_rollup_arg_first(spark, d):
    x = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return A.roll_up_boards(x, ["n_name"], "r_name", F.round(F.col("c_acctbal") * 100).cast("long"))[1]


@query(
    f"""
WITH c AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS r, sum(n) OVER (PARTITION BY l_suppkey) AS whole FROM c)
SELECT l_suppkey, l_partkey, n, {rate_sql("n", "whole")} AS share FROM k WHERE r = 1
"""
)
def modal_value(spark, d):
    return A.modal_value(lines(spark, d), ["l_suppkey"], "l_partkey")


@query(
    f"""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n, {rate_sql("n", "sum(n) OVER (PARTITION BY user_id)")} AS share FROM c
"""
)
def share_of_total(spark, d):
    return A.share_of_total(table(spark, d, "events"), ["user_id"], "event_type")


@query(
    f"""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r, sum(n) OVER (PARTITION BY user_id) AS whole FROM c),
s AS (SELECT user_id, event_type, n, {rate_sql("n", "whole")} AS share FROM k WHERE r = 1)
SELECT * FROM s WHERE n >= 5 AND share >= 0.25
"""
)
def dominant_share(spark, d):
    return A.dominant_value(table(spark, d, "events"), ["user_id"], "event_type", 5, 0.25)


@query(
    """
SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS won, count(*) FILTER (WHERE o_orderstatus = 'O') AS lost, count(*) FILTER (WHERE o_orderstatus = 'P') AS drawn,
       (count(*) FILTER (WHERE o_orderstatus = 'F') * 10.0 + count(*) FILTER (WHERE o_orderstatus = 'O') * 2.0 + count(*) FILTER (WHERE o_orderstatus = 'P') * 0.5)::DOUBLE AS points
FROM orders GROUP BY 1
"""
)
def pivot_results(spark, d):
    return A.pivot_counts(orders(spark, d), ["o_custkey"], "o_orderstatus", {"F": "won", "O": "lost", "P": "drawn"}, {"F": 10, "O": 2, "P": 0.5})


@query(
    f"""
SELECT l_suppkey, count(*) AS entries, {rate_sql("count(*) FILTER (WHERE l_quantity >= 48)", "count(*)")} AS final_rate, {rate_sql("count(*) FILTER (WHERE l_quantity >= 40)", "count(*)")} AS semifinal_rate FROM lineitem GROUP BY 1
"""
)
def reach_rates(spark, d):
    return A.reach_rates(lines(spark, d), ["l_suppkey"], {"final_rate": F.col("l_quantity") >= 48, "semifinal_rate": F.col("l_quantity") >= 40})


@query(
    """
WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, string_agg(o_orderstatus || ' x ' || n, ', ' ORDER BY o_orderstatus) AS histogram FROM c GROUP BY 1
"""
)
def histogram_text(spark, d):
    return A.histogram_text(orders(spark, d), ["o_custkey"], "o_orderstatus")


@query(
    """
WITH v AS (SELECT s_nationkey, lower(s_name) AS v FROM supplier UNION SELECT s_nationkey, lower(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_nationkey, string_agg(v, ' ' ORDER BY v) AS found_by FROM v GROUP BY 1
"""
)
def search_text(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return A.search_text(s, ["s_nationkey"], ["s_name", "n_name"])


@query(
    """
SELECT l_orderkey, bool_and(l_discount <= 0.05) FILTER (WHERE l_returnflag = 'R') AS perfect FROM lineitem GROUP BY 1
"""
)
def perfect_universal(spark, d):
    return A.all_hold(lines(spark, d), ["l_orderkey"], F.col("l_discount") <= 0.05, F.col("l_returnflag") == "R")


@query(
    f"""
WITH x AS (SELECT o_custkey, o_orderkey, o_orderpriority AS p, o_orderstatus = 'F' AS dn FROM orders)
SELECT o_custkey, count(*) AS matches, count(*) FILTER (WHERE dn) AS decided, max_by(p, o_orderkey) FILTER (WHERE dn) AS deepest_decided, min_by(p, o_orderkey) FILTER (WHERE NOT dn) AS shallowest_open,
       {rate_sql("count(*) FILTER (WHERE dn)", "count(*)")} AS coverage,
       CASE WHEN count(*) FILTER (WHERE dn) = 0 THEN 'upcoming' WHEN count(*) FILTER (WHERE dn) < count(*) THEN 'in progress' ELSE 'complete' END AS status
FROM x GROUP BY 1
"""
)
def coverage_status(spark, d):
    return A.coverage(orders(spark, d), ["o_custkey"], F.col("o_orderstatus") == "F", F.col("o_orderkey"), "o_orderpriority")


@query(
    """
WITH m AS (SELECT l_suppkey AS a, l_partkey % 100 AS b, l_quantity > 25 AS w, l_linestatus AS kind FROM lineitem),
s AS (SELECT a AS side, w AS won, kind FROM m UNION ALL SELECT b, NOT w, kind FROM m)
SELECT s_suppkey, count(*) FILTER (WHERE kind = 'O' AND won) AS "O_wins", count(*) FILTER (WHERE kind = 'O' AND NOT won) AS "O_losses", count(*) FILTER (WHERE kind = 'F' AND won) AS "F_wins", count(*) FILTER (WHERE kind = 'F' AND NOT won) AS "F_losses"
FROM supplier LEFT JOIN s ON s_suppkey = side GROUP BY 1
"""
)
def roster_results(spark, d):
    m = lines(spark, d).select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b"), (F.col("l_quantity") > 25).alias("w"), "l_linestatus")
    return A.roster_results(table(spark, d, "supplier"), "s_suppkey", A.both_sides(m, "a", "b", F.col("w"), "l_linestatus"), "l_linestatus", ["O", "F"])


@query(
    f"""
WITH c AS (SELECT year(l_shipdate)::BIGINT AS yr, count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'R') AS "R", count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'A') AS "A", count(DISTINCT (l_returnflag, l_suppkey)) AS n FROM lineitem GROUP BY 1)
SELECT yr, "R", "A", {rate_sql('"R"', "n")} AS "R_share", {rate_sql('"A"', "n")} AS "A_share" FROM c
"""
)
def affiliation_shares(spark, d):
    return A.transitions(lines(spark, d), "yr", "l_returnflag", "l_suppkey", ["R", "A"])


@query(
    """
WITH x AS (SELECT o_custkey, year(o_orderdate)::BIGINT AS yr, count(*) AS n FROM orders GROUP BY 1, 2),
w AS (SELECT o_custkey, sum(n * CASE 2001 - yr WHEN 0 THEN 10 WHEN 1 THEN 8 WHEN 2 THEN 6 ELSE 3 END)::BIGINT AS t FROM x GROUP BY 1)
SELECT o_custkey, t / 10.0 AS points, row_number() OVER (ORDER BY t DESC, o_custkey) AS place FROM w ORDER BY t DESC, o_custkey LIMIT 100
"""
)
def weighted_board_top100(spark, d):
    n = orders(spark, d).groupBy("o_custkey", "yr").agg(F.count("*").alias("n"))
    tenths = F.round(decay_weight(F.lit(2001) - F.col("yr")) * 10).cast("long") * F.col("n")
    top = n.groupBy("o_custkey").agg(F.sum(tenths).alias("t")).orderBy(F.desc("t"), "o_custkey").limit(100)
    return R.top_k(top.withColumn("__one", F.lit(1)), ["__one"], 100, F.desc("t"), F.asc("o_custkey")).select("o_custkey", (F.col("t") / 10.0).alias("points"), F.col("place").cast("long").alias("place"))
