"""Queries of titles by a list of tournaments: parts of 25 kinds are tournaments, nations of four regions are the list."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import titles as T
from ..sources.tables import table
from .registry import query
from .results import lines

_LIST = ("AFRICA", "ASIA", "EUROPE", "AMERICA")
_ORDER = ("EUROPE", "ASIA", "AFRICA")
_ENTRIES = """
WITH n AS (SELECT l_suppkey % 500 AS person, l_partkey % 25 AS tournament, l_returnflag AS category, CASE l_linenumber WHEN 7 THEN '' ELSE l_linestatus END AS discipline, year(l_shipdate)::INT AS year, CASE WHEN l_linenumber <> 6 THEN l_shipdate::DATE END AS date, l_orderkey * 8 + l_linenumber AS entry,
  CASE WHEN l_quantity >= 46 THEN 'winner' WHEN l_quantity >= 42 THEN 'runnerup' WHEN l_quantity >= 35 THEN 'best4' WHEN l_quantity >= 25 THEN 'best8' ELSE 'round' END AS placement FROM lineitem),
k AS (SELECT n_nationkey AS tournament, n_name AS label, substr(n_name, 1, 4) AS short, CASE WHEN r_name <> 'AMERICA' THEN r_name END AS major FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('AFRICA', 'ASIA', 'EUROPE', 'AMERICA')),
e AS (SELECT * FROM n JOIN k USING (tournament))"""
_TITLES = f"""{_ENTRIES},
w AS (SELECT * FROM e WHERE placement = 'winner'),
y AS (SELECT *, year - row_number() OVER (PARTITION BY person, tournament, category ORDER BY year) AS g FROM (SELECT DISTINCT person, tournament, category, year FROM w)),
s AS (SELECT *, row_number() OVER (PARTITION BY person, tournament, category, g ORDER BY year)::INT AS streak FROM y),
t AS (SELECT w.*, row_number() OVER (PARTITION BY person, tournament, category ORDER BY year, date NULLS FIRST, entry)::INT AS nth, streak > 1 AS defended, streak FROM w JOIN s USING (person, tournament, category, year))"""


def _entries(spark, d):
    q = F.col("l_quantity")
    placement = F.when(q >= 46, "winner").when(q >= 42, "runnerup").when(q >= 35, "best4").when(q >= 25, "best8").otherwise("round")
    x = lines(spark, d).select(
        (F.col("l_suppkey") % 500).alias("person"),
        (F.col("l_partkey") % 25).alias("tournament"),
        F.col("l_returnflag").alias("category"),
        F.when(F.col("l_linenumber") == 7, "").otherwise(F.col("l_linestatus")).alias("discipline"),
        F.year("l_shipdate").alias("year"),
        F.when(F.col("l_linenumber") != 6, F.to_date("l_shipdate")).alias("date"),
        placement.alias("placement"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("entry"),
    )
    region = table(spark, d, "region").where(F.col("r_name").isin(*_LIST))
    listed = table(spark, d, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return x, listed.select(F.col("n_nationkey").alias("tournament"), F.col("n_name").alias("label"), F.substring("n_name", 1, 4).alias("short"), F.when(F.col("r_name") != "AMERICA", F.col("r_name")).alias("major"))


@query(f"{_TITLES} SELECT person, tournament, label, short, category, discipline, year, date, entry, nth, defended, streak FROM t")
def listed_titles(spark, d):
    return T.listed_titles(*_entries(spark, d))


@query(
    f"""{_TITLES},
d AS (SELECT person, tournament, discipline, max((year, coalesce(date, DATE '0001-01-01'), entry)) AS latest FROM t GROUP BY 1, 2, 3),
g AS (SELECT person, tournament, any_value(label) AS label, any_value(short) AS short, count(*) AS count, array_to_string(list_sort(list(DISTINCT year), 'DESC'), ',') AS years FROM t GROUP BY 1, 2),
o AS (SELECT person, tournament, coalesce(string_agg(discipline, ',' ORDER BY latest DESC) FILTER (WHERE discipline <> ''), '') AS disciplines, max(latest) AS latest FROM d GROUP BY 1, 2)
SELECT g.*, disciplines, short || ' winner' || CASE WHEN count > 1 THEN ' ' || count || ' times' ELSE '' END AS badge, row_number() OVER (PARTITION BY person ORDER BY latest DESC, tournament)::INT AS place FROM g JOIN o USING (person, tournament)
"""
)
def title_groups(spark, d):
    x = T.title_groups(T.listed_titles(*_entries(spark, d)))
    return x.withColumn("years", F.array_join(F.transform("years", lambda y: y.cast("string")), ",")).withColumn("disciplines", F.array_join("disciplines", ","))


@query(
    f"""{_ENTRIES},
m AS (SELECT *, list_position(['winner', 'runnerup', 'best4', 'best8'], placement)::INT AS rank, list_position(['EUROPE', 'ASIA', 'AFRICA'], major) AS known FROM e WHERE major IS NOT NULL AND placement <> 'round')
SELECT person, tournament, label, short, major, category, discipline, year, date, entry, placement, rank, row_number() OVER (PARTITION BY person, major ORDER BY rank, year DESC, date DESC NULLS LAST, entry, tournament, category)::INT AS place, dense_rank() OVER (PARTITION BY person ORDER BY known)::INT AS group_place FROM m
"""
)
def major_results(spark, d):
    return T.major_results(*_entries(spark, d), _ORDER)


@query(
    f"""{_ENTRIES},
f AS (SELECT person, 'first_listed' AS event, tournament, label, category, year, date, coalesce(date, DATE '0001-01-01') AS since, entry FROM e UNION ALL SELECT person, 'first_listed_title', tournament, label, category, year, date, coalesce(date, DATE '0001-01-01'), entry FROM e WHERE placement = 'winner')
SELECT person, event, tournament, label, category, year, date FROM f QUALIFY row_number() OVER (PARTITION BY person, event ORDER BY since, entry, tournament, category) = 1
"""
)
def first_listed(spark, d):
    return T.firsts(*_entries(spark, d))
