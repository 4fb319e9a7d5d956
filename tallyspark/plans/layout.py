"""Queries of tables from placed characters: a user's events are the characters of a page, eight a line in three blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import layout as Y
from ..sources.tables import table
from .registry import query

_CHARS = """
WITH RECURSIVE e AS (SELECT *, floor(value)::BIGINT AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
g AS (SELECT user_id AS page, (i % 8 * 14 + i % 8 // 3 * 12 + event_id % 3)::DOUBLE AS x0, (i % 8 * 14 + i % 8 // 3 * 12 + event_id % 3 + 9)::DOUBLE AS x1, i // 8 * 9 + v % 4 * 1.25::DOUBLE AS top,
  CASE WHEN event_id % 23 = 0 THEN 16.0 WHEN event_id % 11 = 0 THEN 5.0 ELSE 10.0 END::DOUBLE AS size, upper(event_type[1]) AS text FROM e),
c AS (SELECT *, round_even(top / 3, 0)::BIGINT AS line FROM g),
z AS (SELECT page, size, count(*) AS n FROM c GROUP BY 1, 2), u AS (SELECT page, arg_min(size, (-n, size)) AS usual, sum(n) AS all_n FROM z GROUP BY 1),
zh AS (SELECT page, size, n, all_n, size > usual * 1.3::DOUBLE AND n < all_n * 0.1::DOUBLE AS heading FROM z JOIN u USING (page)), zg AS (SELECT *, all_n - sum(CASE WHEN heading THEN n ELSE 0 END) OVER (PARTITION BY page) AS rest FROM zh),
body AS (SELECT c.* FROM c JOIN zg USING (page, size) WHERE NOT heading OR rest < all_n * 0.5::DOUBLE),
ln AS (SELECT page, count(DISTINCT line) AS lines FROM body GROUP BY 1),
cv AS (SELECT page, px, count(DISTINCT line) AS used FROM (SELECT page, line, unnest(generate_series(ceil(x0)::BIGINT, floor(x1)::BIGINT)) AS px FROM body) GROUP BY 1, 2),
ac AS (SELECT page, px, px - lag(px) OVER (PARTITION BY page ORDER BY px) AS step FROM cv JOIN ln USING (page) WHERE used >= greatest(2, lines * 0.04::DOUBLE)),
rn AS (SELECT page, px, sum(CASE WHEN step <= 6 THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY px) - 1 AS "column" FROM ac),
k AS (SELECT page, "column"::BIGINT AS "column", min(px)::DOUBLE AS c0, max(px)::DOUBLE AS c1 FROM rn GROUP BY 1, 2)
"""


def _chars(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, d, "events").withColumn("i", (F.row_number().over(w) - 1).cast("long"))
    slot = F.col("i") % 8
    left = (slot * 14 + F.floor(slot / 3) * 12 + F.col("event_id") % 3).cast("double")
    size = F.when(F.col("event_id") % 23 == 0, 16.0).when(F.col("event_id") % 11 == 0, 5.0).otherwise(10.0)
    return x.select(F.col("user_id").alias("page"), left.alias("x0"), (left + 9).alias("x1"), (F.floor(F.col("i") / 8) * 9 + F.floor("value") % 4 * 1.25).cast("double").alias("top"), size.alias("size"), F.upper(F.substring("event_type", 1, 1)).alias("text"))


@query(_CHARS + 'SELECT page, "column", c0, c1 FROM k')
def table_columns(spark, d):
    """Columns of every page by the votes of its lines."""
    return Y.table_columns(Y.body_characters(_chars(spark, d), ["page"]), ["page"])


@query(
    _CHARS
    + """,
o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY top, x0, x1, text, size) AS n, size < 6.5 OR coalesce(lag(size) OVER (PARTITION BY page ORDER BY top, x0, x1, text, size) < 6.5, false) AS loose FROM body),
w AS (SELECT page, n, top AS anchor, 1::BIGINT AS "row" FROM o WHERE n = 1
  UNION ALL SELECT o.page, o.n, CASE WHEN o.top - anchor > CASE WHEN loose THEN 4 ELSE 3 END THEN o.top ELSE anchor END, "row" + CASE WHEN o.top - anchor > CASE WHEN loose THEN 4 ELSE 3 END THEN 1 ELSE 0 END FROM w JOIN o ON o.page = w.page AND o.n = w.n + 1),
a AS (SELECT o.*, "row", min(top) OVER (PARTITION BY o.page, "row") AS row_top FROM o JOIN w ON o.page = w.page AND o.n = w.n),
b AS (SELECT a.*, "column", row_number() OVER (PARTITION BY a.page, n ORDER BY greatest(c0 - x1, x0 - c1, 0), CASE WHEN least(x1, c1) > greatest(x0, c0) THEN greatest(x0, c0) - least(x1, c1) END NULLS LAST,
    CASE WHEN least(x1, c1) > greatest(x0, c0) THEN "column" ELSE -"column" END) AS place, greatest(c0 - x1, x0 - c1, 0) AS off FROM a JOIN k ON k.page = a.page)
SELECT page, "row", row_top AS top, "column", trim(string_agg(text, '' ORDER BY x0, text, n)) AS text FROM b WHERE place = 1 AND off <= 5 GROUP BY page, "row", row_top, "column"
"""
)
def table_cells(spark, d):
    """Rows and cells of every page."""
    body = Y.body_characters(_chars(spark, d), ["page"])
    return Y.table_cells(Y.table_rows(body, ["page"]), Y.table_columns(body, ["page"]), ["page"], tolerance=5)


@query(
    _CHARS
    + """,
pg AS (SELECT page, min(x0) + (max(x1) - min(x0)) * 0.3::DOUBLE AS lo, min(x0) + (max(x1) - min(x0)) * 0.7::DOUBLE AS hi, count(*) AS n, count(DISTINCT line) AS lines FROM c GROUP BY 1),
tk AS (SELECT page, px, count(DISTINCT line) AS used FROM (SELECT page, line, unnest(generate_series(ceil(x0 - lo)::BIGINT, floor(x1 - lo)::BIGINT)) AS px FROM c JOIN pg USING (page)) GROUP BY 1, 2),
un AS (SELECT page, lo, lines, unnest(generate_series(0, floor(hi - lo)::BIGINT)) AS px FROM pg WHERE n >= 20 AND lines >= 5),
fr AS (SELECT page, lo, px, px - row_number() OVER (PARTITION BY page ORDER BY px) AS run FROM un LEFT JOIN tk USING (page, px) WHERE lines - coalesce(used, 0) >= lines * 0.9::DOUBLE),
vt AS (SELECT page, lo + (min(px) + max(px)) / 2 AS split FROM fr GROUP BY page, lo, run HAVING max(px) - min(px) >= 8 QUALIFY row_number() OVER (PARTITION BY page ORDER BY max(px) - min(px) DESC, min(px)) = 1),
mx AS (SELECT page, x0, x1, max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, min(x0) OVER (PARTITION BY page) AS l, max(x1) OVER (PARTITION BY page) AS r FROM body WHERE page NOT IN (SELECT page FROM vt)),
gp AS (SELECT page, (reach + x0) / 2 AS mid, abs((reach + x0) / 2 - (l + r) / 2) AS off FROM mx WHERE x0 - reach >= 15 AND abs((reach + x0) / 2 - (l + r) / 2) <= (r - l) * 0.25),
gb AS (SELECT page, arg_min(mid, (off, mid)) AS split FROM gp GROUP BY 1)
SELECT page, coalesce(vt.split, gb.split) AS split FROM pg LEFT JOIN vt USING (page) LEFT JOIN gb USING (page)
"""
)
def page_sides(spark, d):
    """Where every page divides into two sides."""
    return Y.side_split(_chars(spark, d), ["page"])
