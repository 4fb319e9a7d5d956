"""Queries of dictionaries, labels of titles and rounds, turns on court, and profiles of both sides of a match."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..operators import points as P
from ..operators import terms as T
from ..sources.tables import table
from .guidance import _POINTS, _log
from .registry import query


@query(
    r"""
WITH w AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark),
k AS (SELECT array_to_string(ws[1:n], ' ') AS phrase, n, min(item_id) AS label FROM w, (SELECT unnest([1, 2, 3, 5]) AS n) WHERE len(ws) >= n GROUP BY 1, 2),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
r AS (SELECT doc_id, n, unnest(range(0, len(ws) - n + 1)) AS place, ws FROM d, (SELECT DISTINCT n FROM k)),
h AS (SELECT doc_id, place, r.n, phrase, label FROM r JOIN k ON k.n = r.n AND k.phrase = array_to_string(ws[place + 1:place + r.n], ' '))
SELECT doc_id, place, n AS n_words, phrase, label FROM h
QUALIFY coalesce(max(place + n) OVER (PARTITION BY doc_id ORDER BY place, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) < place + n
"""
)
def dictionary_hits(spark, d):
    """Where openings of benchmark items, of 1 to 5 words, stand in documents; the longest holds."""
    w = table(spark, d, "benchmark").select("item_id", T.words(F.col("text")).alias("w"))
    openings = w.select("item_id", "w", F.explode(F.array(*map(F.lit, (1, 2, 3, 5)))).alias("n")).where(F.size("w") >= F.col("n"))
    terms = openings.select("item_id", F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("term"))
    return T.dictionary_hits(table(spark, d, "documents"), "doc_id", "text", terms, "term", "item_id")


_TITLE = """CASE p_partkey % 8 WHEN 0 THEN 'Boys Singles 2023 ' || p_name WHEN 1 THEN 'WOMEN double' WHEN 2 THEN '令和' || p_size || '年 高校総体 男子団体' WHEN 3 THEN '混合ダブルス IH予選' WHEN 4 THEN NULL WHEN 5 THEN 'girls team ' || p_name WHEN 6 THEN '2' || p_size || ' mixed' ELSE p_name END"""


@query(
    rf"""
WITH t AS (SELECT p_partkey, {_TITLE} AS title FROM part)
SELECT p_partkey, title, coalesce(nullif(regexp_extract(title, '\b(20[0-9]{{2}})\b', 1), '')::INT, nullif(regexp_extract(title, '令和\s*([0-9]{{1,2}})\s*年', 1), '')::INT + 2018) AS year,
  CASE WHEN title ILIKE '%single%' THEN 'singles' WHEN title ILIKE '%double%' OR contains(title, 'ダブルス') THEN 'doubles' WHEN title ILIKE '%team%' OR contains(title, '団体') THEN 'team' ELSE 'unknown' END AS event,
  CASE WHEN contains(title, '男子') OR title ILIKE '%men%' OR title ILIKE '%boys%' THEN 'men' WHEN title ILIKE '%girls%' THEN 'women' WHEN contains(title, '混合') OR title ILIKE '%mixed%' THEN 'mixed' ELSE 'unknown' END AS category,
  CASE WHEN contains(title, '高校総体') OR contains(title, 'IH予選') THEN 'interhigh' END AS qualifier FROM t
"""
)
def title_labels(spark, d):
    k = F.col("p_partkey") % 8
    title = F.when(k == 0, F.concat(F.lit("Boys Singles 2023 "), "p_name")).when(k == 1, "WOMEN double").when(k == 2, F.concat(F.lit("令和"), F.col("p_size").cast("string"), F.lit("年 高校総体 男子団体"))).when(k == 3, "混合ダブルス IH予選")
    title = title.when(k == 4, None).when(k == 5, F.concat(F.lit("girls team "), "p_name")).when(k == 6, F.concat(F.lit("2"), F.col("p_size").cast("string"), F.lit(" mixed"))).otherwise(F.col("p_name"))
    x = table(spark, d, "part").select("p_partkey", title.alias("title"))
    return x.select("p_partkey", "title", X.title_labels(F.col("title")).alias("t")).select("p_partkey", "title", "t.*")


@query(
    r"""
WITH t AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_name || ' final' WHEN 1 THEN 'semifinal' WHEN 2 THEN 'the quarterfinal' WHEN 3 THEN 'round ' || p_size WHEN 4 THEN NULL WHEN 5 THEN '' WHEN 6 THEN 'final' ELSE p_name END AS label FROM part)
SELECT p_partkey, label, CASE WHEN coalesce(label, '') = '' THEN -1 WHEN regexp_matches(label, '\d') THEN regexp_extract(label, '\d+')::BIGINT WHEN contains(label, 'quarterfinal') THEN 8000 WHEN contains(label, 'semifinal') THEN 9000 WHEN contains(label, 'final') THEN 10000 ELSE 0 END::BIGINT AS coverage,
  CASE label WHEN 'final' THEN 0 WHEN 'semifinal' THEN 1 WHEN 'quarterfinal' THEN 2 ELSE CASE WHEN regexp_matches(label, '^round \d+$') THEN 100 - label[7:]::INT ELSE 1000 END END AS list_rank FROM t
"""
)
def round_labels(spark, d):
    """Two orders of rounds: by the longest name inside a label, and as a list from the final down."""
    k = F.col("p_partkey") % 8
    label = F.when(k == 0, F.concat("p_name", F.lit(" final"))).when(k == 1, "semifinal").when(k == 2, "the quarterfinal").when(k == 3, F.concat(F.lit("round "), F.col("p_size").cast("string"))).when(k == 4, None).when(k == 5, "").when(k == 6, "final").otherwise(F.col("p_name"))
    x = table(spark, d, "part").select("p_partkey", label.alias("label"))
    orders = dict(zip(L.LATE_NAMES, L.LATE_ROUNDS["coverage"], strict=True))
    return x.select("p_partkey", "label", L.contained_order(F.col("label"), orders).alias("coverage"), L.list_rank(F.col("label")).alias("list_rank"))


@query(
    """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
p AS (SELECT user_id AS match, n // 10 + 1 AS game, n % 10 + 1 AS point, (n // 10) % 3 = 2 AS final, CASE WHEN (n // 10) % 2 = 0 THEN 'A' ELSE 'B' END AS first, CASE WHEN user_id % 4 = 0 THEN 1 ELSE 2 END AS pa, CASE WHEN user_id % 5 = 0 THEN 1 ELSE 2 END AS pb,
  CASE user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 0 END AS s0, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS r0 FROM e),
s AS (SELECT *, CASE WHEN final AND ((point - 1) // 2) % 2 = 1 THEN CASE first WHEN 'A' THEN 'B' ELSE 'A' END ELSE first END AS serving FROM p),
v AS (SELECT *, CASE serving WHEN 'A' THEN 'B' ELSE 'A' END AS receiving FROM s),
c AS (SELECT *, count(*) OVER (PARTITION BY match, game, serving ORDER BY point ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS served, count(*) OVER (PARTITION BY match, game, receiving ORDER BY point ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS received FROM v)
SELECT match, game, point, serving, (CASE WHEN CASE serving WHEN 'A' THEN pa ELSE pb END = 1 THEN 0 ELSE (CASE WHEN serving = first THEN s0 ELSE 0 END + served // 2) % 2 END)::INT AS server,
  receiving, (CASE WHEN CASE receiving WHEN 'A' THEN pa ELSE pb END = 1 THEN 0 ELSE (CASE WHEN receiving <> first THEN r0 ELSE 0 END + received) % 2 END)::INT AS receiver FROM c
"""
)
def court_turns(spark, d):
    """Who serves and receives each point, without a window over points; the SQL counts."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, d, "events").withColumn("n", (F.row_number().over(w) - 1).cast("long")).withColumn("g", F.floor(F.col("n") / 10))
    u = F.col("user_id")
    x = x.select(u.alias("match"), (F.col("g") + 1).alias("game"), (F.col("n") % 10 + 1).alias("point"), (F.col("g") % 3 == 2).alias("final"), F.when(F.col("g") % 2 == 0, "A").otherwise("B").alias("first"), F.when(u % 4 == 0, 1).otherwise(2).alias("pa"), F.when(u % 5 == 0, 1).otherwise(2).alias("pb"), F.when(u % 3 == 0, 0).when(u % 3 == 1, 1).alias("s0"), F.when(u % 2 == 0, 1).alias("r0"))
    turn = L.court_turn(*map(F.col, ("point", "first", "final", "pa", "pb", "s0", "r0")))
    return x.select("match", "game", "point", turn.alias("t")).select("match", "game", "point", "t.*")


_RATES = {
    "on_serve": ("serves", "won"), "first_serve": ("serves AND NOT fault", "won"), "second_serve": ("serves AND fault", "won"), "on_return": ("NOT serves", "won"), "two_all": ("own = 2 AND other = 2", "won"), "deuce": ("own = other AND own >= target - 1", "won"),
    "game_point": ("own + 1 >= target AND own - other >= 1", "won"), "game_point_saved": ("other + 1 >= target AND other - own >= 1", "won"), "deciding_game": ("fin", "won"), "after_two_lost": ("lost_before >= 2", "won"),
    "short_rally": ("NOT df AND rally BETWEEN 1 AND 2", "won"), "middle_rally": ("NOT df AND rally BETWEEN 3 AND 5", "won"), "long_rally": ("NOT df AND rally > 5", "won"), "first_serve_in": ("serves", "NOT fault"), "double_fault": ("serves", "df"),
}
_PARTS = ", ".join(f"('{m}', count(*) FILTER (WHERE {w} AND {p}), count(*) FILTER (WHERE {w}))" for m, (w, p) in _RATES.items())


@query(
    _POINTS
    + f""",
gw AS (SELECT match, game, max(w) AS gwin FROM p GROUP BY 1, 2),
gs AS (SELECT *, count(*) FILTER (WHERE gwin = 'A') OVER q = 2 AND count(*) FILTER (WHERE gwin = 'B') OVER q = 2 AS fin FROM gw WINDOW q AS (PARTITION BY match ORDER BY game ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sd AS (SELECT *, w = side AS won, serving = side AS serves, CASE WHEN fin THEN 7 ELSE 4 END AS target, CASE side WHEN 'A' THEN a_before ELSE b_before END AS own, CASE side WHEN 'A' THEN b_before ELSE a_before END AS other FROM (SELECT b.*, gwin, fin, unnest(['A', 'B']) AS side FROM b JOIN gs USING (match, game))),
rn AS (SELECT *, count(*) FILTER (WHERE won) OVER (PARTITION BY match, side ORDER BY game, point ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM sd),
st AS (SELECT *, count(*) FILTER (WHERE NOT won) OVER (PARTITION BY match, side, run ORDER BY game, point ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lost_before FROM rn),
ld AS (SELECT match, side, game, max(own - other + CASE WHEN won THEN 1 WHEN NOT won THEN -1 ELSE 0 END) >= 2 AS led, max(gwin) = side AS held FROM st GROUP BY 1, 2, 3),
al AS (SELECT match, side, unnest([{_PARTS}, ('lost_three', count(*) FILTER (WHERE NOT won AND lost_before = 2), NULL), ('lost_four', count(*) FILTER (WHERE NOT won AND lost_before = 3), NULL), ('lost_longest', coalesce(max(lost_before + 1) FILTER (WHERE NOT won), 0), NULL)]) AS m FROM st GROUP BY 1, 2
  UNION ALL SELECT match, side, ('lead_held', count(*) FILTER (WHERE led AND held), count(*) FILTER (WHERE led)) FROM ld GROUP BY 1, 2),
fl AS (SELECT match, side, m[1] AS metric, m[2] AS part, m[3] AS whole FROM al)
SELECT match, metric, max(part) FILTER (WHERE side = 'A') AS part_a, max(whole) FILTER (WHERE side = 'A') AS whole_a, max(part) FILTER (WHERE side = 'B') AS part_b, max(whole) FILTER (WHERE side = 'B') AS whole_b,
  round(100.0 * max(part) FILTER (WHERE side = 'A') / nullif(max(whole) FILTER (WHERE side = 'A'), 0), 4) AS rate_a, round(100.0 * max(part) FILTER (WHERE side = 'B') / nullif(max(whole) FILTER (WHERE side = 'B'), 0), 4) AS rate_b FROM fl GROUP BY 1, 2
"""
)
def side_profiles(spark, d):
    """All nineteen metrics of a match, from both sides; matches of five games, the fifth decides."""
    points, games, _ = _log(spark, d)
    x = P.both_sides(P.side_profile(points, games.withColumn("best_of", F.lit(5))))
    return x.withColumn("rate_a", F.round("rate_a", 4)).withColumn("rate_b", F.round("rate_b", 4))
