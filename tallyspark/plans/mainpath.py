"""The main path end to end: nested documents made from the tables, written and read back, to facts, to every section of statistics.

An order is a match of its customer against another player; a tournament is an order priority, a category an order status. Players of doubles
have a partner. Orders of the lowest priority make documents without entries and results, which go to quarantine.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import as_table, owned, scratch, shared_dir
from ..sources import details as D
from ..sources import sinks
from . import facts as T
from .registry import query, rate_sql
from .results import orders
from .statistics import SECTIONS

KEYS = D.KEYS


#: Matches of a document's part, about: documents are as many as categories of editions, so they grow with the matches, and a row mustn't.
PART = 20_000


def documents_of(spark, d) -> DataFrame:
    """One row for each part of a document, arrays in order of their ids. Parts are ranges of matches, each with the entries of its matches."""
    category = F.when(F.col("o_orderstatus") == "F", "singles-none-boys").when(F.col("o_orderstatus") == "O", "doubles-none-boys").otherwise("singles-none-girls")
    m = orders(spark, d).select(F.concat(F.lit("cup"), F.substring("o_orderpriority", 1, 1)).alias("tournament"), F.col("yr").cast("int").alias("year"), category.alias("category"), F.col("o_orderkey").alias("k"), (F.col("o_custkey") + 1).cast("int").alias("a"), (F.col("o_orderkey") % 97 + 1).cast("int").alias("b"), (F.floor("o_totalprice") % 5).cast("int").alias("sa"), (F.col("o_orderkey") % 4).cast("int").alias("sb"), (F.col("o_orderkey") % 11 == 0).alias("retired"))
    whole = F.col("tournament") != "cup5"
    score = lambda x: F.map_from_arrays(F.array(x["a"].cast("string"), x["b"].cast("string")), F.array(x["sa"], x["sb"]))
    match = lambda x: F.struct(x["k"].cast("string").alias("matchId"), F.array(x["a"], x["b"]).alias("entries"), F.when(x["a"] != x["b"], score(x)).alias("scores"), F.lit("final").alias("round"), F.when(x["sa"] > x["sb"], x["a"]).when(x["sa"] < x["sb"], x["b"]).otherwise(0).alias("winnerEntryNo"), x["retired"].alias("retired"), F.when(x["whole"], F.lit("knockout")).otherwise("roundrobin").alias("stage"))
    # The first four entries of the whole document have a result.
    best = m.where(whole).select(*KEYS, F.explode(F.array("a", "b")).alias("entry")).distinct()
    best = best.withColumn("n", F.row_number().over(Window.partitionBy(*KEYS).orderBy("entry"))).where("n <= 4").groupBy(*KEYS).agg(F.sort_array(F.collect_list("entry")).alias("best"))
    parts = m.withColumn("whole", whole).repartitionByRange(max(1, -(-m.count() // PART)), *KEYS, "k").withColumn("part", F.spark_partition_id())
    parts = parts.groupBy(*KEYS, "part").agg(F.sort_array(F.collect_list(F.struct("k", "a", "b", "sa", "sb", "retired", "whole"))).alias("m"))
    parts = parts.join(F.broadcast(best), KEYS, "left").withColumn("e", F.when(whole, F.sort_array(F.array_distinct(F.flatten(F.transform("m", lambda x: F.array(x["a"], x["b"])))))))
    person = lambda letter, e: F.struct(F.concat(F.lit(letter), e.cast("string")).alias("id"), F.concat(F.lit(letter), e.cast("string")).alias("lastName"), F.lit("X").alias("firstName"), F.concat(F.lit("T"), (e % 20).cast("string")).alias("team"), F.lit(None).cast("string").alias("prefecture"))
    doubles = F.col("category").startswith("doubles")
    people = lambda e: F.when(doubles, F.array(person("P", e), person("Q", e))).otherwise(F.array(person("P", e)))
    entry = lambda e: F.struct(e.alias("entryNo"), F.transform(people(e), lambda p: p["id"]).alias("playerIds"), F.lit(None).cast("string").alias("type"))
    place = lambda e: F.array_position("best", e)
    rank = lambda e: F.struct(F.when(place(e) == 1, "winner").when(place(e) == 2, "runnerup").otherwise("best").alias("kind"), F.when(place(e) > 2, 4).alias("bestLevel"), F.lit(None).cast("int").alias("round"))
    result = lambda e: F.struct(e.alias("entryNo"), F.struct(F.lit(None).cast("string").alias("label"), rank(e).alias("rank")).alias("tournament"))
    results = F.transform(F.filter("e", lambda e: F.array_contains("best", e)), result)
    return parts.select(*KEYS, "part", F.transform("m", match).alias("matches"), F.flatten(F.transform("e", people)).alias("participants"), F.transform("e", entry).alias("entries"), results.alias("results"))


def read_back(spark, d) -> DataFrame:
    """The documents, after they were written as nested JSON to the shared folder."""
    root = owned(spark, f"{shared_dir(spark)}/details-{uuid.uuid4().hex}")
    sinks.write_details(documents_of(spark, d), [*KEYS, "part"], root, "gzip")
    return D.read_details(spark, root, D.PARTITIONED)


def meta_of(spark, d) -> DataFrame:
    e = orders(spark, d).select(F.concat(F.lit("cup"), F.substring("o_orderpriority", 1, 1)).alias("tournament"), F.col("yr").cast("int").alias("year")).distinct()
    return e.select("tournament", "year", F.concat("year", F.lit("-05-01")).alias("start"), F.col("tournament").isin("cup1", "cup2").alias("is_major"), (F.col("tournament") == "cup3").alias("is_national"))


_BUILT: dict[tuple[str, str, int], tuple[DataFrame, DataFrame]] = {}


def _state_of(spark, d) -> int:
    """A hash of the orders' files: paths, sizes and times."""
    files = orders(spark, d).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return files.agg(F.coalesce(F.bit_xor(F.xxhash64("*")), F.lit(0))).first()[0]


def facts_of(spark, d) -> tuple[DataFrame, DataFrame]:
    """(match facts, entry facts), as tables of the shared folder, made once for each application, folder and state of its files."""
    key = (spark.sparkContext.applicationId, d, _state_of(spark, d))
    if key not in _BUILT:
        with scratch(spark):
            details = read_back(spark, d)
            roster = orders(spark, d).select(F.explode(F.array(F.col("o_custkey") + 1, F.col("o_orderkey") % 97 + 1)).alias("position")).distinct()
            index = T.player_index(roster.select("position", F.col("position").alias("id"), F.concat(F.lit("P"), F.col("position").cast("string")).alias("lastName"), F.lit("X").alias("firstName")))
            standard = D.standard(details)
            people = T.identified(D.participants(standard), index)
            seated = as_table(T.seats(D.entries(standard), people), "seats")
            _BUILT[key] = (as_table(T.match_facts(details, people, meta_of(spark, d), seated), "match-facts", keep=True), as_table(T.entry_facts(details, people, meta_of(spark, d), seated), "entry-facts", keep=True))
    return _BUILT[key]


_M = """
o AS (SELECT 'cup' || substr(o_orderpriority, 1, 1) AS tournament, year(o_orderdate)::INT AS year, CASE o_orderstatus WHEN 'F' THEN 'singles-none-boys' WHEN 'O' THEN 'doubles-none-boys' ELSE 'singles-none-girls' END AS category, o_orderkey AS match, o_custkey + 1 AS a, o_orderkey % 97 + 1 AS b, floor(o_totalprice)::BIGINT % 5 AS sa, o_orderkey % 4 AS sb, o_orderkey % 11 = 0 AS retired FROM orders),
m AS (SELECT * FROM o WHERE tournament <> 'cup5')"""
_FACTS = (
    _M
    + """,
side AS (SELECT tournament, year, category, match, retired, a AS own_entry, b AS other, sa AS own, sb AS against FROM m WHERE a <> b UNION ALL SELECT tournament, year, category, match, retired, b, a, sb, sa FROM m WHERE a <> b),
seat AS (SELECT *, unnest(CASE WHEN category LIKE 'doubles%' THEN ['P', 'Q'] ELSE ['P'] END) AS letter FROM side),
mf AS (SELECT tournament, year, category, split_part(category, '-', 1) AS discipline, split_part(category, '-', 3) AS gender, match, retired, own_entry, other, own, against, NOT retired AS counts,
  letter || own_entry || 'X@T' || own_entry % 20 AS person, 'T' || own_entry % 20 AS team, CASE WHEN letter = 'P' THEN own_entry END AS player,
  CASE WHEN category LIKE 'doubles%' THEN CASE letter WHEN 'P' THEN 'Q' ELSE 'P' END || own_entry || ' X' END AS partner,
  CASE WHEN own > against THEN 'win' WHEN own < against THEN 'lose' ELSE 'draw' END AS result, year || '-05-01' AS date,
  CASE WHEN tournament IN ('cup1', 'cup2') THEN 'major' WHEN tournament = 'cup3' THEN 'national' ELSE 'local' END AS tier FROM seat),
en AS (SELECT tournament, year, category, entry, row_number() OVER (PARTITION BY tournament, year, category ORDER BY entry) AS n FROM (SELECT tournament, year, category, a AS entry FROM m UNION SELECT tournament, year, category, b FROM m)),
es AS (SELECT *, unnest(CASE WHEN category LIKE 'doubles%' THEN ['P', 'Q'] ELSE ['P'] END) AS letter FROM en),
ef AS (SELECT tournament, year, category, split_part(category, '-', 1) AS discipline, split_part(category, '-', 3) AS gender, entry, letter || entry || 'X@T' || entry % 20 AS person, 'T' || entry % 20 AS team, CASE n WHEN 1 THEN 'winner' WHEN 2 THEN 'runnerup' WHEN 3 THEN 'best4' WHEN 4 THEN 'best4' ELSE 'unknown' END AS placement,
  CASE n WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 3 ELSE 0 END AS strength, year || '-05-01' AS date, tournament IN ('cup1', 'cup2') AS is_major, tournament = 'cup3' AS is_national FROM es)"""
)
_WON, _LOST = "count(*) FILTER (WHERE counts AND result = 'win')", "count(*) FILTER (WHERE counts AND result = 'lose')"
_DECIDED = "FILTER (WHERE counts AND result <> 'draw')"


def _fold(keys: str, where: str = "true") -> str:
    return f"SELECT {keys}, {_WON} AS wins, {_LOST} AS losses, {_WON} + {_LOST} AS total, {rate_sql(_WON, f'{_WON} + {_LOST}')} AS win_rate FROM mf WHERE {where} GROUP BY ALL"


def _share(name: str, condition: str) -> str:
    return f"{rate_sql(f'count(*) FILTER (WHERE {condition})', 'count(*)')} AS {name}"


@query(f"WITH {_M} SELECT tournament, year, category, match::VARCHAR AS match, a::INT AS entry_a, b::INT AS entry_b, CASE WHEN a <> b THEN sa END::INT AS score_a, CASE WHEN a <> b THEN sb END::INT AS score_b, CASE WHEN sa > sb THEN a WHEN sa < sb THEN b END::INT AS winner, retired FROM m")
def details_matches(spark, d):
    return D.matches(D.standard(read_back(spark, d))).select(*KEYS, "match", "entry_a", "entry_b", "score_a", "score_b", "winner", "retired")


@query(f"WITH {_M} SELECT DISTINCT tournament, year, category, 'round_robin_only' AS variant FROM o WHERE tournament = 'cup5'")
def details_quarantine(spark, d):
    return D.quarantined(read_back(spark, d))


@query(f"WITH {_FACTS} SELECT tournament, year, category, match::VARCHAR AS match, person, player::BIGINT AS player, team, partner, result, counts, own::INT AS own, against::INT AS against, date, tier, discipline, gender FROM mf")
def fact_matches(spark, d):
    return facts_of(spark, d)[0].select(*KEYS, "match", "person", F.col("player").cast("long").alias("player"), "team", "partner", "result", "counts", "own", "against", "date", "tier", "discipline", "gender")


@query(f"WITH {_FACTS} SELECT tournament, year, category, entry::INT AS entry, person, team, placement, placement IN ('winner', 'runnerup') AS reached_final, placement <> 'unknown' AS reached_semifinal FROM ef")
def fact_entries(spark, d):
    return facts_of(spark, d)[1].select(*KEYS, "entry", "person", "team", "placement", "reached_final", "reached_semifinal")


@query(f"WITH {_FACTS} SELECT DISTINCT player::BIGINT AS player, tournament || '/' || year || '/' || category AS cat_key FROM mf WHERE player IS NOT NULL")
def fact_index(spark, d):
    return T.reverse_index(facts_of(spark, d)[0]).select(F.col("player").cast("long").alias("player"), "cat_key")


def _longest(kind: str) -> str:
    runs = f"SELECT *, sum(CASE WHEN result = '{kind}' THEN 0 ELSE 1 END) OVER (PARTITION BY person ORDER BY date, tournament, category, match) AS island FROM mf WHERE counts"
    each = f"SELECT person, island, count(*) AS length, min(date) AS first_at, max(date) AS last_at FROM ({runs}) WHERE result = '{kind}' GROUP BY 1, 2"
    return f"SELECT person, length, first_at, last_at, '{kind}' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY length DESC, island) AS k FROM ({each})) WHERE k = 1"


_SQL = {
    "streaks": f"{_longest('win')} UNION ALL {_longest('lose')}",
    "career": f"SELECT person, CASE WHEN grouping(discipline) = 1 THEN 'all' ELSE discipline END AS discipline, {_WON} AS wins, {_LOST} AS losses, min(date) AS first_date, max(date) AS last_date, {rate_sql(_WON, f'{_WON} + {_LOST}')} AS win_rate FROM mf GROUP BY GROUPING SETS ((person), (person, discipline))",
    "games": f"SELECT person, won, lost, {rate_sql('won', 'won + lost')} AS game_rate FROM (SELECT person, coalesce(sum(own) {_DECIDED}, 0)::BIGINT AS won, coalesce(sum(against) {_DECIDED}, 0)::BIGINT AS lost FROM mf GROUP BY 1)",
    "by_year": f"SELECT coalesce(x.person, e.person) AS person, coalesce(x.year, e.year) AS year, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses, coalesce(total, 0) AS total, coalesce(win_rate, 0) AS win_rate, coalesce(entries, 0) AS entries, best FROM ({_fold('person, year')}) x FULL JOIN (SELECT person, year, count(*) AS entries, arg_max(placement, strength) AS best FROM ef GROUP BY 1, 2) e ON x.person = e.person AND x.year = e.year",
    "by_partner": _fold("person, partner", "partner IS NOT NULL"),
    "by_team": f"SELECT e.person, e.team, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses, coalesce(total, 0) AS total, win_rate, titles, from_year, to_year FROM (SELECT person, team, count(*) FILTER (WHERE placement = 'winner') AS titles, min(year) AS from_year, max(year) AS to_year FROM ef GROUP BY 1, 2) e LEFT JOIN ({_fold('person, team')}) x ON x.person = e.person AND x.team = e.team",
    "by_tournament": "SELECT person, tournament, count(DISTINCT (year, category)) AS appearances, list_sort(list(DISTINCT year)) AS seasons, count(*) FILTER (WHERE placement = 'winner') AS titles, arg_max(placement, strength) AS best FROM ef GROUP BY 1, 2",
    "head_to_head": f"SELECT person, opponent, {_WON} AS wins, {_LOST} AS losses, {_WON} + {_LOST} AS total, {rate_sql(_WON, f'{_WON} + {_LOST}')} AS win_rate, min(date) AS first_date, max(date) AS last_date FROM (SELECT *, unnest(CASE WHEN category LIKE 'doubles%' THEN ['P', 'Q'] ELSE ['P'] END) || other || 'X@T' || other % 20 AS opponent FROM mf) GROUP BY 1, 2",
    "reach": f"SELECT person, count(*) AS entries, {_share('final_rate', chr(39).join(['placement IN (', 'winner', ', ', 'runnerup', ')']))}, {_share('semifinal_rate', 'true')}, {_share('title_rate', chr(39).join(['placement = ', 'winner', '']))} FROM ef WHERE placement <> 'unknown' GROUP BY 1",
    "titles": "SELECT person, count(*) AS titles, count(*) FILTER (WHERE is_national) AS national_titles, count(*) FILTER (WHERE is_major) AS major_titles FROM ef WHERE placement = 'winner' GROUP BY 1",
    "milestones": "SELECT person, min(date) AS debut, min(date) FILTER (WHERE is_national) AS first_national, min(date) FILTER (WHERE placement = 'winner') AS first_title FROM ef GROUP BY 1",
    "title_streaks": "SELECT person, tournament, min(year) AS first_year, max(year) AS last_year, count(*) AS length FROM (SELECT *, year - row_number() OVER (PARTITION BY person, tournament ORDER BY year) AS island FROM (SELECT DISTINCT person, tournament, year FROM ef WHERE placement = 'winner')) GROUP BY person, tournament, island HAVING count(*) >= 2",
    "rankings": "SELECT *, rank() OVER (PARTITION BY year, discipline, gender ORDER BY points DESC, best DESC)::INT AS rnk FROM (SELECT person, year, discipline, gender, round(sum(score), 3) AS points, count(*) AS counted, max(score) AS best FROM (SELECT *, row_number() OVER (PARTITION BY person, year, discipline, gender ORDER BY score DESC) AS n FROM (SELECT *, CASE WHEN is_major THEN 100.0 WHEN is_national THEN 60.0 ELSE 20.0 END * CASE placement WHEN 'winner' THEN 1.0 WHEN 'runnerup' THEN 0.7 WHEN 'best4' THEN 0.5 ELSE 0.1 END AS score FROM ef WHERE discipline = 'doubles')) WHERE n <= 3 GROUP BY ALL)",
    "best_seasons": f"SELECT person, discipline, year, wins, total, win_rate FROM (SELECT *, row_number() OVER (PARTITION BY person, discipline ORDER BY win_rate DESC, year) AS n FROM ({_fold('person, discipline, year')}) WHERE total >= 10) WHERE n = 1",
    "highlights": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY win_rate, total DESC, opponent)::INT AS place FROM (SELECT person, opponent, {_WON} AS wins, {_LOST} AS losses, {_WON} + {_LOST} AS total, {rate_sql(_WON, f'{_WON} + {_LOST}')} AS win_rate, min(date) AS first_date, max(date) AS last_date FROM (SELECT *, unnest(CASE WHEN category LIKE 'doubles%' THEN ['P', 'Q'] ELSE ['P'] END) || other || 'X@T' || other % 20 AS opponent FROM mf) GROUP BY 1, 2) WHERE total >= 3) WHERE place <= 3",
}


def _section(name: str) -> None:
    def run(spark, d):
        return SECTIONS[name](*facts_of(spark, d))

    run.__name__ = f"statistics_{name}"
    query(f"WITH {_FACTS} {_SQL[name]}" if name in _SQL else None)(run)


for _name in SECTIONS:
    _section(_name)
