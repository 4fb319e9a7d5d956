"""What pages show of teams, rosters and stories: summaries, tables by year, top teams, packed strings, and what is fit to print."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import count_where


def team_summary(results: DataFrame, roster: DataFrame, event: str, players: str, result: str, team: str, member: str, best: Sequence[str] = ("winner", "runnerup", "best4", "best8")) -> DataFrame:
    """Each team's events, matches its members are in, and how many of its members' entries won, came second, and were among the last eight.

    results: a row for each entry with an array of players. roster: team, member (several teams may have one). An entry counts once for each of its members in the team.
    """
    x = results.withColumn("__entry", F.struct(event, F.array_sort(F.array_distinct(players)))).select("__entry", event, result, F.explode(F.array_distinct(players)).alias(member)).join(roster.select(team, member).distinct(), member)
    return x.groupBy(team).agg(F.count_distinct(event).alias("events"), count_where(F.col(result) == "winner").alias("champions"), count_where(F.col(result) == "runnerup").alias("runners_up"), count_where(F.col(result).isin(*best)).alias("top8"), F.count("*").alias("entries"))


def team_matches(matches: DataFrame, roster: DataFrame, match: str, players: str, team: str, member: str) -> DataFrame:
    """How many matches any of a team's members are in."""
    x = matches.select(match, F.explode(players).alias(member)).join(roster.select(team, member), member)
    return x.groupBy(team).agg(F.count_distinct(match).alias("matches"))


def champion_table(champions: DataFrame, row: str, column: str, value: str, columns: Sequence) -> DataFrame:
    """Rows by category and columns by year, given so that Spark needn't look for them; the least of several values."""
    return champions.groupBy(row).pivot(column, list(columns)).agg(F.min(value))


def top_teams(entries: DataFrame, group: Sequence[str], year: str, priority: str, rank: str, team: str) -> DataFrame:
    """Of each group's latest year, and there of the tournament of least priority number, all teams at the best rank, once each."""
    w = lambda *order: Window.partitionBy(*group).orderBy(*order)
    x = entries.withColumn("__n", F.rank().over(w(F.desc(year), F.asc(priority), F.asc(rank)))).where("__n = 1").drop("__n")
    return x.dropDuplicates([*group, team])


def longest_runs_across(points: DataFrame, match: str, order: Sequence[str], winner: str) -> DataFrame:
    """(match, winner, length, first, last): the longest runs of points by one side, over the borders of games; all of equal length, each once. Points without a winner don't count and break nothing."""
    w = Window.partitionBy(match).orderBy(*order)
    x = points.where(F.col(winner).isNotNull()).withColumn("__new", (F.lag(winner).over(w).isNull() | (F.lag(winner).over(w) != F.col(winner))).cast("int"))
    x = x.withColumn("__run", F.sum("__new").over(w))
    at = F.struct(*order)
    runs = x.groupBy(match, winner, "__run").agg(F.count("*").alias("length"), F.min(at).alias("first"), F.max(at).alias("last"))
    return runs.join(F.broadcast(runs.agg(F.max("length").alias("length"))), "length").select(match, winner, "length", "first", "last")


def pack_strings(rows: DataFrame, page: Sequence[str], columns: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """(page, strings, rows): each page's rows with every string as its place from 0 in the page's own table; null stays null. A page is what one reader loads, so its rows fit an array."""
    x = rows.groupBy(*page).agg(F.collect_list(F.struct(*rest, *columns)).alias("rows"))
    strings = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("rows", lambda r: F.array(*(r[c] for c in columns)))), lambda s: s.isNotNull())))
    place = lambda r, c: F.when(r[c].isNotNull(), F.array_position(F.col("strings"), r[c]) - 1).alias(c)
    return x.withColumn("strings", strings).withColumn("rows", F.transform("rows", lambda r: F.struct(*(r[c].alias(c) for c in rest), *(place(r, c) for c in columns))))


def unpack_strings(packed: DataFrame, page: Sequence[str], columns: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """The rows that `pack_strings` was given."""
    x = packed.select(*page, "strings", F.explode("rows").alias("r"))
    return x.select(*page, *(F.col(f"r.{c}").alias(c) for c in rest), *(F.get("strings", F.col(f"r.{c}").cast("int")).alias(c) for c in columns))


def without_told(stories: DataFrame, told: DataFrame, members: str, keys: Sequence[str] = ()) -> DataFrame:
    """Stories but those whose set of members another story of the same keys tells already."""
    sign = F.array_sort(F.array_distinct(members))
    return stories.withColumn("__set", sign).join(told.select(*keys, sign.alias("__set")).distinct(), [*keys, "__set"], "left_anti").drop("__set")


def mergeable(members: DataFrame, candidate: str, stage: str, member: str, event: str) -> DataFrame:
    """Candidates that may be merged: no two members of one stage were at the same event. members: a row for each member and event (null: none)."""
    both = members.where(F.col(event).isNotNull()).groupBy(candidate, stage, event).agg(F.count_distinct(member).alias("n")).where("n > 1").select(candidate).distinct()
    return members.select(candidate).distinct().join(both, candidate, "left_anti")


def in_scopes(rows: DataFrame, edition: Column, scope: str = "scope", whole: str = "all") -> DataFrame:
    """Every row twice: in the scope of all time and in that of its edition. What groups by scope then serves both."""
    return rows.withColumn(scope, F.explode(F.array(F.lit(whole), edition.cast("string"))))


def published(insights: DataFrame, state: str = "state", verified: str = "verified_at", paragraphs: str = "paragraphs") -> DataFrame:
    """Insights that are published, verified and not empty."""
    return insights.where((F.col(state) == "published") & F.col(verified).isNotNull() & (F.size(paragraphs) > 0))


def best_attempt(attempts: DataFrame, keys: Sequence[str], attempt: str, score: str) -> DataFrame:
    """The attempt with the best score for each key, the first of equals; attempts without a score lose."""
    other = [c for c in attempts.columns if c not in keys]
    best = F.max_by(F.struct(*other), F.struct(F.col(score).isNotNull(), score, -F.col(attempt)))
    return attempts.groupBy(*keys).agg(best.alias("b")).select(*keys, *(F.col(f"b.{c}").alias(c) for c in other))


def recurring_matchups(matches: DataFrame, a: str, b: str, year: str, late: Column, at: int, least: int = 3) -> DataFrame:
    """(side_a, side_b, times, first_year): sides that have met in late rounds at least so often, the given year among them, whoever stands first."""
    x = matches.where(late).select(F.least(a, b).alias("side_a"), F.greatest(a, b).alias("side_b"), year).where("side_a <> side_b")
    out = x.groupBy("side_a", "side_b").agg(F.count("*").alias("times"), F.min(year).alias("first_year"), F.max((F.col(year) == at).cast("int")).alias("__now"))
    return out.where((F.col("times") >= least) & (F.col("__now") == 1)).drop("__now")


def title_stories(champions: DataFrame, event: Sequence[str], year: str, champion: str, at: int) -> DataFrame:
    """The titles of a year, with how many the champion has had at that event by then, the year of the one before, and how many years in a row."""
    w = Window.partitionBy(*event, champion).orderBy(year)
    x = champions.where(F.col(year) <= at).select(*event, year, champion).distinct()
    x = x.withColumn("title_count", F.row_number().over(w)).withColumn("previous_year", F.lag(year).over(w)).withColumn("__island", F.col(year) - F.col("title_count"))
    row = F.row_number().over(Window.partitionBy(*event, champion, "__island").orderBy(year))
    return x.withColumn("in_a_row", row).where(F.col(year) == at).drop("__island")
