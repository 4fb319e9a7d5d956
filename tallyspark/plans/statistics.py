"""Statistics sections of a player, as lazy DataFrames keyed by person: only what is asked for is built, and Spark shares nothing it needn't."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import entry_score
from ..functions.numbers import exact_rate
from ..operators.aggregates import appearances, best_season, count_where, fold_games, fold_results, merge_groups, reach_rates, roll_up
from ..operators.ranking import season_points, top_k
from ..operators.sequences import first_events, result_streaks, year_islands


def career(matches: DataFrame, entries: DataFrame) -> DataFrame:
    counted = F.col("counts")
    x = roll_up(matches, ["person"], "discipline", [count_where(counted & (F.col("result") == "win")).alias("wins"), count_where(counted & (F.col("result") == "lose")).alias("losses"), F.min("date").alias("first_date"), F.max("date").alias("last_date")])
    return x.withColumn("win_rate", exact_rate(F.col("wins"), F.col("wins") + F.col("losses")))


def games(matches: DataFrame, entries: DataFrame) -> DataFrame:
    return fold_games(matches, ["person"], F.col("own"), F.col("against"), F.col("counts") & F.col("result").isin("win", "lose"))


def by_year(matches: DataFrame, entries: DataFrame) -> DataFrame:
    m = fold_results(matches, ["person", "year"], F.col("result"), F.col("counts"))
    e = entries.groupBy("person", "year").agg(F.count("*").alias("entries"), F.max_by("placement", "strength").alias("best"))
    return merge_groups(m, e, ["person", "year"], ["wins", "losses", "total", "entries"]).fillna(0.0, ["win_rate"])


def by_partner(matches: DataFrame, entries: DataFrame) -> DataFrame:
    return fold_results(matches.where("partner is not null"), ["person", "partner"], F.col("result"), F.col("counts"))


def by_team(matches: DataFrame, entries: DataFrame) -> DataFrame:
    m = fold_results(matches.where("team is not null"), ["person", "team"], F.col("result"), F.col("counts"))
    e = entries.where("team is not null").groupBy("person", "team").agg(count_where(F.col("placement") == "winner").alias("titles"), F.min("year").alias("from_year"), F.max("year").alias("to_year"))
    return merge_groups(m, e, ["person", "team"], ["wins", "losses", "total", "titles"])


def by_tournament(matches: DataFrame, entries: DataFrame) -> DataFrame:
    a = appearances(entries, ["person", "tournament"], ["year", "category"], F.col("year"))
    t = entries.groupBy("person", "tournament").agg(count_where(F.col("placement") == "winner").alias("titles"), F.max_by("placement", "strength").alias("best"))
    return a.join(t, ["person", "tournament"])


def head_to_head(matches: DataFrame, entries: DataFrame) -> DataFrame:
    x = matches.select("person", "result", "counts", "date", F.explode("opponents").alias("o")).select("person", "result", "counts", "date", F.col("o.person").alias("opponent"))
    days = x.groupBy("person", "opponent").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return fold_results(x, ["person", "opponent"], F.col("result"), F.col("counts")).join(days, ["person", "opponent"])


def reach(matches: DataFrame, entries: DataFrame) -> DataFrame:
    knockout = entries.where(~F.col("placement").isin("group", "unknown"))
    return reach_rates(knockout, ["person"], {"final_rate": F.col("reached_final"), "semifinal_rate": F.col("reached_semifinal"), "title_rate": F.col("placement") == "winner"})


def titles(matches: DataFrame, entries: DataFrame) -> DataFrame:
    won = entries.where("placement = 'winner'")
    return won.groupBy("person").agg(F.count("*").alias("titles"), count_where(F.col("is_national")).alias("national_titles"), count_where(F.col("is_major")).alias("major_titles"))


def title_streaks(matches: DataFrame, entries: DataFrame) -> DataFrame:
    return year_islands(entries.where("placement = 'winner'"), ["person", "tournament"], "year")


def streaks(matches: DataFrame, entries: DataFrame) -> DataFrame:
    order = ["date", "round_order", "tournament", "category", "position"]
    one = lambda t: result_streaks(matches, ["person"], order, F.col("result"), t, ~F.col("counts"), "date").withColumn("kind", F.lit(t))
    return one("win").unionByName(one("lose"))


def best_seasons(matches: DataFrame, entries: DataFrame) -> DataFrame:
    counted = F.col("counts") & F.col("result").isin("win", "lose")
    return best_season(matches, ["person", "discipline"], "year", counted & (F.col("result") == "win"), counted)


def rankings(matches: DataFrame, entries: DataFrame) -> DataFrame:
    doubles = entries.where("discipline = 'doubles'")
    return season_points(doubles, "person", ["year", "discipline", "gender"], entry_score(F.col("tier"), F.col("placement")))


def milestones(matches: DataFrame, entries: DataFrame) -> DataFrame:
    return first_events(entries, ["person"], ["date", "tournament", "category"], {"debut": F.lit(True), "first_national": F.col("is_national"), "first_title": F.col("placement") == "winner"}, "date")


def highlights(matches: DataFrame, entries: DataFrame) -> DataFrame:
    """Up to three toughest opponents of at least three meetings."""
    h = head_to_head(matches, entries).where("total >= 3")
    return top_k(h, ["person"], 3, F.asc("win_rate"), F.desc("total"), F.asc("opponent"))


SECTIONS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {f.__name__: f for f in (career, games, by_year, by_partner, by_team, by_tournament, head_to_head, reach, titles, title_streaks, streaks, best_seasons, rankings, milestones, highlights)}


def statistics(matches: DataFrame, entries: DataFrame, sections: Iterable[str] = SECTIONS, person: str | None = None, discipline: str | None = None) -> dict[str, DataFrame]:
    """The named sections. A person or discipline is a filter on both fact tables, which Spark pushes down."""
    for column, value in (("person", person), ("discipline", discipline)):
        if value is not None:
            matches, entries = matches.where(F.col(column) == value), entries.where(F.col(column) == value)
    return {name: SECTIONS[name](matches, entries) for name in sections}
