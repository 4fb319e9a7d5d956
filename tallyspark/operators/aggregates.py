"""Grouped aggregates. All combine on the map side; none collects a group's rows unless its result is that list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import exact_rate, half_up


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def fold_results(rows: DataFrame, keys: Sequence[str], outcome: Column, counts: Column | None = None) -> DataFrame:
    """wins, losses, total and exact win_rate by keys. outcome: "win", "lose" or anything else, which isn't counted; rows where `counts` is false (retired) aren't either."""
    counted = F.lit(True) if counts is None else counts
    out = rows.groupBy(*keys).agg(count_where(counted & (outcome == "win")).alias("wins"), count_where(counted & (outcome == "lose")).alias("losses"))
    total = F.col("wins") + F.col("losses")
    return out.withColumn("total", total).withColumn("win_rate", exact_rate(F.col("wins"), total))


def fold_games(rows: DataFrame, keys: Sequence[str], won: Column, lost: Column, counts: Column) -> DataFrame:
    """Sums of games won and lost in decided matches, and their exact rate."""
    out = rows.groupBy(*keys).agg(F.coalesce(F.sum(F.when(counts, won)), F.lit(0)).alias("won"), F.coalesce(F.sum(F.when(counts, lost)), F.lit(0)).alias("lost"))
    return out.withColumn("game_rate", exact_rate(F.col("won"), F.col("won") + F.col("lost")))


def roll_up(rows: DataFrame, outer: Sequence[str], inner: str, aggregates: Sequence[Column], total: str = "all") -> DataFrame:
    """The aggregates by outer keys and by outer and inner keys; rows over all inner keys say `total`."""
    sets = [[*outer], [*outer, inner]]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *outer, inner).agg(*aggregates, F.grouping(inner).alias("__over"))
    return grouped.withColumn(inner, F.when(F.col("__over") == 1, F.lit(total)).otherwise(F.col(inner).cast("string"))).drop("__over")


def merge_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], zeros: Sequence[str]) -> DataFrame:
    """Groups of either side; the named counts are 0 where a side has no such group."""
    return left.join(right, list(keys), "full_outer").fillna(0, list(zeros))


def best_season(rows: DataFrame, keys: Sequence[str], season: str, won: Column, played: Column, least: int = 10) -> DataFrame:
    """Of each key the season with the best exact rate among those with `least` matches; the first one of equals."""
    seasons = rows.groupBy(*keys, season).agg(count_where(won).alias("wins"), count_where(played).alias("total")).where(F.col("total") >= least)
    seasons = seasons.withColumn("win_rate", exact_rate(F.col("wins"), F.col("total")))
    best = seasons.groupBy(*keys).agg(F.max_by(F.struct(season, "wins", "total", "win_rate"), F.struct("win_rate", -F.col(season))).alias("b"))
    return best.select(*keys, "b.*")


def appearances(rows: DataFrame, keys: Sequence[str], event: Sequence[str], season: Column) -> DataFrame:
    """How many distinct events, and the sorted distinct seasons."""
    return rows.groupBy(*keys).agg(F.count_distinct(F.struct(*event)).alias("appearances"), F.sort_array(F.collect_set(season)).alias("seasons"))


def top_n_sum(rows: DataFrame, keys: Sequence[str], score: Column, n: int = 3, places: int = 3) -> DataFrame:
    """The half-up sum of each group's n best scores and how many counted. Spark prunes to n rows a group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc("__score"))
    best = rows.select(*keys, score.alias("__score")).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    return best.groupBy(*keys).agg(half_up(F.sum("__score"), places).alias("points"), F.count("*").alias("counted"))


def modal_value(rows: DataFrame, keys: Sequence[str], value: str, tie: Column | None = None) -> DataFrame:
    """Each group's most frequent value, its count and share; of equals the one with the least tie (by default the value)."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"), (F.min(tie) if tie is not None else F.first(value)).alias("__tie"))
    out = counts.groupBy(*keys).agg(F.min_by(F.struct(value, "__n"), F.struct(-F.col("__n"), "__tie")).alias("m"), F.sum("__n").alias("__all"))
    return out.select(*keys, F.col(f"m.{value}").alias(value), F.col("m.__n").alias("n"), exact_rate(F.col("m.__n"), F.col("__all")).alias("share"))


def share_of_total(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts of each value and their exact share of the group's rows."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("share", exact_rate(F.col("n"), whole))


def dominant_value(rows: DataFrame, keys: Sequence[str], value: str, least_rows: int, least_share: float) -> DataFrame:
    """The modal value of groups that have so many rows and in which it has so large a share."""
    return modal_value(rows, keys, value).where((F.col("n") >= least_rows) & (F.col("share") >= least_share))


def pivot_counts(rows: DataFrame, keys: Sequence[str], column: str, names: Mapping[str, str], weights: Mapping[str, float] | None = None) -> DataFrame:
    """A count for each named value of a column, and with weights their weighted sum as `points`."""
    out = rows.groupBy(*keys).agg(*(count_where(F.col(column) == v).alias(n) for v, n in names.items()))
    if weights:
        points = F.lit(0.0)
        for v, w in weights.items():
            points = points + F.col(names[v]) * float(w)
        out = out.withColumn("points", points)
    return out


def roll_up_boards(rows: DataFrame, inner: Sequence[str], outer: str, score: Column) -> tuple[DataFrame, DataFrame]:
    """Scores by member (inner keys) with ranks in the outer group and overall, and outer totals with each one's best member."""
    members = rows.groupBy(outer, *inner).agg(F.sum(score).alias("score"))
    order = [F.desc("score"), *(F.asc(c) for c in inner)]
    members = members.withColumn("rank_within", F.row_number().over(Window.partitionBy(outer).orderBy(*order)))
    totals = members.groupBy(outer).agg(F.sum("score").alias("score"), F.count("*").alias("members"), F.min_by(F.struct(*inner), "rank_within").alias("best")).select(outer, "score", "members", *(F.col(f"best.{c}").alias(f"best_{c}") for c in inner))
    return members, totals


def reach_rates(rows: DataFrame, keys: Sequence[str], reached: Mapping[str, Column]) -> DataFrame:
    """The exact share of entries that reached each named stage."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("entries"), *(count_where(c).alias(f"n_{n}") for n, c in reached.items()))
    return out.select(*keys, "entries", *(exact_rate(F.col(f"n_{n}"), F.col("entries")).alias(n) for n in reached))


def histogram_text(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts by value as one text, `value x count`, in order of value."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    entry = F.transform(F.array_sort(F.collect_list(F.struct(value, "n"))), lambda x: F.concat_ws(" x ", x[value].cast("string"), x["n"].cast("string")))
    return counts.groupBy(*keys).agg(F.array_join(entry, ", ").alias("histogram"))


def search_text(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The distinct values of the columns in lower case, sorted and joined by spaces."""
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.flatten(F.array(*(F.collect_set(F.lower(F.col(c).cast("string"))) for c in columns)))), " ").alias("found_by"))


def all_hold(rows: DataFrame, keys: Sequence[str], condition: Column, among: Column | None = None) -> DataFrame:
    """perfect: whether the condition holds for every row of a group that `among` picks; null if it picks none."""
    return rows.groupBy(*keys).agg(F.every(F.when(F.lit(True) if among is None else among, condition)).alias("perfect"))


def coverage(matches: DataFrame, keys: Sequence[str], decided: Column, order: Column, label: str) -> DataFrame:
    """How far results go: matches, decided ones and their share, deepest decided and shallowest open label, and a status."""
    x = matches.withColumn("__d", F.coalesce(decided, F.lit(False))).withColumn("__o", order)
    out = x.groupBy(*keys).agg(
        F.count("*").alias("matches"),
        count_where(F.col("__d")).alias("decided"),
        F.max_by(label, F.when(F.col("__d"), F.struct("__o", label))).alias("deepest_decided"),
        F.min_by(label, F.when(~F.col("__d"), F.struct("__o", label))).alias("shallowest_open"),
    )
    status = F.when(F.col("decided") == 0, "upcoming").when(F.col("decided") < F.col("matches"), "in progress").otherwise("complete")
    return out.withColumn("coverage", exact_rate(F.col("decided"), F.col("matches"))).withColumn("status", status)


def both_sides(rows: DataFrame, a: str, b: str, won_by_a: Column, *others: str) -> DataFrame:
    """One row for either side of a match: side, opponent, won and the other columns."""
    x = rows.select(F.explode(F.array(F.struct(F.col(a).alias("side"), F.col(b).alias("opponent"), won_by_a.alias("won")), F.struct(F.col(b).alias("side"), F.col(a).alias("opponent"), (~won_by_a).alias("won")))).alias("s"), *others)
    return x.select("s.*", *others)


def roster_results(roster: DataFrame, player: str, sides: DataFrame, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Wins and losses of every player of a roster by kind, zero where there are none. sides: side, won and kind."""
    cells = [c for k in kinds for c in (count_where((F.col(kind) == k) & F.col("won")).alias(f"{k}_wins"), count_where((F.col(kind) == k) & ~F.col("won")).alias(f"{k}_losses"))]
    found = sides.groupBy(F.col("side").alias(player)).agg(*cells)
    return roster.select(player).distinct().join(found, player, "left").fillna(0)


def transitions(rows: DataFrame, season: str, kind: str, member: str, kinds: Sequence[str]) -> DataFrame:
    """Distinct members of each kind by season, and each kind's exact share."""
    out = rows.groupBy(season).agg(*(F.count_distinct(F.when(F.col(kind) == k, F.col(member))).alias(k) for k in kinds), F.count_distinct(kind, member).alias("__all"))
    return out.select(season, *kinds, *(exact_rate(F.col(k), F.col("__all")).alias(f"{k}_share") for k in kinds))
