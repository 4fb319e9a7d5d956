"""History of entries over editions and careers: champions, title defence, pairs that stay or part, careers across stages, stories."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import count_where
from .joins import first_wins
from .sequences import self_best, streak_ending_at, streak_stopped


def champions(editions: DataFrame, entries: DataFrame, keys: Sequence[str], year: str, won: Column, name: str) -> DataFrame:
    """One row for each edition with its champion, null where none is known; of several winners the least."""
    w = entries.where(won).groupBy(*keys, year).agg(F.min(name).alias("champion"))
    return editions.select(*keys, year).distinct().join(w, [*keys, year], "left")


def title_defence(winners: DataFrame, keys: Sequence[str], year: str) -> DataFrame:
    """winners with the previous edition's champion, and whether the title was defended; null where either is unknown."""
    w = Window.partitionBy(*keys).orderBy(year)
    out = winners.withColumn("before", F.lag("champion").over(w)).withColumn("year_before", F.lag(year).over(w))
    return out.withColumn("defended", F.col("champion") == F.col("before"))


def pair_fates(before: DataFrame, field: DataFrame, pair: Sequence[str], member: str, entry: str) -> DataFrame:
    """What became of earlier pairs in the present field: absent, partial, intact, or split over several entries.

    before: pair, member. field: member, entry. A member in several entries counts with the least.
    """
    now = field.groupBy(member).agg(F.min(entry).alias("__e"))
    x = before.select(*pair, member).distinct().join(now, member, "left").groupBy(*pair).agg(F.count("*").alias("members"), F.count("__e").alias("present"), F.count_distinct("__e").alias("entries"))
    fate = F.when(F.col("present") == 0, "absent").when(F.col("entries") >= 2, "split").when(F.col("present") == F.col("members"), "intact").otherwise("partial")
    return x.withColumn("fate", fate)


def achievers(past: DataFrame, field: DataFrame, shown: DataFrame, key: str, score: Column, day: str, most: int, group: Sequence[str]) -> DataFrame:
    """The best past result of everyone in the field that isn't shown already, up to `most` of each group: better first, then later, then by key."""
    best = past.withColumn("__s", score).groupBy(key).agg(F.max(F.struct("__s", day)).alias("b")).select(key, F.col("b.__s").alias("score"), F.col(f"b.{day}").alias(day))
    x = field.select(key, *group).distinct().join(best, key).join(shown.select(key), key, "left_anti")
    w = Window.partitionBy(*group).orderBy(F.desc("score"), F.desc(day), key)
    return x.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def pathways(junior: DataFrame, senior: DataFrame, name: str, year: str, team: str, homonyms: DataFrame, most_gap: int = 5) -> DataFrame:
    """From the last junior to the first senior team of a name, if the years follow within most_gap and the name isn't several people's."""
    j = junior.where(F.col(team).isNotNull()).groupBy(name).agg(F.max(year).alias("last_junior"), F.max_by(team, F.struct(year, team)).alias("junior_team"))
    s = senior.where(F.col(team).isNotNull()).groupBy(name).agg(F.min(year).alias("first_senior"), F.min_by(team, F.struct(year, team)).alias("senior_team"))
    gap = F.col("first_senior") - F.col("last_junior")
    return j.join(s, name).where((gap > 0) & (gap <= most_gap)).join(homonyms.select(name), name, "left_anti")


def alumni(school: DataFrame, later: DataFrame, name: str, year: str, team: str, score: str) -> DataFrame:
    """Best result after the last school year, with a team that isn't one of the name's school teams."""
    last = school.groupBy(name).agg(F.max(year).alias("last_year"))
    after = later.join(last, name).where(F.col(year) > F.col("last_year")).join(school.select(name, team).distinct(), [name, team], "left_anti").where(F.col(score) > 0)
    best = after.groupBy(name).agg(F.max_by(F.struct(score, year, team), F.struct(score, year, team)).alias("best"), F.max_by(team, F.struct(year, team)).alias("current_team"))
    return best.select(name, *(F.col(f"best.{c}").alias(c) for c in (score, year)), "current_team")


def abandoned(results: DataFrame, keys: Sequence[str], kind: str, rnd: Column) -> DataFrame:
    """results of an abandoned category: ongoing placements become the last 4 or 8 if so many are left, else a lost round."""
    alive = F.sum((F.col(kind) == "ongoing").cast("int")).over(Window.partitionBy(*keys))
    x = results.withColumn("alive", alive)
    final = F.when(F.col(kind) != "ongoing", F.col(kind)).when(F.col("alive") == 4, "best4").when(F.col("alive") == 8, "best8").otherwise("round")
    return x.withColumn("final_kind", final).withColumn("final_round", F.when((F.col(kind) == "ongoing") & ~F.col("alive").isin(4, 8), rnd))


def entry_types(entries: DataFrame, first_round: DataFrame, draw: Sequence[str], entry: str) -> DataFrame:
    """entries with type: packing if two neighbours meet in the first round, else seed if the neighbouring frame is such a match, else extra; null for draws whose size is no power of two.

    first_round: draw, p, q. Neighbours that meet are adjacent numbers, each in one such pair.
    """
    w = Window.partitionBy(*draw).orderBy(entry)
    x = entries.withColumn("__next", F.lead(entry).over(w))
    met = first_round.select(*draw, F.least("p", "q").alias(entry), F.greatest("p", "q").alias("__next"), F.lit(True).alias("__opens")).dropDuplicates()
    x = x.join(met, [*draw, entry, "__next"], "left").withColumn("__opens", F.coalesce("__opens", F.lit(False)))
    # A frame begins at every entry but those that a frame before has taken: in a run of opening entries, every second one.
    x = x.withColumn("__run", F.sum((~F.col("__opens")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy(*draw, F.coalesce("__run", F.lit(0))).orderBy(entry))
    x = x.withColumn("__begins", place % 2 == 1).withColumn("__frame", F.sum(F.col("__begins").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    frames = x.groupBy(*draw, "__frame").agg(F.count("*").alias("__n"))
    size = frames.groupBy(*draw).agg(F.count("*").alias("__size"))
    other = frames.select(*draw, F.col("__frame").bitwiseXOR(F.lit(1).cast("long")).alias("__frame"), F.col("__n").alias("__on"))
    x = x.join(frames, [*draw, "__frame"]).join(other, [*draw, "__frame"], "left").join(size, list(draw))
    kind = F.when(F.col("__size").bitwiseAND(F.col("__size") - 1) != 0, None).when(F.col("__n") == 2, "packing").when(F.col("__on") == 2, "seed").otherwise("extra")
    return x.withColumn("type", kind).select(*entries.columns, "type")


def deepest_standing(matches: DataFrame, keys: Sequence[str], order: Column, won: Column) -> DataFrame:
    """Of each entry the latest round it played, and whether it won that."""
    return matches.groupBy(*keys).agg(F.max(F.struct(order.alias("o"), won.alias("w"))).alias("m")).select(*keys, F.col("m.o").alias("deepest"), F.col("m.w").alias("won_it"))


def placements_in_progress(rows: DataFrame, keys: Sequence[str], depth: str, most: int = 32) -> DataFrame:
    """The entries that have come furthest in each category, unless they are more than `most`."""
    top = rows.groupBy(*keys).agg(F.max(F.when(F.col(depth).isNotNull(), F.col(depth))).alias("__top"))
    x = rows.join(top, list(keys)).where(F.col(depth) == F.col("__top"))
    few = x.groupBy(*keys).agg(F.count("*").alias("leaders")).where(F.col("leaders") <= most)
    return x.join(few, list(keys)).drop("__top")


def majority_name(rows: DataFrame, core: Sequence[str], name: str, place: str, coverage: float = 0.4, share: float = 0.5) -> DataFrame:
    """Master rows: the most frequent spelling of each core (the least of equals), and its place if enough rows have one and enough of those agree."""
    spelled = rows.groupBy(*core, name).agg(F.count("*").alias("__n")).groupBy(*core).agg(F.min_by(name, F.struct(-F.col("__n"), name)).alias(name), F.sum("__n").alias("rows"))
    placed = rows.where(F.col(place).isNotNull()).groupBy(*core, place).agg(F.count("*").alias("__n")).groupBy(*core).agg(F.min_by(F.struct(place, "__n"), F.struct(-F.col("__n"), place)).alias("p"), F.sum("__n").alias("__known"))
    x = spelled.join(placed, list(core), "left")
    sure = (F.col("__known") >= coverage * F.col("rows")) & (F.col("p.__n") >= share * F.col("__known"))
    return x.select(*core, name, "rows", F.when(sure, F.col(f"p.{place}")).alias(place))


def targets(rows: DataFrame, key: str, sets: Sequence[str], day: str, excluded: DataFrame) -> DataFrame:
    """Entities with their number of rows, sorted distinct values of the named columns, and last day; excluded ones left out."""
    return rows.join(excluded.select(key), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"), *(F.array_sort(F.collect_set(s)).alias(f"{s}_set") for s in sets), F.max(day).alias("last_day"))


def two_groupings(rows: DataFrame, a: Sequence[str], b: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """The same aggregates by two sets of keys, in one pass; `by` names the set."""
    every = list(dict.fromkeys([*a, *b]))
    out = rows.groupingSets([[F.col(c) for c in a], [F.col(c) for c in b]], *every).agg(*aggregates, F.grouping_id().alias("__g"))
    first = sum(1 << (len(every) - 1 - i) for i, c in enumerate(every) if c not in a)
    return out.withColumn("by", F.when(F.col("__g") == first, ",".join(a)).otherwise(",".join(b))).drop("__g")


def stories(titles: DataFrame, scores: DataFrame, player: str, year: str, score: str, at: int, streak: int = 3) -> DataFrame:
    """Story rows (kind, player, value) of a year: a title won, a run of years kept up, one stopped, and a personal best."""
    won = titles.where(F.col(year) == at).groupBy(player).agg(F.count("*").alias("value")).select(F.lit("title-won").alias("kind"), player, "value")
    keeps = streak_ending_at(scores, [player], year, at, streak).select(F.lit("streak").alias("kind"), player, F.col("length").alias("value"))
    stops = streak_stopped(scores, [player], year, at, streak).select(F.lit("streak-stopped").alias("kind"), player, F.col("length").alias("value"))
    yearly = scores.groupBy(player, year).agg(F.max(score).alias("__best"))
    best = self_best(yearly, [player], [year], "__best").where(F.col(year) == at).select(F.lit("self-best").alias("kind"), player, F.col("__best").cast("long").alias("value"))
    return reduce(DataFrame.unionByName, [won, keeps, stops, best])


def replay_sequence(matches: DataFrame, order: Sequence[str], usable: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(usable matches, skip counts): each match is dropped for the first of the named conditions that it doesn't meet. Order columns are put first; sorting is left to whoever needs it."""
    reason = F.when(F.lit(False), "")
    for name, condition in usable:
        reason = reason.when(~F.coalesce(condition, F.lit(False)), name)
    x = matches.withColumn("__skip", reason)
    kept = x.where("__skip is null").drop("__skip")
    return kept.select(*order, *(c for c in kept.columns if c not in order)), x.where("__skip is not null").groupBy(F.col("__skip").alias("skipped")).agg(F.count("*").alias("n"))


def infer_point(points: DataFrame, errors: Sequence[str]) -> DataFrame:
    """points with what follows from the rest filled in where it is missing, rule after rule.

    serving_team, winner_team, winner_player, loser_player, rally_count and first_serve_fault are filled; context is in ctx_serving_team,
    ctx_server and ctx_receiver. A player's id begins with the team: A-0-name.
    """
    team = lambda p: F.when(p.rlike("^[AB]-"), F.substring(p, 1, 1))
    other = lambda t: F.when(t == "A", "B").when(t == "B", "A")
    error = F.col("result").isin(*errors)
    x = points.withColumn("serving_team", F.coalesce("serving_team", "ctx_serving_team"))
    x = x.withColumn("winner_team", F.coalesce("winner_team", F.when(error, other(team(F.col("loser_player")))).otherwise(team(F.col("winner_player")))))
    known = F.col("ctx_serving_team").isNotNull()
    ace, double, receive = (known & (F.col("result") == r) for r in ("service_ace", "double_fault", "receive_error"))
    x = x.withColumn("winner_team", F.coalesce("winner_team", F.when(ace | receive, F.col("ctx_serving_team")).when(double, other(F.col("ctx_serving_team")))))
    x = x.withColumn("winner_player", F.coalesce("winner_player", F.when(ace, F.col("ctx_server"))))
    x = x.withColumn("loser_player", F.coalesce("loser_player", F.when(double, F.col("ctx_server")).when(receive, F.col("ctx_receiver"))))
    x = x.withColumn("rally_count", F.coalesce("rally_count", F.when(ace | double, 1).when(receive, 2)))
    return x.withColumn("first_serve_fault", F.when(double, True).otherwise(F.col("first_serve_fault")))


def latest_and_best(rows: DataFrame, keys: Sequence[str], latest: Sequence[Column], best: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Two rows of each key by two orders, side by side."""
    a = first_wins(rows, keys, *latest).select(*keys, *(F.col(c).alias(f"latest_{c}") for c in columns))
    b = first_wins(rows, keys, *best).select(*keys, *(F.col(c).alias(f"best_{c}") for c in columns))
    return a.join(b, list(keys))


def entry_overview(rows: DataFrame, keys: Sequence[str], entry: str, team: str, player: str) -> DataFrame:
    """Distinct entries, teams and players, and how many rows have no team."""
    return rows.groupBy(*keys).agg(F.count_distinct(entry).alias("entries"), F.count_distinct(team).alias("teams"), F.count_distinct(player).alias("players"), count_where(F.col(team).isNull()).alias("without_team"))


def champion_defeats(titles: DataFrame, losses: DataFrame, keys: Sequence[str], year: str, champion: str, loser: str, order: Sequence[Column]) -> DataFrame:
    """For each edition the defeat of the previous year's champion, if there is one: the first by order."""
    before = titles.select(*keys, (F.col(year) + 1).alias(year), F.col(champion).alias(loser))
    return first_wins(losses.join(before, [*keys, year, loser], "left_semi"), [*keys, year], *order)


def feeders(bridge: DataFrame, from_team: str, to_team: str, member: str, least: int = 2) -> DataFrame:
    """The bridge seen from the other side: for each later team the earlier ones that sent at least so many members."""
    return bridge.groupBy(to_team, from_team).agg(F.count_distinct(member).alias("members")).where(F.col("members") >= least)


def oriented(matches: DataFrame, team: Column, a: str, b: str, won_by_a: Column) -> DataFrame:
    """Matches in which a member of a team plays, from the team's side: side, other, won. team: an array of members; a and b: arrays of each side's players. Where both sides are the team's, the first counts."""
    ours = lambda c: F.exists(c, lambda m: F.array_contains(team, m))
    one = matches.where(ours(a)).withColumn("side", F.col(a)).withColumn("other", F.col(b)).withColumn("won", won_by_a)
    two = matches.where(ours(b) & ~ours(a)).withColumn("side", F.col(b)).withColumn("other", F.col(a)).withColumn("won", ~won_by_a)
    return one.unionByName(two)
