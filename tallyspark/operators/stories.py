"""Stories about knockout draws: the frontier of one that is being played, held against the best that its players and teams have reached before, and what a finished one says.

An edition is a draw of a cup in a year. matches: keys, round (1 is the first), winner, loser; undecided ones have no winner. members: keys, entry, player, team,
a row for each player. history: cup, name, yr, score, the best placing of a name in an edition, on the scale of `LEVELS`.
Stories have the columns of `STORY`; what value, prior and other hold is said at each detector.

Scale: everything is grouped by edition, entry or name; an edition's number of entries left and its deepest round are one row each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import first_wins
from .sequences import streak_ending_at

# Score of a placing, by how many rounds before the end an entry lost; the winner has 100.
LEVELS = {0: 90, 1: 80, 2: 70}
TITLE, LAST_EIGHT = 100, 70
STORY = ["cup", "kind", "subject", "round", "value", "prior", "other"]


def placings(matches: DataFrame, keys: Sequence[str], final: str = "final") -> DataFrame:
    """(keys, entry, score) of entries that came among the last eight. matches also has `final`, the number of its edition's last round."""
    left = F.col(final) - F.col("round")
    lost = matches.where("winner is not null and loser is not null").select(*keys, F.col("loser").alias("entry"), reduce(lambda c, kv: c.when(left == kv[0], kv[1]), LEVELS.items(), F.when(F.lit(False), 0)).alias("score"))
    won = matches.where((F.col("winner").isNotNull()) & (left == 0)).select(*keys, F.col("winner").alias("entry"), F.lit(TITLE).alias("score"))
    return lost.unionByName(won).where("score is not null").groupBy(*keys, "entry").agg(F.max("score").cast("long").alias("score"))


def history_of(placed: DataFrame, members: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(keys, name, score): the best placing of each player or team of an edition."""
    return placed.join(members.select(*keys, "entry", F.col(name).cast("string").alias("name")).where("name is not null").distinct(), [*keys, "entry"]).groupBy(*keys, "name").agg(F.max("score").alias("score"))


def frontier(members: DataFrame, matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where each entry stands: won_at (deepest round won), lost_at and lost_to, state (alive, out, or unknown for those that no decided match names), and for its edition remaining, as_of (deepest decided round) and guaranteed.

    guaranteed is the placing that all who are left have for sure. It follows from how many are left and not from the round, whose depth differs
    between draws; null while more than eight are left. Nothing in an edition without a decided match.
    """
    decided = matches.where("winner is not null")
    won = decided.groupBy(*keys, F.col("winner").alias("entry")).agg(F.max("round").alias("won_at"))
    lost = decided.where("loser is not null").groupBy(*keys, F.col("loser").alias("entry")).agg(F.max(F.struct("round", "winner")).alias("l"))
    x = members.select(*keys, "entry").distinct().join(won, [*keys, "entry"], "left").join(lost, [*keys, "entry"], "left")
    x = x.select(*keys, "entry", "won_at", F.col("l.round").alias("lost_at"), F.col("l.winner").alias("lost_to"))
    left = x.groupBy(*keys).agg(F.count(F.when(F.col("lost_at").isNull(), 1)).alias("remaining"))
    edition = left.join(decided.groupBy(*keys).agg(F.max("round").alias("as_of")), list(keys))
    sure = F.when(F.col("remaining") <= 2, 90).when(F.col("remaining") <= 4, 80).when(F.col("remaining") <= 8, 70).cast("long")
    state = F.when(F.col("lost_at").isNotNull(), "out").when(F.col("won_at").isNotNull(), "alive").otherwise("unknown")
    return x.join(edition.withColumn("guaranteed", sure), list(keys)).withColumn("state", state)


def _story(rows: DataFrame, kind: str, subject: Column, rnd: Column | None = None, value: Column | None = None, prior: Column | None = None, other: Column | None = None) -> DataFrame:
    long = lambda c, n: (F.lit(None) if c is None else c).cast("long").alias(n)
    return rows.select(F.col("cup"), F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), long(rnd, "round"), long(value, "value"), long(prior, "prior"), long(other, "other"))


def in_progress(members: DataFrame, matches: DataFrame, players: DataFrame, teams: DataFrame, year: int, team_event: bool = False) -> DataFrame:
    """Stories of the editions of `year`, as far as they are played. members and matches: cup, yr and the rest; players and teams: histories.

    Watched are those with a placing in the cup's latest edition before; a cup without one has no stories. Of an entry with watched members:
    watched-eliminated (round and other: where and to whom it lost; value: the longest run of placings that ends with it) or
    watched-advancing (round: the deepest won). Of a watched player who is left, watched-self-best once the guaranteed placing (value) equals or passes
    their best (prior; other is 1 for equal). Of a team that is left: watched-title-watch (value: guaranteed, prior: year of the last title, other: years since) and
    watched-school-peak (as self-best). Of each team watched: watched-school-progress (entries left, lost and unknown in value, prior and other), as soon as one
    is decided. In a team event players' and progress stories don't apply, and the watched are teams.
    """
    now, before = F.col("yr") == year, F.col("yr") < year
    front = frontier(members.where(now), matches.where(now), ["cup"])
    last = members.where(before).groupBy("cup").agg(F.max("yr").alias("last_year"))
    seats = members.where(now).select("cup", "entry", F.col("player").cast("string").alias("player"), F.col("team").cast("string").alias("team"))
    past = {k: h.where(before) for k, h in (("player", players), ("team", teams))}
    watched = {k: h.join(last, "cup").where("yr = last_year").select("cup", F.col("name").alias(k)).distinct() for k, h in past.items()}
    who = "team" if team_event else "player"

    runs = past[who].join(last, "cup").where(F.col("score") >= LAST_EIGHT)
    # The run of years that ends with the cup's last edition; cups may differ in when that was.
    runs = runs.withColumn("back", F.col("last_year") - F.col("yr")).groupBy("cup", "name").agg(F.array_sort(F.collect_set("back")).alias("b"))
    runs = runs.select("cup", F.col("name").alias(who), F.size(F.filter("b", lambda v, i: v == i)).alias("run"))
    held = seats.select("cup", "entry", who).distinct().join(watched[who], ["cup", who]).join(runs, ["cup", who], "left")
    entries = held.groupBy("cup", "entry").agg(F.array_join(F.array_sort(F.collect_set(who)), ",").alias("names"), F.max(F.coalesce("run", F.lit(0))).alias("run")).join(front, ["cup", "entry"])
    out = [
        _story(entries.where("state = 'out'"), "watched-eliminated", F.col("names"), F.col("lost_at"), F.col("run"), other=F.col("lost_to")),
        _story(entries.where("state = 'alive'"), "watched-advancing", F.col("names"), F.col("won_at")),
    ]
    best = {k: h.groupBy("cup", F.col("name").alias(k)).agg(F.max("score").alias("best"), F.max(F.when(F.col("score") == TITLE, F.col("yr"))).alias("title")) for k, h in past.items()}
    if not team_event:
        alive = front.where("state = 'alive' and guaranteed is not null").join(held.select("cup", "entry", "player"), ["cup", "entry"]).join(best["player"], ["cup", "player"])
        out.append(_story(alive.where("guaranteed >= best"), "watched-self-best", F.col("player"), F.col("won_at"), F.col("guaranteed"), F.col("best"), (F.col("guaranteed") == F.col("best")).cast("int")))
    # Entries that no match names aren't lost, so their teams are still there.
    there = front.where("state <> 'out' and guaranteed is not null").join(seats.where("team is not null"), ["cup", "entry"]).select("cup", "team", "guaranteed").distinct().join(best["team"], ["cup", "team"])
    out.append(_story(there.where("title is not null"), "watched-title-watch", F.col("team"), None, F.col("guaranteed"), F.col("title"), F.lit(year) - F.col("title")))
    out.append(_story(there.where("guaranteed >= best"), "watched-school-peak", F.col("team"), None, F.col("guaranteed"), F.col("best"), (F.col("guaranteed") == F.col("best")).cast("int")))
    if not team_event:
        n = lambda s: F.count(F.when(F.col("state") == s, 1))
        own = seats.select("cup", "entry", "team").distinct().join(watched["team"], ["cup", "team"]).join(front, ["cup", "entry"]).groupBy("cup", "team").agg(n("alive").alias("alive"), n("out").alias("lost"), n("unknown").alias("unknown"))
        out.append(_story(own.where("alive + lost > 0"), "watched-school-progress", F.col("team"), None, F.col("alive"), F.col("lost"), F.col("unknown")))
    return reduce(DataFrame.unionByName, out)


def both_events(team_event: DataFrame, individual: DataFrame, year: int, least: int = 3) -> DataFrame:
    """school-both-events: teams placed in both events in each of at least `least` years up to `year` (value: how many, prior: since when)."""
    both = team_event.select("cup", "name", "yr").distinct().join(individual.select("cup", "name", "yr").distinct(), ["cup", "name", "yr"])
    runs = streak_ending_at(both, ["cup", "name"], "yr", year, least)
    return _story(runs, "school-both-events", F.col("name"), None, F.col("length"), F.col("first_year"))


def finished(matches: DataFrame, players: DataFrame, teams: DataFrame, year: int, player_run: int = 3, team_run: int = 4) -> DataFrame:
    """Stories of finished editions of `year`: best8-streak and school-best8-streak (value: years in a row among the last eight, prior: since when), and pair-rematch (of each pair's first
    match this year: round; value: the year they met last before; prior: its round; other: 1 if the one who lost then has won)."""
    out = []
    for kind, history, least in (("best8-streak", players, player_run), ("school-best8-streak", teams, team_run)):
        runs = streak_ending_at(history.where(F.col("score") >= LAST_EIGHT), ["cup", "name"], "yr", year, least)
        out.append(_story(runs, kind, F.col("name"), None, F.col("length"), F.col("first_year")))
    met = matches.where("winner is not null and loser is not null").select("cup", "yr", "round", "winner", F.least("winner", "loser").alias("a"), F.greatest("winner", "loser").alias("b"))
    pair = ["cup", "a", "b"]
    now = first_wins(met.where(F.col("yr") == year), pair, F.asc("round")).select(*pair, "round", "winner")
    then = first_wins(met.where(F.col("yr") < year), pair, F.desc("yr"), F.desc("round")).select(*pair, F.col("yr").alias("last_yr"), F.col("round").alias("last_round"), F.col("winner").alias("last_winner"))
    again = now.join(then, pair)
    out.append(_story(again, "pair-rematch", F.concat_ws(",", "a", "b"), F.col("round"), F.col("last_yr"), F.col("last_round"), (F.col("winner") != F.col("last_winner")).cast("int")))
    return reduce(DataFrame.unionByName, out)


def giant_killings(upsets: DataFrame, matches: DataFrame) -> DataFrame:
    """upsets (match, chance, rating_gap) with the winners and losers of the match, as sorted arrays. matches: match, side_a, side_b, a_won."""
    side = lambda won: F.array_sort(F.when(F.col("a_won") == won, F.col("side_a")).otherwise(F.col("side_b")))
    return upsets.join(matches.select("match", side(True).alias("winners"), side(False).alias("losers")), "match")
