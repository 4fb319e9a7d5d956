"""Point logs: one row a point, ordered by game and point number within a match. Running state, per-side metrics, comparisons and hints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import is_deuce, is_winning_score, points_to_win, rally_band
from ..functions.numbers import percentage, reliability, trend
from .aggregates import count_where
from .sequences import running_score

# Results that win a point, and errors that lose one.
WINNERS = ("smash_winner", "volley_winner", "passing_winner", "drop_winner", "net_in_winner", "service_ace", "winner")
ERRORS = ("net", "out", "smash_error", "volley_error", "double_fault", "follow_error", "receive_error", "forced_error", "unforced_error")


def reconstruct(points: DataFrame, games: DataFrame) -> DataFrame:
    """points with games won before, the points that win the game, score before and after, and whether it is the deciding game.

    points: match, game, point, winner (A, B or null). games: match, game, best_of, winner (A, B or null).
    """
    g = running_score(games.withColumnRenamed("winner", "game_winner"), ["match"], ["game"], F.col("game_winner"))
    g = g.withColumn("target", points_to_win(F.col("best_of"), F.col("before_A"), F.col("before_B")))
    g = g.select("match", "game", "best_of", "game_winner", F.col("before_A").alias("games_A"), F.col("before_B").alias("games_B"), "target")
    x = running_score(points, ["match", "game"], ["point"], F.col("winner"))
    x = x.join(g, ["match", "game"])
    final = (F.col("games_A") == F.floor(F.col("best_of") / 2)) & (F.col("games_B") == F.floor(F.col("best_of") / 2))
    return x.withColumn("final", final).withColumn("deuce", is_deuce(F.col("before_A"), F.col("before_B"), F.col("target")))


def by_side(points: DataFrame) -> DataFrame:
    """Two rows a point, from either side: side, won, own and other score before, serving, game point."""
    side = F.explode(F.array(F.lit("A"), F.lit("B")))
    x = points.withColumn("side", side)
    mine = F.col("side") == "A"
    own, other = F.when(mine, F.col("before_A")).otherwise(F.col("before_B")), F.when(mine, F.col("before_B")).otherwise(F.col("before_A"))
    return x.withColumn("won", F.when(F.col("winner").isNotNull(), F.col("winner") == F.col("side"))).withColumn("own", own).withColumn("other", other).withColumn("game_point", is_winning_score(own + 1, other, F.col("target"))).withColumn("serves", F.col("serving") == F.col("side"))


def side_metrics(sides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every ratio metric of a side in one pass, as part and whole: metric, part, whole, rate (percentage), reliability."""
    band = rally_band(F.col("rally"), F.col("double_fault"), "growth")
    every = F.lit(True)
    metrics: Mapping[str, Column] = {
        "points": every,
        "on_serve": F.col("serves"),
        "on_return": ~F.col("serves"),
        "game_point": F.col("game_point"),
        "deuce": F.col("deuce"),
        "deciding_game": F.col("final"),
        "first_point": F.col("point") == 1,
        "short_rally": band == "short",
        "middle_rally": band == "middle",
        "long_rally": band == "long",
    }
    parts = [c for n, m in metrics.items() for c in (count_where(m & F.col("won")).alias(f"p_{n}"), count_where(m).alias(f"w_{n}"))]
    x = sides.where("won is not null").groupBy(*keys).agg(*parts)
    each = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"p_{n}").alias("part"), F.col(f"w_{n}").alias("whole")) for n in metrics))
    x = x.select(*keys, F.explode(each).alias("m")).select(*keys, "m.*")
    return x.withColumn("rate", percentage(F.col("part"), F.col("whole"))).withColumn("reliability", reliability(F.col("whole"), 5))


def side_profile(points: DataFrame, games: DataFrame) -> DataFrame:
    """(match, side, metric, part, whole): sixteen rates of a side of a match and three counts of lost streaks (whole is null there).

    points also has first_serve_fault. A point without a winner counts in wholes, neither ends nor lengthens a streak. `after_two_lost` are points before which
    two or more in a row were lost, over games; `lead_held` are games led by two points or more at some time, and won.
    """
    x = by_side(reconstruct(points, games)).withColumn("__over", F.when(F.col("side") == "A", F.col("after_A") - F.col("after_B")).otherwise(F.col("after_B") - F.col("after_A")))
    so_far = lambda *k: Window.partitionBy("match", "side", *k).orderBy("game", "point").rowsBetween(Window.unboundedPreceding, -1)
    won, lost = F.coalesce(F.col("won"), F.lit(False)), F.coalesce(~F.col("won"), F.lit(False))
    x = x.withColumn("__run", F.coalesce(F.count_if(won).over(so_far()), F.lit(0))).withColumn("__lost", F.coalesce(F.count_if(lost).over(so_far("__run")), F.lit(0)))
    serves, second = F.col("serves"), F.coalesce(F.col("first_serve_fault"), F.lit(False))
    band = rally_band(F.col("rally"), F.col("double_fault"), "growth")
    facing = is_winning_score(F.col("other") + 1, F.col("own"), F.col("target"))
    wins: Mapping[str, Column] = {
        "on_serve": serves,
        "first_serve": serves & ~second,
        "second_serve": serves & second,
        "on_return": ~serves,
        "two_all": (F.col("own") == 2) & (F.col("other") == 2),
        "deuce": F.col("deuce"),
        "game_point": F.col("game_point"),
        "game_point_saved": facing,
        "deciding_game": F.col("final"),
        "after_two_lost": F.col("__lost") >= 2,
        "short_rally": band == "short",
        "middle_rally": band == "middle",
        "long_rally": band == "long",
    }
    pairs: dict[str, tuple[Column, Column]] = {m: (c & won, c) for m, c in wins.items()}
    pairs["first_serve_in"] = (serves & ~second, serves)
    pairs["double_fault"] = (serves & F.coalesce(F.col("double_fault"), F.lit(False)), serves)
    counts = {"lost_three": lost & (F.col("__lost") == 2), "lost_four": lost & (F.col("__lost") == 3)}
    each = [c for m, (p, w) in pairs.items() for c in (count_where(p).alias(f"p_{m}"), count_where(w).alias(f"w_{m}"))] + [count_where(c).alias(f"p_{m}") for m, c in counts.items()]
    longest = F.max(F.when(lost, F.col("__lost") + 1).otherwise(0)).alias("p_lost_longest")
    game = x.groupBy("match", "side", "game").agg(*each, longest, F.bool_or(F.col("__over") >= 2).alias("__led"), F.max("game_winner").alias("__by"))
    total = [F.sum(c).alias(c) for m in pairs for c in (f"p_{m}", f"w_{m}")] + [F.sum(f"p_{m}").alias(f"p_{m}") for m in counts]
    held = [count_where(F.col("__led") & (F.col("__by") == F.col("side"))).alias("p_lead_held"), count_where(F.col("__led")).alias("w_lead_held")]
    of = game.groupBy("match", "side").agg(*total, F.max("p_lost_longest").cast("long").alias("p_lost_longest"), *held)
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"p_{m}").alias("part"), F.col(f"w_{m}").alias("whole")) for m in (*pairs, "lead_held")]
    rows += [F.struct(F.lit(m).alias("metric"), F.col(f"p_{m}").alias("part"), F.lit(None).cast("long").alias("whole")) for m in (*counts, "lost_longest")]
    return of.select("match", "side", F.explode(F.array(*rows)).alias("m")).select("match", "side", "m.*")


def both_sides(profile: DataFrame, sides: Sequence[str] = ("A", "B")) -> DataFrame:
    """(match, metric, part_x, whole_x, rate_x for each side x): a match seen from both sides, one row a metric."""
    mine = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s.lower()}")
    x = profile.groupBy("match", "metric").agg(*(mine(s, c) for s in sides for c in ("part", "whole")))
    return x.withColumns({f"rate_{s.lower()}": percentage(F.col(f"part_{s.lower()}"), F.col(f"whole_{s.lower()}")) for s in sides})


def combine(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial ratios over several matches: parts and wholes add up."""
    x = metrics.groupBy(*keys, "metric").agg(F.sum("part").alias("part"), F.sum("whole").alias("whole"))
    return x.withColumn("rate", percentage(F.col("part"), F.col("whole")))


def compare(current: DataFrame, previous: DataFrame, keys: Sequence[str], stable: float = 2.0, small: int = 5, enough: int = 10, lower_is_better: Sequence[str] = ()) -> DataFrame:
    """Each metric now and before: delta, trend and confidence by the smaller sample."""
    p = previous.select(*keys, "metric", F.col("rate").alias("rate_before"), F.col("whole").alias("whole_before"))
    x = current.join(p, [*keys, "metric"]).withColumn("delta", F.col("rate") - F.col("rate_before"))
    least = F.least("whole", "whole_before")
    better = ~F.col("metric").isin(*lower_is_better) if lower_is_better else F.lit(True)
    return x.withColumn("trend", trend(F.col("delta"), better, stable)).withColumn("confidence", F.when(least < small, "low").when(least < enough, "medium").otherwise("high"))


def practice_themes(compared: DataFrame, keys: Sequence[str], themes: DataFrame, most: int = 3) -> DataFrame:
    """The most declined metrics that have a theme (metric, theme)."""
    w = Window.partitionBy(*keys).orderBy("delta", "metric")
    x = compared.where("trend = 'declined'").join(themes, "metric")
    return x.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def hints(metrics: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """(keys, hint, metric, part, whole, rate): evidence rows of the rules (hint, metric, condition) that fire on reliable metrics."""
    parts = [metrics.where((F.col("metric") == m) & (F.col("reliability") == "ok") & c).select(*keys, F.lit(h).alias("hint"), "metric", "part", "whole", "rate") for h, m, c in rules]
    return reduce(DataFrame.unionByName, parts)


def error_breakdown(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each error's count and percentage of all errors of a group."""
    x = points.where(F.col("result").isin(*ERRORS)).groupBy(*keys, "result").agg(F.count("*").alias("n"))
    return x.withColumn("share", percentage(F.col("n"), F.sum("n").over(Window.partitionBy(*keys))))


def score_conflicts(points: DataFrame, games: DataFrame) -> DataFrame:
    """Games whose stored score differs from their points'."""
    c = points.groupBy("match", "game").agg(count_where(F.col("winner") == "A").alias("computed_a"), count_where(F.col("winner") == "B").alias("computed_b"))
    return games.join(c, ["match", "game"]).where("points_a <> computed_a OR points_b <> computed_b").select("match", "game", "points_a", "points_b", "computed_a", "computed_b")


def boundary_candidates(sessions: DataFrame, keys: Sequence[str], start: str, end: str, step_ms: int, window_ms: int) -> DataFrame:
    """A candidate window at every step of a recording, clipped to it: number, from_ms, to_ms."""
    last = F.greatest(F.col(end) - 1, F.col(start))
    x = sessions.select(*keys, start, end, F.posexplode(F.sequence(F.col(start), last, F.lit(step_ms).cast("long"))).alias("number", "__at"))
    x = x.where(F.col("__at") < F.col(end))
    return x.select(*keys, "number", F.greatest(F.col("__at") - window_ms, F.col(start)).alias("from_ms"), F.least(F.col("__at") + window_ms, F.col(end)).alias("to_ms"))


def rare_events(points: DataFrame, min_rally: int = 9, deuce_points: int = 9, deficit: int = 2, max_ties: int = 3) -> DataFrame:
    """(event, match, game, value): the longest rally, game and comeback of all, each with its ties unless there are too many."""
    from .sequences import comebacks, extremes

    one = lambda d: d.withColumn("__one", F.lit(1))
    rally = extremes(one(points.where(F.col("rally") >= min_rally)), ["__one"], F.col("rally"), max_ties).select(F.lit("longest_rally").alias("event"), "match", "game", F.col("rally").cast("long").alias("value"))
    length = points.groupBy("match", "game").agg(F.count("*").alias("value")).where(F.col("value") >= deuce_points)
    long = extremes(one(length), ["__one"], F.col("value"), max_ties).select(F.lit("longest_game").alias("event"), "match", "game", "value")
    gained = F.when(F.col("winner") == "A", 1).when(F.col("winner") == "B", -1).otherwise(0)
    back = comebacks(points, ["match", "game"], ["point"], gained).where(F.col("deficit") >= deficit)
    turn = extremes(one(back), ["__one"], F.col("deficit"), max_ties).select(F.lit("largest_comeback").alias("event"), "match", "game", F.col("deficit").cast("long").alias("value"))
    return rally.unionByName(long).unionByName(turn)
