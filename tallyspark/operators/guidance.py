"""What to look at again after a match: metrics of a side as rows, rules and cards as data, and the points behind each hint.

A match's points are joined and windowed by match only, so everything up to the hints shares one partitioning by match. Rules and
cards are small fixed tables (a row for each rule), so they are broadcast whatever the size of the log.

Points: match, game, point, winner (A, B or null), serving, rally, double_fault, first_serve_fault, result, loser_player; games as in
`points.reconstruct`. A point without a winner counts in wholes and is won by nobody; flags that are null count as false.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.labels import is_winning_score, rally_band
from ..functions.numbers import percentage
from .aggregates import count_where
from .points import ERRORS, WINNERS, by_side, reconstruct
from .sequences import longest_segments

SIDE = ["match", "side"]


class Rule(NamedTuple):
    """A hint fires if the metric's value is beyond `limit` (below it, or from it on where `rising`), `drop` points or more under the side's share of all points, or if `extra` reaches `extra_limit`.

    It needs `least` cases in its part, and in its guard metric a rate of at least `guard`. Its signal is strong beyond the limits named so;
    the priority is base + gap (points under the limit, or under the overall share where there is a `drop`) + weights of value, part and extra + the whole up to `cap`.
    """

    rule: str
    metric: str
    limit: float
    sample: int
    base: float
    rising: bool = False
    drop: float | None = None
    least: int = 0
    guard: float | None = None
    extra_limit: int | None = None
    strong: float | None = None
    strong_drop: float | None = None
    strong_extra: int | None = None
    gap: float = 0.0
    by_value: float = 0.0
    by_part: float = 0.0
    by_extra: float = 0.0
    cap: int = 0


# Thresholds of the hints.
RULES = (
    Rule("first_serve_in", "first_serve_in", 55, 5, 48, strong=45, gap=1, cap=12),
    Rule("first_serve_points", "first_serve_points", 45, 5, 52, drop=12, guard=55, strong_drop=12, gap=1, cap=12),
    Rule("second_serve_points", "second_serve_points", 40, 3, 56, extra_limit=2, strong=30, strong_extra=3, gap=1, by_extra=4),
    Rule("receive_points", "receive_points", 40, 5, 44, drop=12, strong_drop=12, gap=1, cap=12),
    Rule("rally_short", "rally_short", 40, 5, 42, drop=12, strong_drop=12, gap=1, cap=10),
    Rule("rally_medium", "rally_medium", 40, 5, 42, drop=12, strong_drop=12, gap=1, cap=10),
    Rule("rally_long", "rally_long", 40, 5, 42, drop=12, strong_drop=12, gap=1, cap=10),
    Rule("game_points", "game_points", 40, 3, 50, drop=12, strong_drop=12, gap=1, cap=8),
    Rule("saved_game_points", "saved_game_points", 35, 3, 45, strong=25, gap=1, cap=8),
    Rule("lost_streak", "lost_streak", 5, 5, 54, rising=True, strong=7, by_value=3),
    Rule("error_share", "error_share", 40, 3, 40, rising=True, least=3, strong=55, by_value=0.5, by_part=3),
    Rule("player_share", "player_share", 60, 3, 38, rising=True, least=3, strong=70, by_value=0.5, by_part=3),
)
_RULE_SCHEMA = (
    "rule string, metric string, limit double, r_sample int, base double, rising boolean, drop_limit double, least int, guard_limit double, extra_limit int, "
    "strong double, strong_drop double, strong_extra int, gap double, by_value double, by_part double, by_extra double, cap int"
)


class Card(NamedTuple):
    """A summary of one metric, or of two by the difference of their values: `high` from `over` on, `low` at most (or, if strict, below) `under`, else `even`."""

    card: str
    metric: str
    other: str | None
    sample: int
    over: float
    high: str
    even: str
    under: float | None = None
    low: str | None = None
    strict: bool = False


# Thresholds of the cards. A sample of 0 asks for any point of the match at all.
CARDS = (
    Card("service", "first_serve_points", None, 5, 60, "wins points", "look at the start", 45, "look at what follows", True),
    Card("key_moments", "game_points", None, 3, 50, "takes them", "look at them"),
    Card("momentum", "lost_streak", None, 0, 5, "long streak lost", "look at pauses"),
    Card("rallies", "rally_short", "rally_long", 5, 10, "short ones", "alike", -10, "long ones"),
    Card("endings", "winners", "errors_of_other", 0, 3, "own winners", "alike", -3, "errors of the other"),
)
_CARD_SCHEMA = "card string, c_metric string, other string, c_sample int, over double, high string, even string, under double, low string, strict boolean"


def _fixed(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A fixed table to broadcast; whole numbers may stand for doubles."""
    doubles = [f.dataType.typeName() == "double" for f in StructType.fromDDL(schema)]
    cells = [tuple(float(v) if d and v is not None else v for v, d in zip(r, doubles, strict=True)) for r in rows]
    return F.broadcast(spark.createDataFrame(cells, schema))


def sides_of(points: DataFrame, games: DataFrame) -> DataFrame:
    """Two rows a point with the flags that metrics and groups of points are made from; `at` orders a match's points."""
    false = lambda c: F.coalesce(c, F.lit(False))
    x = by_side(reconstruct(points, games).withColumn("double_fault", false(F.col("double_fault"))))
    x = x.withColumn("at", F.struct("game", "point"))
    lost = F.col("winner").isNotNull() & (F.col("winner") != F.col("side"))
    band = rally_band(F.col("rally"), F.col("double_fault"))
    return x.select(
        *SIDE,
        "game",
        "point",
        "at",
        "rally",
        "result",
        "loser_player",
        false(F.col("won")).alias("won"),
        lost.alias("lost"),
        false(F.col("serves")).alias("serves"),
        false(F.col("serving") != F.col("side")).alias("receives"),
        false(F.col("first_serve_fault")).alias("fault"),
        "double_fault",
        false(F.col("game_point")).alias("game_point"),
        false(is_winning_score(F.col("other") + 1, F.col("own"), F.col("target"))).alias("against_game_point"),
        (F.col("point") == 1).alias("opens"),
        ((F.col("own") == 2) & (F.col("other") == 2)).alias("two_all"),
        "deuce",
        band.isin("1-2", "3-4").alias("short"),
        (band == "5-8").alias("medium"),
        (band == "9+").alias("long"),
        false(F.col("result").isin(*ERRORS)).alias("error"),
        false(F.col("result").isin(*WINNERS)).alias("winning"),
    )


def lost_streaks(points: DataFrame) -> DataFrame:
    """(match, side, length, first_at, last_at): the longest run of points that a side lost, the first of equals, over the borders of games. A point without a winner ends a run."""
    runs = longest_segments(points.select("match", "winner", F.struct("game", "point").alias("at")), ["match"], ["at"], "winner").where("winner IN ('A', 'B')")
    return runs.select("match", F.when(F.col("winner") == "A", "B").otherwise("A").alias("side"), "length", "first_at", "last_at")


def side_facts(sides: DataFrame, streaks: DataFrame, players: DataFrame) -> DataFrame:
    """(match, side, metric, detail, part, whole, sample, value, drop, extra, guard): all metrics of a side as rows.

    Rates are percentages, null where nothing was counted. extra and guard: the double faults beside points on second serves, the first serves in beside points on those.
    error_share has a row for each of the two most frequent errors, player_share one for the player who ends most lost points with an
    error, where the side has two or more players (match, side, player) and such points; equals go by name.
    """
    every = F.lit(True)
    rates: dict[str, tuple[Column, Column]] = {
        "points": (every, F.col("won")),
        "first_serve_in": (F.col("serves"), ~F.col("fault")),
        "first_serve_points": (F.col("serves") & ~F.col("fault"), F.col("won")),
        "second_serve_points": (F.col("serves") & F.col("fault"), F.col("won")),
        "receive_points": (F.col("receives"), F.col("won")),
        "rally_short": (F.col("short"), F.col("won")),
        "rally_medium": (F.col("medium"), F.col("won")),
        "rally_long": (F.col("long"), F.col("won")),
        "game_points": (F.col("game_point"), F.col("won")),
        "saved_game_points": (F.col("against_game_point"), F.col("won")),
        "first_of_game": (F.col("opens"), F.col("won")),
        "two_all": (F.col("two_all"), F.col("won")),
        "deuce": (F.col("deuce"), F.col("won")),
    }
    counts = {"winners": F.col("winning") & F.col("won"), "errors_of_other": F.col("error") & F.col("won"), "double_faults": F.col("serves") & F.col("double_fault")}
    parts = [c for n, (among, hit) in rates.items() for c in (count_where(among).alias(f"w_{n}"), count_where(among & hit).alias(f"p_{n}"))]
    parts += [count_where(c).alias(f"p_{n}") for n, c in counts.items()]
    agg = sides.groupBy(*SIDE).agg(*parts)

    rate = lambda n: percentage(F.col(f"p_{n}"), F.col(f"w_{n}"))
    nothing = F.lit(None)

    def row(metric: str, part: Column, whole: Column, sample: Column, value: Column, drop: Column = nothing, extra: Column = nothing, guard: Column = nothing, detail: Column = nothing) -> Column:
        return F.struct(F.lit(metric).alias("metric"), detail.cast("string").alias("detail"), part.cast("long").alias("part"), whole.cast("long").alias("whole"), sample.cast("long").alias("sample"), value.cast("double").alias("value"), drop.cast("double").alias("drop"), extra.cast("long").alias("extra"), guard.cast("double").alias("guard"))

    def rate_row(n: str) -> Column:
        part, whole = F.col(f"p_{n}"), F.col(f"w_{n}")
        faults = F.col("p_double_faults") if n == "second_serve_points" else nothing
        sample = whole + F.col("p_double_faults") if n == "second_serve_points" else whole
        return row(n, part, whole, sample, rate(n), rate("points") - rate(n), faults, rate("first_serve_in") if n == "first_serve_points" else nothing)

    length = F.coalesce("length", F.lit(0))
    rows = [rate_row(n) for n in rates] + [row(n, F.col(f"p_{n}"), F.col("w_points"), F.col("p_" + n), F.col(f"p_{n}")) for n in counts]
    rows.append(row("lost_streak", length, F.col("w_points"), length, length))
    agg = agg.join(streaks, SIDE, "left")

    whole, n = F.col("whole"), F.col("n")
    by_result = sides.where("lost AND error").groupBy(*SIDE, "result").agg(F.count("*").alias("n"))
    by_result = by_result.withColumn("whole", F.sum("n").over(Window.partitionBy(*SIDE))).withColumn("place", F.row_number().over(Window.partitionBy(*SIDE).orderBy(F.desc("n"), "result"))).where("place <= 2")
    errors = by_result.select(*SIDE, row("error_share", n, whole, n, percentage(n, whole), detail=F.col("result")).alias("m"))

    members = players.select(*SIDE, F.col("player").alias("loser_player")).distinct().withColumn("members", F.count("*").over(Window.partitionBy(*SIDE))).where("members > 1")
    by_player = sides.where("lost AND error AND loser_player IS NOT NULL").groupBy(*SIDE, "loser_player").agg(F.count("*").alias("n")).join(members, [*SIDE, "loser_player"])
    top = by_player.groupBy(*SIDE).agg(F.min_by(F.struct("loser_player", "n"), F.struct(-n, "loser_player")).alias("top"), F.sum("n").alias("whole")).select(*SIDE, "top.*", "whole")
    player = top.select(*SIDE, row("player_share", n, whole, n, percentage(n, whole), detail=F.col("loser_player")).alias("m"))
    return agg.select(*SIDE, F.explode(F.array(*rows)).alias("m")).unionByName(errors).unionByName(player).select(*SIDE, "m.*")


def improvement_hints(facts: DataFrame, rules: Sequence[Rule] = RULES, most: int | None = 3) -> DataFrame:
    """(match, side, rule, detail, part, whole, value, drop, confidence, priority, place): the hints of a side by falling priority, the first `most` of them.

    confidence: low below the rule's sample, high at twice the sample with a strong signal, else medium. Equal priorities go by rule and detail.
    """
    r = _fixed(facts.sparkSession, rules, _RULE_SCHEMA)
    x = facts.where("whole > 0").join(r, "metric")
    value, drop, extra = F.col("value"), F.col("drop"), F.coalesce("extra", F.lit(0))
    no = lambda c: F.coalesce(c, F.lit(False))
    beyond = lambda limit: no(F.when(F.col("rising"), value >= F.col(limit)).otherwise(value < F.col(limit)))
    fires = beyond("limit") | no(drop >= F.col("drop_limit")) | no(extra >= F.col("extra_limit"))
    guarded = F.col("guard_limit").isNull() | no(F.col("guard") >= F.col("guard_limit"))
    x = x.where(fires & guarded & (F.col("part") >= F.col("least")))
    strong = beyond("strong") | no(drop >= F.col("strong_drop")) | no(extra >= F.col("strong_extra"))
    gap = F.when(F.col("drop_limit").isNotNull(), drop).otherwise(F.col("limit") - value)
    gap = F.when(F.col("gap") > 0, F.greatest(F.coalesce(gap, F.lit(0.0)), F.lit(0.0)) * F.col("gap")).otherwise(0.0)
    priority = F.col("base") + gap + value * F.col("by_value") + F.col("part") * F.col("by_part") + extra * F.col("by_extra") + F.least("whole", "cap")
    sample = F.col("r_sample")
    confidence = F.when(F.col("sample") < sample, "low").when(strong & (F.col("sample") >= sample * 2), "high").otherwise("medium")
    x = x.select("*", confidence.alias("confidence"), F.round(priority, 6).alias("priority"))
    if most is not None:
        x = x.withColumn("place", F.row_number().over(Window.partitionBy(*SIDE).orderBy(F.desc("priority"), "rule", F.asc_nulls_first("detail")))).where(F.col("place") <= most)
    return x.select(*SIDE, "rule", "detail", "part", "whole", "value", "drop", "confidence", "priority", *(["place"] if most is not None else []))


def guide_cards(facts: DataFrame, cards: Sequence[Card] = CARDS) -> DataFrame:
    """(match, side, card, reliability, part, whole, other_part, other_whole, verdict): every card of every side that has points.

    reliability: none without a case (of both metrics), ok from the card's sample on in each, else low; the verdict is null unless it is ok.
    """
    roles = [(m, i == 0, *x) for x in cards for i, m in enumerate((x.metric, x.other)) if m]
    c = _fixed(facts.sparkSession, roles, "metric string, first boolean, " + _CARD_SCHEMA)
    x, first = facts.join(c, "metric"), F.col("first")
    one = lambda n: F.max(F.when(first, F.col(n)))
    two = lambda n: F.max(F.when(~first, F.col(n)))
    x = x.groupBy(*SIDE, "card", F.col("other").isNotNull().alias("double"), "c_sample", "over", "high", "even", "under", "low", "strict").agg(*(one(n).alias(n) for n in ("part", "whole", "value")), *(two(n).alias(f"other_{n}") for n in ("part", "whole", "value")))
    none = (F.col("whole") == 0) & (~F.col("double") | (F.col("other_whole") == 0))
    enough = (F.col("whole") >= F.col("c_sample")) & (~F.col("double") | (F.col("other_whole") >= F.col("c_sample")))
    reliable = F.when(none, "none").when(enough, "ok").otherwise("low")
    number = F.when(F.col("double"), F.col("value") - F.col("other_value")).otherwise(F.col("value"))
    under = F.coalesce((number < F.col("under")) | (~F.col("strict") & (number == F.col("under"))), F.lit(False))
    verdict = F.when(F.col("reliability") == "ok", F.when(number >= F.col("over"), F.col("high")).when(under, F.col("low")).otherwise(F.col("even")))
    return x.withColumn("reliability", reliable).select(*SIDE, "card", "reliability", "part", "whole", "other_part", "other_whole", verdict.alias("verdict"))


def review_points(sides: DataFrame, streaks: DataFrame, hints: DataFrame) -> DataFrame:
    """(match, side, rule, detail, review, game, point): the points to look at again for each hint, by group.

    The hints of a side (at most as many as were asked for) travel as one array to its points, and only groups of those are unfolded.
    """
    w = Window.partitionBy(*SIDE).orderBy("at")
    x = sides.join(streaks.select(*SIDE, "first_at", "last_at"), SIDE, "left")
    within = F.coalesce((F.col("at") >= F.col("first_at")) & (F.col("at") <= F.col("last_at")), F.lit(False))
    x = x.withColumn("within", within)
    ahead = ("game_point", "error", "lost", "result", "loser_player", "within")
    x = x.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in ahead), *(F.lag(c).over(w).alias(f"last_{c}") for c in ("game_point", "lost", "within")))
    no = lambda name: F.coalesce(name, F.lit(False))
    c = F.col
    missed, faulted = c("lost") & c("error"), c("serves") & c("fault") & c("lost")
    next_missed = no("next_lost") & no("next_error")
    result, player = c("result"), c("loser_player")
    groups: Sequence[tuple[str, str, Column, Column | None]] = (
        ("first_serve_in", "faults", c("serves") & c("fault"), None),
        ("first_serve_in", "lost on second serve", faulted, None),
        ("first_serve_points", "lost on first serve", c("serves") & ~c("fault") & c("lost"), None),
        ("first_serve_points", "short rallies lost", c("lost") & c("short"), None),
        ("first_serve_points", "ended by the other", c("lost") & c("winning"), None),
        ("second_serve_points", "lost on second serve", faulted, None),
        ("second_serve_points", "double faults", c("serves") & c("double_fault"), None),
        ("second_serve_points", "short rallies lost", faulted & c("short"), None),
        ("receive_points", "lost at the third stroke", c("receives") & c("lost") & no(c("rally") == 3), None),
        ("receive_points", "lost to second serves", c("receives") & c("lost") & c("fault"), None),
        ("receive_points", "short rallies lost", c("receives") & c("lost") & c("short"), None),
        ("rally_short", "lost", c("lost") & c("short"), None),
        ("rally_short", "lost by error", missed & c("short"), None),
        ("rally_medium", "lost", c("lost") & c("medium"), None),
        ("rally_medium", "lost by error", missed & c("medium"), None),
        ("rally_long", "lost", c("lost") & c("long"), None),
        ("game_points", "game points", c("game_point"), None),
        ("game_points", "before a game point", no("next_game_point"), None),
        ("game_points", "after one was lost", no("last_game_point") & no("last_lost"), None),
        ("saved_game_points", "game points of the other", c("against_game_point"), None),
        ("saved_game_points", "lost", c("against_game_point") & c("lost"), None),
        ("lost_streak", "before", ~c("within") & no("next_within"), None),
        ("lost_streak", "in it", c("within"), None),
        ("lost_streak", "after", ~c("within") & no("last_within"), None),
        ("error_share", "before", next_missed, c("next_result")),
        ("error_share", "serving", missed & c("serves"), result),
        ("error_share", "receiving", missed & c("receives"), result),
        ("error_share", "in the streak", missed & c("within"), result),
        ("player_share", "before", next_missed, c("next_loser_player")),
        ("player_share", "ended", missed, player),
    )
    each = F.array(*(F.when(hit, F.struct(F.struct(F.lit(rule).alias("rule"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail")).alias("hint"), F.lit(name).alias("review"))) for rule, name, hit, detail in groups))
    told = hints.groupBy(*SIDE).agg(F.collect_set(F.struct("rule", "detail")).alias("told"))
    x = x.join(told, SIDE).withColumn("told", F.col("told").cast("array<struct<rule:string,detail:string>>"))
    wanted = lambda g: g.isNotNull() & F.exists("told", lambda h: (h["rule"] == g["hint"]["rule"]) & h["detail"].eqNullSafe(g["hint"]["detail"]))
    x = x.select(*SIDE, "game", "point", F.explode(F.filter(each, wanted)).alias("g"))
    return x.select(*SIDE, F.col("g.hint.rule").alias("rule"), F.col("g.hint.detail").alias("detail"), F.col("g.review").alias("review"), "game", "point")
