"""Labels and their orders: rounds, placements, tiers, category names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strength of a placement, weight of a tier, and share of it that a placement earns.
PLACEMENT_STRENGTH = {"winner": 1000, "runnerup": 900, "best4": 800, "best8": 700, "group": 10, "unknown": 0}
TIER_WEIGHTS = {"major": 100.0, "national": 60.0, "local": 20.0}
COEFFICIENTS = {"winner": 1.0, "runnerup": 0.7, "best4": 0.5, "best8": 0.3, "other": 0.1}
#: Orders of late rounds; several exist, as lists, draws and stories sort differently.
LATE_ROUNDS = {"facts": (100, 101, 102), "coverage": (8000, 9000, 10000), "story": (90, 91, 92)}
LATE_NAMES = ("quarterfinal", "semifinal", "final")


def round_order(label: Column, late: Sequence[int] = LATE_ROUNDS["facts"], pattern: str = r"^round (\d+)$") -> Column:
    """The ordinal of a round's label: N of "round N", the late orders, else 0."""
    low = F.lower(F.trim(label))
    out = F.when(low.isNull(), 0)
    for name, order in zip(LATE_NAMES, late, strict=True):
        out = out.when(low == name, order)
    number = F.regexp_extract(low, pattern, 1)
    return out.when(number != "", number.cast("int")).otherwise(0)


def contained_order(label: Column, orders: Mapping[str, int]) -> Column:
    """-1 without a label, else the first number in it, else the order of the longest name that it contains, else 0. A number over 18 digits gives null."""
    number = F.regexp_extract(label, r"(\d+)", 1)
    out = F.when(label.isNull() | (label == ""), F.lit(-1).cast("long")).when(number != "", F.when(F.length(number) <= 18, number.try_cast("long")))
    for name in sorted(orders, key=lambda n: (-len(n), n)):
        out = out.when(F.contains(label, F.lit(name)), F.lit(orders[name]).cast("long"))
    return out.otherwise(F.lit(0).cast("long"))


def list_rank(label: Column, best: Sequence[str] = LATE_NAMES[::-1], pattern: str = r"^round (\d+)$", most: int = 100, other: int = 1000) -> Column:
    """Place of a round in a list that begins with the last one: late rounds by name, then numbered ones, later first, then the rest."""
    out = F.when(label.isNull(), other)
    for i, name in enumerate(best):
        out = out.when(label == name, i)
    number = F.regexp_extract(label, pattern, 1)
    return out.when(number != "", most - F.when(F.length(number) <= 9, number.try_cast("int")).otherwise(most - other)).otherwise(other)


def placement_kind(kind: Column, best_level: Column) -> Column:
    """winner, runnerup, best4, best8 (any level but 4), round, group or unknown."""
    return (
        F.when(kind.isin("winner", "runnerup"), kind)
        .when((kind == "best") & (best_level == 4), "best4")
        .when(kind == "best", "best8")
        .when(kind.isin("round", "group"), kind)
        .otherwise("unknown")
    )


def placement_strength(kind: Column, rnd: Column) -> Column:
    """How good a placement is; of lost rounds, later is better."""
    out = F.when(kind == "round", 100 + rnd)
    for name, value in PLACEMENT_STRENGTH.items():
        out = out.when(kind == name, value)
    return out.otherwise(0)


def placement_label(kind: Column, rnd: Column) -> Column:
    return F.when(kind == "winner", "Winner").when(kind == "runnerup", "Runner-up").when(kind == "best4", "Last 4").when(kind == "best8", "Last 8").when(kind == "round", F.concat(F.lit("Round "), rnd.cast("string"))).when(kind == "group", "Group stage").otherwise("")


def resolve_tier(is_major: Column, is_national: Column) -> Column:
    return F.when(is_major, "major").when(is_national, "national").otherwise("local")


def _lookup(key: Column, values: Mapping[str, float], default: float) -> Column:
    out = F.when(key.isNull(), default)
    for k, v in values.items():
        out = out.when(key == k, v)
    return out.otherwise(default)


def entry_score(tier: Column, kind: Column, tiers: Mapping[str, float] = TIER_WEIGHTS, coefficients: Mapping[str, float] = COEFFICIENTS) -> Column:
    """Points of an entry: its tier's weight times its placement's share."""
    return _lookup(tier, tiers, 0.0) * _lookup(kind, coefficients, coefficients["other"])


def category_parts(category: Column, separator: str = "-") -> Column:
    """struct(discipline, age, gender, kind), read from the right: the last part is the gender, the one before the age, the rest the discipline; gender mixed makes kind mixed."""
    parts = F.split(category, separator, -1)
    n = F.size(parts)
    gender = F.when(n >= 3, F.element_at(parts, -1))
    discipline = F.when(n >= 3, F.array_join(F.slice(parts, 1, F.greatest(n - 2, F.lit(1))), separator))
    return F.struct(discipline.alias("discipline"), F.when(n >= 3, F.try_element_at(parts, F.lit(-2))).alias("age"), gender.alias("gender"), F.when(gender == "mixed", "mixed").otherwise(discipline).alias("kind"))


def fan_out(value: Column, both: str, to: Sequence[str]) -> Column:
    """An array to explode: every one of `to` where value is `both`, else value itself."""
    return F.when(value == both, F.array(*map(F.lit, to))).otherwise(F.array(value))


def rally_band(count: Column, fault: Column, scale: str = "match") -> Column:
    """Length class of a rally; two scales, of single matches and of growth over matches."""
    if scale == "match":
        return F.when(fault | count.isNull(), "unknown").when(count <= 2, "1-2").when(count <= 4, "3-4").when(count <= 8, "5-8").otherwise("9+")
    return F.when(fault | count.isNull() | (count <= 0), "unknown").when(count <= 2, "short").when(count <= 5, "middle").otherwise("long")


def points_to_win(best_of: Column, won_a: Column, won_b: Column, normal: int = 4, final: int = 7) -> Column:
    """Points that win a game: more in the deciding one."""
    needed = F.floor(best_of / 2)
    return F.when((won_a == needed) & (won_b == needed), final).otherwise(normal)


def is_winning_score(own: Column, other: Column, target: Column) -> Column:
    return (own >= target) & (own - other >= 2)


def is_deuce(a: Column, b: Column, target: Column) -> Column:
    return (a == b) & (a >= target - 1)


def serving_side(point_number: Column, first: Column, cycle: int = 2) -> Column:
    """A or B: the side that serves a point of a tie-break game, changing every `cycle` points; first: the side that serves first."""
    other = F.when(first == "A", "B").otherwise("A")
    return F.when(F.floor((point_number - 1) / cycle) % 2 == 0, first).otherwise(other)


def court_turn(point_number: Column, first: Column, final: Column, players_a: Column, players_b: Column, first_server: Column, first_receiver: Column) -> Column:
    """struct(serving, server, receiving, receiver) of a point: sides, and seats 0 or 1 in them.

    In the final game sides change every two points, else `first` serves all of it. Servers of a side change after two of its points, receivers after each
    point that their side receives. The seats that begin are known for the first serving and receiving side (null: 0), the others begin with seat 0.
    """
    n = point_number - 1
    other = F.when(first == "A", "B").otherwise("A")
    serving = F.when(final, serving_side(point_number, first)).otherwise(first)
    receiving = F.when(serving == "A", "B").otherwise("A")
    players = lambda side: F.when(side == "A", players_a).otherwise(players_b)
    turns = F.when(~final, F.coalesce(first_server, F.lit(0)) + F.floor(n / 2)).when(serving == first, F.coalesce(first_server, F.lit(0)) + F.floor(n / 4)).otherwise(F.floor((n - 2) / 4))
    # A side receives in pairs of points in the final game and always in others, so its count of receptions is as even as n.
    got = F.when(receiving == other, F.coalesce(first_receiver, F.lit(0))).otherwise(0) + n
    seat = lambda side, x: F.when(players(side) <= 1, 0).otherwise(x % 2).cast("int")
    return F.struct(serving.alias("serving"), seat(serving, turns).alias("server"), receiving.alias("receiving"), seat(receiving, got).alias("receiver"))


def standing_from_deepest(won: Column, order: Column, late: Sequence[int] = LATE_ROUNDS["facts"]) -> Column:
    """Placement kind from an entry's deepest match."""
    quarter, semi, final = late
    return F.when((order == final) & won, "winner").when((order == final) | ((order == semi) & won), "runnerup").when(order == semi, "best4").when(order == quarter, "best8").otherwise("round")
