"""Rates, rounding and bands. Everything here is a JVM-side column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_rate(part: Column, whole: Column) -> Column:
    """part / whole to three places, halves to even, in integer arithmetic; 0 where whole is null or not positive."""
    scaled, whole = part.cast("long") * 1000, whole.cast("long")
    q = F.call_function("div", scaled, whole)
    twice = (scaled - q * whole) * 2
    up = (twice > whole) | ((twice == whole) & (q % 2 == 1))
    return F.when(whole > 0, (q + up.cast("long")) / F.lit(1000.0)).otherwise(F.lit(0.0))


def half_up(value: Column, places: int = 3) -> Column:
    """Rounds halves towards plus infinity."""
    factor = float(10**places)
    return F.floor(value * factor + 0.5) / F.lit(factor)


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole; null where whole is 0."""
    return F.when(whole != 0, part * 100.0 / whole)


def share_points(part: Column, whole: Column, places: int = 1) -> Column:
    """Half-up percentage to so many places; null where whole is 0."""
    return half_up(percentage(part, whole), places)


def band(value: Column, limits: Sequence[tuple[float, str]], beyond: str, unknown: str | None = None) -> Column:
    """The label of the first limit that value doesn't exceed, else `beyond`; `unknown` for null."""
    out = F.when(value.isNull(), F.lit(unknown))
    for limit, label in limits:
        out = out.when(value <= limit, F.lit(label))
    return out.otherwise(F.lit(beyond))


def reliability(sample: Column, enough: int) -> Column:
    """none, low or ok by sample size."""
    return F.when(sample == 0, "none").when(sample < enough, "low").otherwise("ok")


def trend(delta: Column, higher_is_better: Column | bool = True, stable: float = 2.0) -> Column:
    """stable within the given change, else improved or declined."""
    up = (delta > 0) == (F.lit(higher_is_better) if isinstance(higher_is_better, bool) else higher_is_better)
    return F.when(delta.isNull(), None).when(F.abs(delta) < stable, "stable").when(up, "improved").otherwise("declined")


def expected_score(own: Column, other: Column, scale: float = 400.0) -> Column:
    """The chance that `own` wins by a logistic rating model."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (other - own) / scale))


def strength_weight(rating: Column, base: float = 1500.0, scale: float = 400.0) -> Column:
    return F.pow(F.lit(10.0), (rating - base) / scale)


def decay_weight(age: Column, weights: Sequence[float] = (1.0, 0.8, 0.6), rest: float = 0.3) -> Column:
    """Weight of something so many years old."""
    out = F.when(age < 0, 0.0)
    for i, w in enumerate(weights):
        out = out.when(age == i, w)
    return out.otherwise(rest)


def fiscal_year(day: Column, first_month: int = 4) -> Column:
    return F.year(day) - (F.month(day) < first_month).cast("int")


def _bits(n: Column) -> Column:
    """The length of a positive number's binary form."""
    return F.length(F.bin(n.cast("long")))


def _shift_left(n: Column, by: Column) -> Column:
    return F.call_function("shiftleft", n.cast("long"), by.cast("int"))


def next_power_of_two(n: Column) -> Column:
    """The smallest power of two that is n at least; 1 for n < 1."""
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(_shift_left(F.lit(1), _bits(n - 1)))


def meeting_round(slot_a: Column, slot_b: Column) -> Column:
    """The round (0 first) in which two slots of a knockout draw can meet; null for a slot and itself."""
    differ = slot_a.cast("long").bitwiseXOR(slot_b.cast("long"))
    return F.when(differ != 0, _bits(differ) - 1)


def sibling_range(slot: Column, rnd: Column) -> tuple[Column, Column]:
    """First and last slot of the half that `slot` meets in round `rnd` (0 first)."""
    block = F.call_function("shiftright", slot.cast("long"), rnd.cast("int")).bitwiseXOR(F.lit(1).cast("long"))
    first = _shift_left(block, rnd)
    return first, first + _shift_left(F.lit(1), rnd) - 1
