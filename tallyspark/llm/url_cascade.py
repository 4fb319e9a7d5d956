"""URL filters: exact rule membership through a cascade of Bloom filters, without a join.

The keys of a url are its host and each parent domain, with each beginning of its path as long as some rule's
path. Level 1 of the cascade encodes the listed keys; level 2 those keys of the corpus that level 1 wrongly
takes; level 3 the listed keys that level 2 wrongly takes; and so on, until a level errs for no key. As the levels
are built over every distinct key of the corpus, walking them answers membership exactly for every one of its rows.

Edge cases: a null url, or one without ``://``, has an empty host and path and fits no rule. A url that no rule
fits gets the verdict of the list it isn't on: ``default`` ("allow" where the listed exceptions are blocks). Repeated
rows are judged one by one; rules that repeat count once; a key listed as both allow and block is an error; without
rules, or with an empty table, nothing is listed.

Scale: one distinct over the corpus's keys (pre-aggregated; keys are few next to pages). Level 1 is made as wide as it
takes for the corpus's keys to leave level 2 no more than the list has; the levels then shrink
geometrically. Only bit arrays reach the driver and are broadcast, none over ``max_bits``: where a level would be, the keys
are split by hash into several cascades, which are built and asked one after the other; pages are a table again
after every ``resident`` of them, so executors hold no more at once, whatever the length of the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .bloom import BITS_PER_KEY, bloom_bits, bloom_hit, error_rate
from .common import ascii_lower, written


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Every key a rule for this url could have, as an array."""
    labels = F.split(host, r"\.", -1)
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in path_lengths]) if path_lengths else F.array().cast("array<string>")
    starts = F.filter(starts, lambda s: s.isNotNull())
    keys = F.flatten(F.transform(domains, lambda d: F.transform(starts, lambda s: F.concat(d, s))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


class Cascade:
    """Levels of bit arrays; `holds` is exact for every key of the universe it was built over."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        inside = np.zeros(len(a), bool)
        walking = np.arange(len(a))
        for level, bits in enumerate(self.levels, 1):
            walking = walking[bloom_hit(bits, a[walking], b[walking], level)]
            inside[walking] = level % 2 == 1
        return inside


def _width(listed: float, universe: float, max_bits: int) -> float:
    """Bits for each listed key at level 1: doubled until the universe leaves level 2 no more than is listed, or max_bits are full."""
    bits = float(BITS_PER_KEY)
    while universe * error_rate(bits) > max(listed, 1000) and 4 * listed * bits <= max_bits:
        bits *= 2
    return bits


def split_count(listed: int, universe: int, max_bits: int) -> int:
    """Into how many cascades keys are split so that levels 1 and 2 of each fit max_bits."""
    parts = 1
    while parts < max(1, listed):
        n, u = listed / parts, universe / parts
        if n * BITS_PER_KEY * 2 <= max_bits and u * error_rate(_width(n, u, max_bits)) * BITS_PER_KEY * 2 <= max_bits:
            break
        parts *= 2
    return parts


def build_cascade(listed: DataFrame, universe: DataFrame, max_bits: int = 1 << 26, max_levels: int = 40) -> Cascade:
    """listed and universe: columns a and b, two hashes of each distinct key; universe must hold every key that will be asked for."""
    taken = listed.select("a", "b").distinct()
    rest = universe.select("a", "b").distinct().join(taken, ["a", "b"], "left_anti")
    width = _width(taken.count(), universe.count(), max_bits)
    levels: list[np.ndarray] = []
    while not taken.isEmpty():
        if len(levels) == max_levels:
            raise ValueError("the cascade doesn't end: two keys share both hashes")
        levels.append(bloom_bits(taken, max_bits, len(levels) + 1, BITS_PER_KEY if levels else width))

        def wrong(batches: Iterator[pd.DataFrame], bits: np.ndarray = levels[-1], level: int = len(levels)) -> Iterator[pd.DataFrame]:
            for x in batches:
                yield x[bloom_hit(bits, x["a"].to_numpy(), x["b"].to_numpy(), level)]

        taken, rest = rest.mapInPandas(wrong, "a long, b long"), taken
    return Cascade(levels)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b")]


#: The upper bits of b choose a key's cascade; the lower ones its bits there.
PART_SHIFT = 40


def _judge(keyed: DataFrame, cascades: dict[str, Cascade], part: int, parts: int) -> DataFrame:
    """keyed with rule and verdict, where a rule of this part is longer than the one found before."""
    shared = keyed.sparkSession.sparkContext.broadcast(cascades)

    @F.pandas_udf("rule string, verdict string")
    def judge(keys: pd.Series, a: pd.Series, b: pd.Series, rule: pd.Series, verdict: pd.Series) -> pd.DataFrame:
        sizes = keys.map(len).to_numpy(np.int64)
        flat = np.concatenate([*keys, np.array([], object)])
        fa, fb = (np.concatenate([*x, np.array([], np.int64)]).astype(np.int64) for x in (a, b))
        mine = np.flatnonzero((fb.view(np.uint64) >> np.uint64(PART_SHIFT)) % np.uint64(parts) == part)
        verdicts = np.full(len(flat), None, object)
        for v, cascade in shared.value.items():
            verdicts[mine[cascade.holds(fa[mine], fb[mine])]] = v
        rule, verdict = rule.to_numpy(object, copy=True), verdict.to_numpy(object, copy=True)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        for at in np.flatnonzero([v is not None for v in verdicts]):
            i = rows[at]
            if rule[i] is None or len(flat[at]) > len(rule[i]):
                rule[i], verdict[i] = flat[at], verdicts[at]
        return pd.DataFrame({"rule": rule, "verdict": verdict})

    a = F.transform("__keys", lambda k: F.xxhash64(k))
    b = F.transform("__keys", lambda k: F.xxhash64(F.lit("second"), k))
    judged = keyed.withColumn("__judged", judge("__keys", a, b, "rule", "verdict"))
    return judged.withColumn("rule", F.col("__judged.rule")).withColumn("verdict", F.col("__judged.verdict")).drop("__judged")


def url_cascade(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", default: str = "allow", max_bits: int = 1 << 26, resident: int = 8) -> DataFrame:
    """pages with host, path, rule and verdict. rules: (verdict, host, path), verdict "allow" or "block"; of the rules that fit, the longest holds."""
    spark = pages.sparkSession
    ship_package(spark)
    kind: dict[str, str] = {}
    for verdict, host, path in rules:
        if kind.setdefault(host + path, verdict) != verdict:
            raise ValueError(f"{host + path} is listed twice, to allow and to block")
    lengths = sorted({len(path) for _, _, path in rules})
    keyed = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col))).withColumn("__keys", keys_of(F.col("host"), F.col("path"), lengths))
    universe = written(keyed.select(F.explode("__keys").alias("k")).distinct().select(*_hashes(F.col("k"))), "universe")
    listed = {v: spark.createDataFrame([(k,) for k, x in kind.items() if x == v], "k string").select(*_hashes(F.col("k"))) for v in ("allow", "block")}
    size = universe.count()
    parts = max(split_count(sum(x == v for x in kind.values()), size, max_bits) for v in listed)
    keyed = keyed.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    for part in range(parts):
        mine = F.pmod(F.shiftrightunsigned("b", PART_SHIFT), F.lit(parts)) == part
        keyed = _judge(keyed, {v: build_cascade(x.where(mine), universe.where(mine), max_bits) for v, x in listed.items()}, part, parts)
        if part % resident == resident - 1 and part + 1 < parts:
            keyed = written(keyed, "judged")
    return keyed.drop("__keys")
