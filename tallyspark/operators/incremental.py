"""Incremental maintenance: content hashes, their difference, what it affects, and how a bridge table and outputs follow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import short_hash


def row_hash(columns: Sequence[str], ignored: Sequence[str] = ()) -> Column:
    """A content hash of a row, without columns that always change."""
    return short_hash(F.to_json(F.struct(*(c for c in columns if c not in ignored))))


def manifest(rows: DataFrame, key: Column, ignored: Sequence[str] = ()) -> DataFrame:
    """(key, hash): one content hash for each key, whatever the order of its rows: the number of rows and two sums of their hashes, which Spark combines before it shuffles."""
    content = F.to_json(F.struct(*(c for c in rows.columns if c not in ignored)))
    x = rows.select(key.cast("string").alias("key"), *(F.xxhash64(F.lit(seed), content).cast("decimal(38,0)").alias(f"h{seed}") for seed in (1, 2)))
    return x.groupBy("key").agg(short_hash(F.concat_ws(":", F.count("*").cast("string"), F.sum("h1").cast("string"), F.sum("h2").cast("string"))).alias("hash"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change): added, changed and removed keys of two manifests."""
    x = old.select("key", F.col("hash").alias("o")).join(new.select("key", F.col("hash").alias("n")), "key", "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    return x.select("key", change.alias("change")).where("change is not null")


def affected_keys(changes: DataFrame, old: DataFrame, new: DataFrame, info: str = "info:", separator: str = "/") -> DataFrame:
    """(key): changed keys and, where a key `info:X` has changed, every key that begins with X/."""
    is_info = F.startswith(F.col("key"), F.lit(info))
    groups = changes.where(is_info).select(F.substring("key", len(info) + 1, 1_000_000).alias("__g")).distinct()
    every = old.select("key").union(new.select("key")).distinct().where(~is_info)
    fanned = every.withColumn("__g", F.substring_index("key", separator, 1)).join(groups, "__g", "left_semi").select("key")
    return changes.where(~is_info).select("key").union(fanned).distinct()


def seasons_of(keys: DataFrame, place: int = 2, separator: str = "/") -> DataFrame:
    """(season): distinct numbers at a place of the keys."""
    return keys.select(F.try_element_at(F.split("key", separator), F.lit(place)).try_cast("int").alias("season")).where("season is not null").distinct()


def apply_delta(bridge: DataFrame, fresh: DataFrame, keys: DataFrame, key: str, member: str) -> tuple[DataFrame, DataFrame]:
    """(bridge, affected): rows of the given keys are replaced by fresh ones; affected members are those before or after."""
    gone = bridge.join(keys.select(key), key, "left_semi")
    kept = bridge.join(keys.select(key), key, "left_anti")
    added = fresh.join(keys.select(key), key, "left_semi")
    return kept.unionByName(added), gone.select(member).union(added.select(member)).distinct()


def changed_rows(old: DataFrame, new: DataFrame, keys: Sequence[str], ignored: Sequence[str] = ()) -> DataFrame:
    """(keys, change): rows added, removed, or with another content."""
    sign = lambda d, n: d.select(*keys, row_hash([c for c in d.columns if c not in keys], ignored).alias(n))
    x = sign(old, "o").join(sign(new, "n"), list(keys), "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    return x.select(*keys, change.alias("change")).where("change is not null")


def refresh(old_output: DataFrame, recomputed: DataFrame, affected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The output after an incremental run: rows of affected keys are those recomputed, all others the old ones."""
    return old_output.join(affected.select(*keys), list(keys), "left_anti").unionByName(recomputed.join(affected.select(*keys), list(keys), "left_semi"))


def needs_full_run(state: dict, engine: str, config: str) -> tuple[bool, bool]:
    """(facts, rankings) that must be rebuilt whole: facts if the engine or global inputs have changed, rankings also if the configuration has."""
    facts = state.get("engine") != engine
    return facts, facts or state.get("config") != config
