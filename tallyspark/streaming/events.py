"""Structured Streaming over event tables. State is bounded by watermarks, or is one small row for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window and type; rows later than the watermark are dropped."""
    x = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return x.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    x = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return x.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")


def game_scores(points: DataFrame) -> DataFrame:
    """(match, game, a, b, leader_changes) after every batch, from points (match, game, point, winner) that arrive in order within a game. State: one row a game."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        a, b, leader, changes = state.get if state.exists else (0, 0, "", 0)
        for x in batches:
            for w in x.sort_values("point")["winner"]:
                a, b = a + (w == "A"), b + (w == "B")
                now = "A" if a > b else "B" if b > a else leader
                changes += bool(leader) and now != leader
                leader = now
        state.update((a, b, leader, changes))
        yield pd.DataFrame({"match": [key[0]], "game": [key[1]], "a": [a], "b": [b], "leader_changes": [changes]})

    return points.groupBy("match", "game").applyInPandasWithState(fold, "match long, game long, a long, b long, leader_changes long", "a long, b long, leader string, changes long", "update", GroupStateTimeout.NoTimeout)


def each_batch(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands every batch to `merge` (rows, batch id); merge must be idempotent by batch id to be exactly-once."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update").start()
