"""Evaluation of predictions: accuracy, Brier score, calibration by gap, and sweeps over parameters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import exact_rate, expected_score
from .aggregates import count_where


def metrics(rows: DataFrame, keys: Sequence[str], chance: Column, won: Column, places: int = 6) -> DataFrame:
    """n, accuracy (chance over a half means a win) and Brier score by keys."""
    hit = (chance > 0.5) == won
    error = F.pow(chance - won.cast("double"), F.lit(2.0))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), exact_rate(count_where(hit), F.count("*")).alias("accuracy"), F.round(F.avg(error), places).alias("brier"))


def calibration(rows: DataFrame, gap: Column, won: Column, width: int = 50, most: int = 300, scale: float = 400.0, places: int = 6) -> DataFrame:
    """By rating gap in steps of `width`, capped at `most`: matches, observed and expected rate."""
    step = F.least(F.floor(gap / width) * width, F.lit(most)).cast("long")
    x = rows.select(step.alias("gap_from"), won.alias("w"), expected_score(gap, F.lit(0.0), scale).alias("e"))
    return x.groupBy("gap_from").agg(F.count("*").alias("n"), exact_rate(count_where(F.col("w")), F.count("*")).alias("observed"), F.round(F.avg("e"), places).alias("expected"))


def sweep(rows: DataFrame, parameters: Iterable[dict], score: Column, places: int = 6) -> DataFrame:
    """The mean score for every set of parameters. They are exploded into each row's pre-aggregate, so rows are read once; `score` refers to them as columns."""
    sets = [dict(p) for p in parameters]
    names = list(sets[0])
    grid = F.array(*(F.struct(*(F.lit(p[n]).alias(n) for n in names)) for p in sets))
    return rows.withColumn("__p", F.explode(grid)).select("*", "__p.*").withColumn("__s", score).groupBy(*names).agg(F.round(F.avg("__s"), places).alias("score"), F.count("*").alias("n"))


def holdout(rows: DataFrame, season: Column, first: int) -> DataFrame:
    """rows with part: fit before the given season, holdout from it on."""
    return rows.withColumn("part", F.when(season >= first, "holdout").otherwise("fit"))
