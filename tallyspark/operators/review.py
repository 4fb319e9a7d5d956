"""Candidates of points (from a video, say) committed to the games of a match, until one side has won it; and a stored index of earlier meetings of a pair."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import as_table, owned, shared_dir

# Points that win a game, and the deciding one; both with two ahead.
GAME, DECIDER = 4, 7


def commit_candidates(candidates: DataFrame, keys: Sequence[str], order: Sequence[str], ident: str, winner: str, best_of: int) -> DataFrame:
    """(keys, ident, game, point, side): the candidates that become points. Those without a winner A or B are passed over; what comes after the match is won is left out.

    A session's candidates are one match, so few enough for one row's array; only points played are kept in the state.
    """
    need = best_of // 2 + 1
    state = "struct<game: bigint, a: bigint, b: bigint, wa: bigint, wb: bigint, out: array<struct<id: {k}, game: bigint, point: bigint, side: string>>>"
    kind = candidates.schema[ident].dataType.simpleString()
    clean = candidates.where(F.col(winner).isin("A", "B"))
    each = clean.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(ident).alias("__id"), F.col(winner).alias("__w")))).alias("all"))
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(1).cast("long").alias("game"), zero.alias("a"), zero.alias("b"), zero.alias("wa"), zero.alias("wb"), F.array().alias("out")).cast(state.format(k=kind))

    def step(s: Column, x: Column) -> Column:
        a, b = s["a"] + (x["__w"] == "A").cast("long"), s["b"] + (x["__w"] == "B").cast("long")
        target = F.when(s["wa"] + s["wb"] == best_of - 1, DECIDER).otherwise(GAME)
        over = (F.greatest(a, b) >= target) & (F.abs(a - b) >= 2)
        won = lambda side: (over & (x["__w"] == side)).cast("long")
        point = F.struct(x["__id"].alias("id"), s["game"].alias("game"), (s["a"] + s["b"] + 1).alias("point"), x["__w"].alias("side"))
        new = F.struct((s["game"] + over.cast("long")).alias("game"), F.when(over, zero).otherwise(a).alias("a"), F.when(over, zero).otherwise(b).alias("b"), (s["wa"] + won("A")).alias("wa"), (s["wb"] + won("B")).alias("wb"), F.concat(s["out"], F.array(point)).alias("out"))
        return F.when(F.greatest(s["wa"], s["wb"]) >= need, s).otherwise(new.cast(state.format(k=kind)))

    return each.select(*keys, F.explode(F.aggregate("all", start, step)["out"]).alias("p")).select(*keys, F.col("p.id").alias(ident), "p.game", "p.point", "p.side")


def commit_stream(candidates: DataFrame, best_of: int) -> DataFrame:
    """The same over a stream of (session, id, winner) that arrives in order within a session: (session, id, game, point, side), each once. State: the score of one match."""
    need = best_of // 2 + 1

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        game, a, b, wa, wb = state.get if state.exists else (1, 0, 0, 0, 0)
        out = []
        for x in batches:
            for i, w in x.sort_values("id")[["id", "winner"]].itertuples(index=False):
                if w not in ("A", "B") or max(wa, wb) >= need:
                    continue
                out.append((key[0], i, game, a + b + 1, w))
                a, b = a + (w == "A"), b + (w == "B")
                if max(a, b) >= (DECIDER if wa + wb == best_of - 1 else GAME) and abs(a - b) >= 2:
                    game, a, b, wa, wb = game + 1, 0, 0, wa + (w == "A"), wb + (w == "B")
        state.update((game, a, b, wa, wb))
        yield pd.DataFrame(out, columns=["session", "id", "game", "point", "side"])

    return candidates.groupBy("session").applyInPandasWithState(fold, "session long, id long, game long, point long, side string", "game long, a long, b long, wa long, wb long", "append", GroupStateTimeout.NoTimeout)


def store_meetings(matches: DataFrame, a: str, b: str, table: str, buckets: int = 32) -> DataFrame:
    """Matches stored by their unordered pair (low, high) in buckets, sorted; lookups join it without moving it. The files lie in the shared folder."""
    x = matches.withColumn("low", F.least(a, b)).withColumn("high", F.greatest(a, b)).where("low <> high")
    x.write.bucketBy(buckets, "low", "high").sortBy("low", "high").option("path", owned(matches.sparkSession, f"{shared_dir(matches.sparkSession)}/{table}")).mode("overwrite").saveAsTable(table)
    return matches.sparkSession.table(table)


def prior_meetings(asked: DataFrame, index: DataFrame, keep: Sequence[str], months: int = 12) -> DataFrame:
    """asked (low, high, day, generation, series, and `keep`) with each earlier meeting of its pair: those within `months` before, or in the series' previous edition (`previous`, its day, however long ago).

    Only meetings of the same generation count; where either side's isn't known it excludes none. index: low, high, day, generation, series, and what else is wanted, which gets the prefix prior_.
    """
    known = index.select("low", "high", *(F.col(c).alias(f"prior_{c}") for c in index.columns if c not in ("low", "high")))
    x = asked.select("low", "high", "day", "generation", "series", "previous", *keep).join(known.hint("merge"), ["low", "high"])
    window = (F.col("prior_day") >= F.add_months("day", -months)) | ((F.col("prior_series") == F.col("series")) & (F.col("prior_day") >= F.col("previous")))
    same = F.coalesce(F.col("generation") == F.col("prior_generation"), F.lit(True))
    return x.where((F.col("prior_day") < F.col("day")) & window & same)


def count_prior_meetings(asked: DataFrame, index: DataFrame, keep: Sequence[str], months: int = 12) -> DataFrame:
    """asked's `keep` with meetings, last_day and won over the earlier meetings that `prior_meetings` lists, where there are any. None is listed here: the work follows rows and not their pairs.

    index: low, high, day (a date), generation, series, and how many meetings these are and won (n, won). A pair's meetings are summed up day by day, over all series and in each; what lies
    between two days is the difference of two sums. The sums of a generation have meetings of unknown ones in them; who is of an unknown one asks those over all. Generations are few.
    """
    pair = ["low", "high"]
    asked = asked.where("low is not null AND high is not null AND day is not null")
    cells = asked.select(*pair, "day", "generation", "series", "previous").distinct()
    days = index.where("low is not null AND high is not null AND day is not null").groupBy(*pair, "day", "generation", "series").agg(F.sum("n").alias("n"), F.sum("won").alias("won"))
    known = asked.select("generation").union(index.select("generation")).agg(F.collect_set("generation").alias("known"))
    over_all = F.array(F.lit(None).cast(index.schema["generation"].dataType))
    days = days.withColumn("known", known.scalar()).withColumn("generation", F.explode(F.when(F.col("generation").isNull(), F.concat("known", over_all)).otherwise(F.concat(F.array("generation"), over_all)))).drop("known")
    # Days asked about, and those on which a previous edition began, have sums too, whether or not the pair met on them.
    none = lambda day: cells.where(F.col(day).isNotNull()).select(*pair, F.col(day).alias("day"), "generation", "series", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("won")).distinct()

    def sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """For each day what was before it (n, won), before the day `months` earlier (n_ago, won_ago), and the last day before it."""
        x = rows.groupBy(*keys, "generation", "day").agg(F.sum("n").alias("n"), F.sum("won").alias("won"))
        w = Window.partitionBy(*keys, "generation").orderBy("day")
        ranged = lambda c, start: F.coalesce(F.expr(f"sum({c}) OVER (PARTITION BY {', '.join(keys)}, generation ORDER BY day RANGE BETWEEN {start} PRECEDING AND INTERVAL '{months}' MONTH PRECEDING)"), F.lit(0))
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        ago = [(ranged(c, "UNBOUNDED") - ranged(c, f"INTERVAL '{months}' MONTH")).alias(f"{c}_ago") for c in ("n", "won")]
        return x.select(*keys, "generation", "day", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n", "won")), *ago, F.max(F.when(F.col("n") > 0, F.col("day"))).over(before).alias("last"))

    whole = sums(days.unionByName(none("day")), pair)
    own = as_table(sums(days.unionByName(none("day")).unionByName(none("previous")).where("series is not null"), [*pair, "series"]), "sums")
    c, a, o = cells.alias("c"), whole.alias("a"), own.alias("o")
    p = own.select(*pair, "series", "generation", F.col("day").alias("previous"), "n", "won").alias("p")
    on = lambda t, *keys: reduce(lambda q, k: q & (F.col(f"c.{k}") == F.col(f"{t}.{k}")), [*pair, *keys], F.col("c.generation").eqNullSafe(F.col(f"{t}.generation")))
    x = c.join(a, on("a", "day")).join(o, on("o", "series", "day"), "left").join(p, on("p", "series", "previous"), "left")
    window = lambda n: F.col(f"a.{n}") - F.col(f"a.{n}_ago")
    edition = lambda n: F.coalesce(F.greatest(F.col(f"o.{n}_ago") - F.col(f"p.{n}"), F.lit(0)), F.lit(0))
    x = x.select("c.*", (window("n") + edition("n")).alias("meetings"), F.when(window("n") > 0, F.col("a.last")).otherwise(F.col("o.last")).alias("last_day"), (window("won") + edition("won")).alias("won")).where("meetings > 0")
    x = x.withColumnsRenamed({k: f"__{k}" for k in cells.columns})
    return asked.select(*cells.columns, *keep).join(x, reduce(lambda q, k: q & F.col(k).eqNullSafe(F.col(f"__{k}")), cells.columns, F.lit(True))).select(*keep, "meetings", "last_day", "won")
