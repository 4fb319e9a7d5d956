"""Joins with the semantics that lookups over names, dates and groups need. Sizes decide how Spark runs them, unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key, the first in order. Order must be total for a stable result."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def prioritised_union(sources: Sequence[DataFrame], keys: Sequence[str], *order: Column) -> DataFrame:
    """All sources as one; of rows that share a key, the first source's."""
    every = None
    for i, s in enumerate(sources):
        x = s.withColumn("__source", F.lit(i))
        every = x if every is None else every.unionByName(x, allowMissingColumns=True)
    return first_wins(every, keys, F.asc("__source"), *order).drop("__source")


def coalesce_lookup(rows: DataFrame, lookups: Sequence[tuple[DataFrame, str, str]], into: str) -> DataFrame:
    """`into`: the value that the first lookup with the row's key has. lookups: (table with one row for each key, key column of both, value column)."""
    out, found = rows, []
    for i, (table, key, value) in enumerate(lookups):
        side = table.select(F.col(key).alias(f"__k{i}"), F.col(value).alias(f"__v{i}"))
        out = out.join(side, F.col(key) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        found.append(F.col(f"__v{i}"))
    return out.withColumn(into, F.coalesce(*found)).drop(*(f"__v{i}" for i in range(len(found))))


def unique_fallback(rows: DataFrame, field: DataFrame, exact: str, loose: str, value: str, into: str) -> DataFrame:
    """The field's value by the exact key, (the least of several), else by the loose key if just one row of the field has it."""
    once = field.where(F.col(loose).isNotNull()).groupBy(loose).agg(F.count("*").alias("__n"), F.min(value).alias("__lv")).where("__n = 1").select(F.col(loose).alias("__lk"), "__lv")
    by_key = field.where(F.col(exact).isNotNull()).groupBy(F.col(exact).alias("__ek")).agg(F.min(value).alias("__ev"))
    out = rows.join(by_key, F.col(exact) == F.col("__ek"), "left").join(once, F.col(loose) == F.col("__lk"), "left")
    return out.withColumn(into, F.coalesce("__ev", "__lv")).drop("__ek", "__ev", "__lk", "__lv")


def members_of(rows: DataFrame, group: Sequence[str], member: str) -> DataFrame:
    """(group, members): the sorted distinct members of each group."""
    return rows.groupBy(*group).agg(F.array_sort(F.collect_set(member)).alias("members"))


def partners(rows: DataFrame, group: Sequence[str], member: str) -> DataFrame:
    """(group, member, partner): every other member of the same group. Groups are entries or matches, so of bounded size."""
    other = rows.select(*group, F.col(member).alias("partner")).distinct()
    return rows.select(*group, member).distinct().join(other, list(group)).where(F.col(member) != F.col("partner"))


def meetings(rows: DataFrame, group: Sequence[str], member: str, day: str) -> DataFrame:
    """(a, b, meetings, first_day, last_day) of unordered pairs of members that share a group."""
    x = rows.groupBy(*group, member).agg(F.min(day).alias("__day"))
    a, b = x.select(*group, F.col(member).alias("a"), "__day"), x.select(*group, F.col(member).alias("b"))
    return a.join(b, list(group)).where("a < b").groupBy("a", "b").agg(F.count("*").alias("meetings"), F.min("__day").alias("first_day"), F.max("__day").alias("last_day"))


def within_months(left: DataFrame, right: DataFrame, keys: Sequence[str], day: str, other_day: str, months: int = 12, include_start: bool = True) -> DataFrame:
    """Pairs with equal keys whose other_day lies in [day - months, day), or past the start only if it isn't included.

    Months are clamped at a month's end. The right side is dealt by key and month bucket, and the left probes the two buckets that
    its window can touch, so a key with a long history is no single cell.
    """
    width = max(1, months)
    number = lambda c: F.year(c) * 12 + F.month(c)
    bucket = lambda n: F.floor(n / width)
    end = number(F.col(day))
    probes = F.array_distinct(F.array(bucket(end - months), bucket(end)))
    a = left.withColumn("__bucket", F.explode(probes))
    b = right.withColumn("__bucket", bucket(number(F.col(other_day))))
    start = F.add_months(F.col(day).cast("date"), -months).cast("timestamp")
    after = F.col(other_day) >= start if include_start else F.col(other_day) > start
    return a.join(b, [*keys, "__bucket"]).where(after & (F.col(other_day) < F.col(day))).drop("__bucket")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, right_at: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key that is strictly earlier; nulls if there is none.

    One union and one sorted window, linear in rows, instead of a join by range.
    """
    side = right.select(*keys, F.col(right_at).alias("__t"), F.lit(1).alias("__side"), F.struct(F.col(right_at).alias("__at"), *values).alias("__v"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__row"))
    own = left.select(*keys, F.col(at).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(side.schema["__v"].dataType).alias("__v"), F.struct(*(F.col(c) for c in left.columns)).alias("__row"))
    # Of equal times the left row comes first, so only earlier rows are seen.
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = own.unionByName(side).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 0")
    return out.select("__row.*", F.col("__v.__at").alias(f"{right_at}_before"), *(F.col(f"__v.{c}").alias(f"{c}_before") for c in values))


def previous_season_all(rows: DataFrame, group: Sequence[str], member: str, season: str, snapshot: DataFrame, value: str) -> DataFrame:
    """Groups all of whose members are in the snapshot of the season before: their number and mean value. snapshot: member, season, value."""
    before = snapshot.select(member, (F.col(season) + 1).alias(season), F.col(value).alias("__v"))
    out = rows.select(*group, season, member).distinct().join(before, [member, season], "left").groupBy(*group, season).agg(F.count("*").alias("members"), F.count("__v").alias("known"), F.avg("__v").alias("mean_value"))
    return out.where("known = members").drop("known")


def returning(current: DataFrame, earlier: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of current whose keys occur earlier, and those that are new."""
    seen = earlier.select(*keys).distinct()
    return current.join(seen, list(keys), "left_semi"), current.join(seen, list(keys), "left_anti")


def dense_grid(entities: DataFrame, seasons: Sequence[int], facts: DataFrame, keys: Sequence[str], season: str, defaults: dict) -> DataFrame:
    """A row for every entity and season, facts where there are some and defaults elsewhere."""
    grid = entities.select(*keys).distinct().withColumn(season, F.explode(F.lit(list(seasons))))
    return grid.join(facts, [*keys, season], "left").fillna(defaults)


def holds_all(rows: DataFrame, files: DataFrame, keys: Sequence[str], wanted: str, held: str, file: str) -> DataFrame:
    """Each row with the first file of its keys that holds all of the wanted members; rows without one go.

    Equal sets are one class on either side. A class of wanted members is looked up only by that one of them which the fewest classes of
    files hold, so neither many files nor a member that most of them hold are joined with every row.
    """
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    k = list(keys)
    sets = files.groupBy(*k, as_set(F.col(held)).alias("__held")).agg(F.min(file).alias("__file"))
    asking = rows.withColumn("__wanted", as_set(F.col(wanted)))
    asked = asking.select(*k, "__wanted").distinct()
    listed = sets.withColumn("__m", F.explode("__held"))
    often = listed.groupBy(*k, "__m").agg(F.count("*").alias("__n"))
    rare = asked.withColumn("__m", F.explode("__wanted")).join(often, [*k, "__m"], "left").groupBy(*k, "__wanted").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)), "__m"))["__m"].alias("__m"))
    found = rare.join(listed, [*k, "__m"]).where(F.size(F.array_except("__wanted", "__held")) == 0).groupBy(*k, "__wanted").agg(F.min("__file").alias(file))
    anything = asked.where(F.size("__wanted") == 0).join(sets.where("__held is not null").groupBy(*k).agg(F.min("__file").alias(file)), k)
    return asking.join(found.unionByName(anything.select(found.columns)), [*k, "__wanted"]).select(*rows.columns, file)


def scoped_alias(rows: DataFrame, aliases: DataFrame, name: str, scopes: Sequence[str], into: str) -> DataFrame:
    """The canonical name by the alias whose scopes (null: any) all fit the row, the most scoped one first; else the name itself.

    aliases: alias, canonical and one column for each scope. It is a curated table, so a row meets few aliases.
    """
    x = rows.withColumn("__id", F.struct(*rows.columns))
    a = aliases.select(F.col("alias").alias("__alias"), F.col("canonical").alias("__canonical"), *(F.col(s).alias(f"__s_{s}") for s in scopes))
    fits = F.col(name) == F.col("__alias")
    narrow = F.lit(0)
    for s in scopes:
        fits = fits & (F.col(f"__s_{s}").isNull() | (F.col(f"__s_{s}") == F.col(s)))
        narrow = narrow + F.col(f"__s_{s}").isNotNull().cast("int")
    hits = x.dropDuplicates(["__id"]).join(a, fits).groupBy("__id").agg(F.min_by("__canonical", F.struct(-narrow, F.col("__canonical"))).alias("__c"))
    return x.join(hits, "__id", "left").withColumn(into, F.coalesce("__c", name)).select(*rows.columns, into)


def best_overlap(cells: DataFrame, columns: DataFrame, keys: Sequence[str], least: float = 0.0) -> DataFrame:
    """Each cell (x0, x1) with the column (c0, c1, column) of its keys that it overlaps most; the first one of equals."""
    both = cells.join(columns, list(keys))
    overlap = F.least("x1", "c1") - F.greatest("x0", "c0")
    best = both.withColumn("overlap", overlap).where(F.col("overlap") > least)
    return best.groupBy(*cells.columns).agg(F.max_by(F.struct("column", "overlap"), F.struct("overlap", -F.col("column"))).alias("b")).select(*cells.columns, "b.*")


def equal_sets(left: DataFrame, right: DataFrame, members: str, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows whose member arrays hold the same values, in any order. The right side's other columns must have other names."""
    sign = F.array_join(F.array_sort(F.array_distinct(F.transform(members, lambda m: m.cast("string")))), "\x00")
    other = right.withColumn("__set", sign).drop(members)
    return left.withColumn("__set", sign).join(other, ["__set", *keys]).drop("__set")


def set_meetings(rows: DataFrame, key: str, members: str) -> DataFrame:
    """rows with meetings, how many other rows hold the same members in any order, and first_other, the least key of these. Rows meet their set's summary, not each other."""
    x = rows.withColumn("__set", F.array_join(F.array_sort(F.array_distinct(F.transform(members, lambda m: m.cast("string")))), "\x00"))
    first = x.groupBy("__set").agg(F.count("*").alias("__n"), F.min(key).alias("__first"))
    second = x.join(first, "__set").where(F.col(key) != F.col("__first")).groupBy("__set").agg(F.min(key).alias("__second"))
    out = x.join(first, "__set").join(second, "__set", "left")
    return out.select(*rows.columns, (F.col("__n") - 1).alias("meetings"), F.when(F.col(key) == F.col("__first"), F.col("__second")).otherwise(F.col("__first")).alias("first_other"))


def faceted(rows: DataFrame, facets: dict[str, Sequence]) -> DataFrame:
    """Rows that meet every facet that has values; a facet without values allows all. Conditions reach the scan."""
    for column, values in facets.items():
        if values:
            rows = rows.where(F.col(column).isin(*values))
    return rows
