"""Tables from placed characters: where a page divides, which columns and rows it has, and what stands in each cell.

Characters: the keys of a page (or of one side of it), x0, x1, top, size, text. A character without a place is left out. A line is a band of three units of height;
columns and divisions are voted on by lines, so a heading across the page is one vote. What a page holds is counted before it is
shuffled (lines that cover a unit of width); arrays hold a page's columns, or the different heights of characters without a clear gap between them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import merge_intervals

PLACES = ("x0", "x1", "top", "size")


def _placed(chars: DataFrame) -> DataFrame:
    return chars.where(" AND ".join(f"{c} IS NOT NULL" for c in (*PLACES, "text")) + " AND x1 >= x0")


def _line() -> Column:
    return F.bround(F.col("top") / 3, 0).cast("long")


def body_characters(chars: DataFrame, keys: Sequence[str], larger: float = 1.3, rare: float = 0.1, least: float = 0.5) -> DataFrame:
    """chars without headings: sizes (to one place) over `larger` times the most frequent one that less than a share of `rare` has. A page that would keep less than `least` keeps all.

    Of equally frequent sizes the smallest is the usual one.
    """
    x = _placed(chars).withColumn("__size", F.bround("size", 1))
    sizes = x.groupBy(*keys, "__size").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys)
    usual = F.min_by("__size", F.struct(-F.col("__n"), F.col("__size"))).over(w)
    sizes = sizes.withColumn("__all", F.sum("__n").over(w)).withColumn("__heading", (F.col("__size") > usual * larger) & (F.col("__n") < F.col("__all") * rare))
    sizes = sizes.withColumn("__kept", F.sum(F.when(F.col("__heading"), 0).otherwise(F.col("__n"))).over(w))
    keep = sizes.where(~F.col("__heading") | (F.col("__kept") < F.col("__all") * least)).select(*keys, "__size")
    return x.join(keep, [*keys, "__size"], "left_semi").drop("__size")


def _covered(chars: DataFrame, keys: Sequence[str], origin: Column) -> DataFrame:
    """(keys, at, lines): how many lines have a character over the unit of width at origin + at; units that none covers have no row."""
    first, last = F.ceil(F.col("x0") - origin), F.floor(F.col("x1") - origin)
    x = chars.where(first <= last).select(*keys, _line().alias("line"), F.explode(F.sequence(first, last)).alias("at"))
    return x.distinct().groupBy(*keys, "at").agg(F.count("*").alias("lines"))


def table_columns(chars: DataFrame, keys: Sequence[str], gap: float = 6, share: float = 0.04, brackets: bool = False) -> DataFrame:
    """(keys, column, c0, c1): stretches of width that at least two lines and a share of all lines use, joined where at most `gap` lies between. Columns count from 0.

    With `brackets`, columns end at bracket characters, and none is joined over one.
    """
    x = _placed(chars)
    lines = x.groupBy(*keys).agg(F.count_distinct(_line()).alias("__lines"))
    used = _covered(x, keys, F.lit(0)).join(lines, list(keys)).where(F.col("lines") >= F.greatest(F.lit(2), F.col("__lines") * share)).select(*keys, "at")
    part = list(keys)
    if brackets:
        cut = x.where(F.col("text").isin("(", ")", "（", "）")).select(*keys, F.explode(F.sequence(F.col("x0").cast("long"), F.col("x1").cast("long"))).alias("at")).distinct()
        marked = used.join(cut.withColumn("__cut", F.lit(1)), [*keys, "at"], "full").withColumn("__cut", F.coalesce("__cut", F.lit(0)))
        used = marked.withColumn("__stretch", F.sum("__cut").over(Window.partitionBy(*keys).orderBy("at"))).where("__cut = 0")
        part.append("__stretch")
    runs = merge_intervals(used.select(*part, F.col("at").alias("c0"), F.col("at").alias("c1")), part, "c0", "c1", gap)
    return runs.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("c0")) - 1).alias("column"), F.col("c0").cast("double").alias("c0"), F.col("c1").cast("double").alias("c1"))


def side_split(chars: DataFrame, keys: Sequence[str], share: float = 0.9, least_width: float = 8, least_gap: float = 15) -> DataFrame:
    """(keys, split): where a page divides into two sides; null where it doesn't.

    By vote: the widest stretch between 30 % and 70 % of the width that a share of all lines leaves free, the first of equals (pages of 20
    characters and five lines). Without one: the middle of the gap of body characters that is nearest to the middle of the page, within a quarter of its width.
    """
    x = _placed(chars)
    page = x.groupBy(*keys).agg(F.min("x0").alias("__x0"), F.max("x1").alias("__x1"), F.count("*").alias("__n"), F.count_distinct(_line()).alias("__lines"))
    width = F.col("__x1") - F.col("__x0")
    page = page.withColumn("__lo", F.col("__x0") + width * 0.3).withColumn("__hi", F.col("__x0") + width * 0.7)
    voters = page.where("__n >= 20 AND __lines >= 5").select(*keys, "__lo", "__hi", "__lines")
    taken = _covered(x.join(voters, list(keys)), [*keys], F.col("__lo"))
    units = voters.select(*keys, "__lo", "__lines", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("__hi") - F.col("__lo")))).alias("at"))
    free = units.join(taken, [*keys, "at"], "left").where(F.col("__lines") - F.coalesce("lines", F.lit(0)) >= F.col("__lines") * share)
    runs = merge_intervals(free.select(*keys, "__lo", F.col("at").alias("a"), F.col("at").alias("b")), [*keys, "__lo"], "a", "b", 1)
    wide = runs.groupBy(*keys, "__lo").agg(F.max_by(F.struct("a", "b"), F.struct(F.col("b") - F.col("a"), -F.col("a"))).alias("r")).where(F.col("r.b") - F.col("r.a") >= least_width)
    voted = wide.select(*keys, (F.col("__lo") + (F.col("r.a") + F.col("r.b")) / 2).alias("__voted"))

    body = body_characters(x, keys).join(voted, list(keys), "left_anti")
    runs = merge_intervals(body.select(*keys, "x0", "x1"), list(keys), "x0", "x1")
    w = Window.partitionBy(*keys)
    runs = runs.select(*keys, "x1", F.lead("x0").over(w.orderBy("x0")).alias("__next"), F.min("x0").over(w).alias("__left"), F.max("x1").over(w).alias("__right"))
    middle = (F.col("x1") + F.col("__next")) / 2
    off = F.abs(middle - (F.col("__left") + F.col("__right")) / 2)
    gaps = runs.where((F.col("__next") - F.col("x1") >= least_gap) & (off <= (F.col("__right") - F.col("__left")) * 0.25))
    nearest = gaps.groupBy(*keys).agg(F.min_by(middle, F.struct(off, F.col("x1"))).alias("__gap"))
    return page.select(*keys).join(voted, list(keys), "left").join(nearest, list(keys), "left").select(*keys, F.coalesce("__voted", "__gap").alias("split"))


def table_rows(chars: DataFrame, keys: Sequence[str], tolerance: float = 3.0, small: float = 6.5, loose: float = 4.0) -> DataFrame:
    """chars with `row`, from 1: a row begins at a character that lies over `tolerance` below its row's first one (`loose` if it or the one before is smaller than `small`).

    A gap over both tolerances always begins a row, so only heights between such gaps are folded, one entry for each different height.
    """
    w = Window.partitionBy(*keys).orderBy("top", "x0", "x1", "text", "size")
    x = _placed(chars).withColumn("__n", F.row_number().over(w))
    either = (F.col("size") < small) | F.coalesce(F.lag("size").over(w) < small, F.lit(False))
    x = x.withColumn("__loose", either)
    tight = F.min(F.when(~F.col("__loose"), F.col("__n")))
    tops = x.groupBy(*keys, "top").agg(F.min("__n").alias("any"), tight.alias("tight"))
    down = Window.partitionBy(*keys).orderBy("top")
    wide = max(tolerance, loose)
    clear = F.coalesce(F.col("top") - F.lag("top").over(down) > wide, F.lit(True))
    tops = tops.withColumn("__clear", clear).withColumn("__chain", F.sum(F.col("__clear").cast("int")).over(down))
    chain = tops.groupBy(*keys, "__chain").agg(F.array_sort(F.collect_list(F.struct("top", "any", "tight"))).alias("tops"))

    def step(state: Column, t: Column) -> Column:
        below = t["top"] - state["anchor"]
        at = F.when(state["anchor"].isNull() | (below > wide), t["any"]).when(below > tolerance, t["tight"])
        return F.struct(F.when(at.isNotNull(), t["top"]).otherwise(state["anchor"]).alias("anchor"), F.when(at.isNotNull(), F.array_append(state["starts"], at)).otherwise(state["starts"]).alias("starts"))

    none = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("starts"))
    starts = chain.select(*keys, F.explode(F.aggregate(F.transform("tops", lambda t: F.struct(t["top"].cast("double").alias("top"), t["any"].alias("any"), t["tight"].alias("tight"))), none, step, lambda s: s["starts"])).alias("__n"))
    x = x.join(starts.withColumn("__start", F.lit(1)), [*keys, "__n"], "left")
    return x.withColumn("row", F.sum(F.coalesce("__start", F.lit(0))).over(Window.partitionBy(*keys).orderBy("__n"))).drop("__start", "__loose")


def table_cells(rows: DataFrame, columns: DataFrame, keys: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """(keys, row, top, column, text): a cell's characters from left to right, trimmed; cells without text are left out.

    A character belongs to the column that it overlaps most, the first of equals; without one, to the last of the nearest within `tolerance`, else to none.
    rows: of `table_rows`. The height of a row is that of its highest character, whether in a column or not.
    """
    page = columns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("column", "c0", "c1"))).alias("__columns"))
    x = rows.join(page, list(keys))
    over = F.array_max(F.transform("__columns", lambda c: F.struct((F.least(F.col("x1"), c["c1"]) - F.greatest(F.col("x0"), c["c0"])).alias("by"), (-c["column"]).alias("column"))))
    off = F.array_min(F.transform("__columns", lambda c: F.struct(F.greatest(c["c0"] - F.col("x1"), F.col("x0") - c["c1"], F.lit(0.0)).alias("by"), (-c["column"]).alias("column"))))
    near = F.when(off["by"] <= tolerance, -off["column"]) if tolerance > 0 else F.lit(None)
    x = x.withColumn("column", F.when(over["by"] > 0, -over["column"]).otherwise(near).cast("long")).withColumn("__top", F.min("top").over(Window.partitionBy(*keys, "row")))
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text", "__n"))), lambda c: c["text"]), ""))
    cells = x.where("column IS NOT NULL").groupBy(*keys, "row", F.col("__top").alias("top"), "column").agg(text.alias("text"))
    return cells.where("text <> ''")
