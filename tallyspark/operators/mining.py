"""Lift mining: combinations of conditions that occur far less often together than their own frequencies make likely."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import as_table


#: Counts as whole numbers of 38 digits; products that don't fit are taken in doubles, in the order of the conditions.
_EXACT = "decimal(38,0)"


def _product(values: Column, times: Column) -> tuple[Column, Column]:
    """The product of an array of counts with `times`: exact (null where it doesn't fit), and as a double."""
    exact = F.aggregate(values, times.cast(_EXACT), lambda p, v: F.try_multiply(p, v.cast(_EXACT)).cast(_EXACT))
    return exact, F.coalesce(exact.cast("double"), F.aggregate(values, times.cast("double"), lambda p, v: p * v))


def pattern_lattice(rows: DataFrame, features: Sequence[str], sizes: Sequence[int], scope: Sequence[str] = ()) -> DataFrame:
    """(scope, size, pattern, atoms, n, universe, marginals, expected, lift) for every observed combination of so many features, all sizes in one pass.

    A combination's universe is the rows of its scope in which all its features are defined; marginals are the counts of its conditions within that.
    expected = product of marginals / universe^(size - 1), and lift = n * universe^(size - 1) / that product: whole numbers, divided once.
    Rows are counted once for each set of feature values (cells), which Spark pre-aggregates; all else are sums over cells.
    """
    keys = list(scope)
    sets = [list(c) for k in sizes for c in combinations(sorted(features), k)]
    cells = rows.select(*keys, *(F.col(f).cast("string").alias(f) for f in features)).groupBy(*keys, *features).agg(F.count("*").alias("__c"))
    atoms = lambda s: F.array(*(F.concat(F.lit(f"{f}="), F.col(f)) for f in s))
    names = F.array(*(F.struct(F.lit(",".join(s)).alias("set"), F.when(F.forall(F.array(*s), lambda x: x.isNotNull()), atoms(s)).alias("atoms")) for s in sets))
    x = cells.select(*keys, F.explode(names).alias("s"), "__c").select(*keys, "s.set", "s.atoms", "__c").where("atoms is not null")
    seen = x.groupBy(*keys, "set", "atoms").agg(F.sum("__c").alias("n"))
    universe = x.groupBy(*keys, "set").agg(F.sum("__c").alias("universe"))
    marginal = x.select(*keys, "set", F.explode("atoms").alias("atom"), "__c").groupBy(*keys, "set", "atom").agg(F.sum("__c").alias("m"))
    each = seen.select("*", F.posexplode("atoms").alias("i", "atom")).join(marginal, [*keys, "set", "atom"])
    found = each.groupBy(*keys, "set", "atoms", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("marginals")).join(universe, [*keys, "set"])
    others = F.transform(F.sequence(F.lit(2), F.size("atoms")), lambda _: F.col("universe"))
    _, product = _product(F.col("marginals"), F.lit(1))
    _, power = _product(others, F.lit(1))
    _, weighed = _product(others, F.col("n"))
    return found.select(*keys, F.size("atoms").alias("size"), F.array_join("atoms", " & ").alias("pattern"), "atoms", "n", "universe", "marginals", (product / power).alias("expected"), (weighed / product).alias("lift"))


def pattern_lifts(rows: DataFrame, features: Sequence[str], size: int) -> DataFrame:
    """(pattern, atoms, n, universe, expected, lift) for every observed combination of `size` features."""
    return pattern_lattice(rows, features, [size]).select("pattern", "atoms", "n", "universe", "expected", "lift")


def rounded_share(above: Column, below: Column, places: int) -> Column:
    """above / below of whole numbers, rounded half up to so many places without a float in between; null where that takes over 38 digits."""
    times = F.try_multiply(above.cast(_EXACT), F.lit(2 * 10**places).cast(_EXACT)).cast(_EXACT)
    return F.call_function("div", F.try_add(times, below.cast(_EXACT)).cast(_EXACT), F.try_multiply(below.cast(_EXACT), F.lit(2).cast(_EXACT)).cast(_EXACT)) / F.lit(float(10**places))


def exact_lift(found: DataFrame, places: tuple[int, int] = (4, 6)) -> DataFrame:
    """A lattice's rows with expected and lift rounded half up from whole numbers."""
    others = F.transform(F.sequence(F.lit(2), F.size("marginals")), lambda _: F.col("universe"))
    product, power, weighed = (_product(*p)[0] for p in ((F.col("marginals"), F.lit(1)), (others, F.lit(1)), (others, F.col("n"))))
    whole = found.withColumn("__p", product).withColumn("__u", power).withColumn("__w", weighed)
    whole = whole.withColumn("expected", F.coalesce(rounded_share(F.col("__p"), F.col("__u"), places[0]), F.round("expected", places[0])))
    return whole.withColumn("lift", F.coalesce(rounded_share(F.col("__w"), F.col("__p"), places[1]), F.round("lift", places[1]))).drop("__p", "__u", "__w")


def most_lift(size: int, most: float = 0.5, tighten: float = 0.7) -> float:
    """The lift allowed for so many conditions: each beyond the second makes it stricter."""
    return most * tighten ** max(0, size - 2)


def rare_patterns(rows: DataFrame, features: Sequence[str], most_conditions: int = 3, most_count: int = 3, least_expected: float = 3.0, lift: float = 0.5, tighten: float = 0.7, scope: Sequence[str] = ()) -> DataFrame:
    """A lattice's patterns of at most most_count rows, with a verdict: "rare", "reducible" (one of its parents, with a condition less, is as rare already) or "complex" (few, but as chance has it).

    Levels go up from two conditions; each is held against the level below it, in its own scope.
    """
    keys = list(scope)
    sizes = range(2, most_conditions + 1)
    allowed = F.element_at(F.create_map(*(F.lit(v) for k in sizes for v in (k, most_lift(k, lift, tighten)))), F.col("size"))
    few = pattern_lattice(rows, features, sizes, scope).where(F.col("n") <= most_count)
    few = as_table(few.withColumn("__low", F.col("lift") <= allowed).withColumn("__rare", F.col("__low") & (F.col("expected") >= least_expected)), "patterns")
    parts = F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.array_join(F.filter(F.col("atoms"), lambda a: a != F.element_at(F.col("atoms"), i)), " & "))
    parents = few.where("__low").select(*keys, F.col("pattern").alias("parent"))
    above = few.where("__rare and size > 2").select(*keys, "pattern", F.explode(parts).alias("parent")).join(parents, [*keys, "parent"], "left_semi").select(*keys, "pattern").distinct().withColumn("__sub", F.lit(True))
    verdict: Column = F.when(F.col("__rare") & F.col("__sub"), "reducible").when(F.col("__rare"), "rare").otherwise("complex")
    return few.join(above, [*keys, "pattern"], "left").withColumn("verdict", verdict).drop("__low", "__rare", "__sub")


def single_conditions(rows: DataFrame, features: Sequence[str], most_count: int = 3) -> DataFrame:
    """(atom, n, universe): single conditions that are rare by themselves."""
    pairs = F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in features))
    x = rows.select(F.explode(pairs).alias("p")).select("p.*").where("v is not null").groupBy("f", "v").agg(F.count("*").alias("n"))
    x = x.withColumn("universe", F.sum("n").over(Window.partitionBy("f")))
    return x.where(F.col("n") <= most_count).select(F.concat_ws("=", "f", "v").alias("atom"), "n", "universe")


def matching(rows: DataFrame, condition: dict) -> DataFrame:
    """Rows with all of the given values."""
    for k, v in condition.items():
        rows = rows.where(F.col(k) == v)
    return rows
