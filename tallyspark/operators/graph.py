"""Graphs: components, propagation to a fixpoint, depths and knockout draws. Each step is a grouped join; steps are tables in the shared folder."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import as_table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int | None = None) -> DataFrame:
    """(node, component): the least node that links reach, by alternating large-star and small-star steps (logarithmic rounds).

    A node with very many edges is no group in a task: its minimum is pre-aggregated and joined back (AQE splits it).
    Each round is a table in the shared folder, so lineage doesn't grow. Runs until nothing moves, or fails after most_rounds.
    """
    e = edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x <> y").distinct()
    before = None
    for k in count():
        if k == most_rounds:
            raise RuntimeError("components did not settle")
        both = e.union(e.select("y", "x"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x")
        e = as_table(small.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).union(small.select("x", "m")).distinct(), "edges")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y"))).first()
        if now == before:
            return e.select(F.col("x").alias("node"), F.col("y").alias("component")).union(e.select("y", "y").distinct())
        before = now


def greedy_merge(groups: DataFrame, shared: DataFrame, key: str, member: str, conflict: DataFrame) -> DataFrame:
    """Clusters of a key's members that share something and don't conflict: components of shared pairs (key, a, b) without those of conflict (key, a, b); members alone stay alone."""
    pair = lambda d: d.select(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    clean = pair(shared).join(pair(conflict).distinct(), [key, "a", "b"], "left_anti")
    tag = lambda c: F.concat_ws("\x00", F.col(key).cast("string"), F.col(c).cast("string"))
    found = connected_components(clean.select(tag("a").alias("a"), tag("b").alias("b")))
    x = groups.select(key, member).distinct().withColumn("node", tag(member)).join(found, "node", "left")
    return x.select(key, member, F.coalesce(F.substring_index("component", "\x00", -1), F.col(member).cast("string")).alias("cluster"))


def place_greedily(clusters: DataFrame, conflict: DataFrame, key: str, cluster: str, weight: str) -> DataFrame:
    """clusters with person from 0: those of a key, heaviest first (equals by name), each go to the first person that holds none they conflict with, else to a new one.

    clusters: key, cluster, weight, once each. conflict: key, a, b, either way round. The clusters of a key (the teams of a name) are few enough for one row's array.
    """
    both = conflict.select(key, "a", "b").union(conflict.select(key, "b", "a")).groupBy(key, F.col("a").alias(cluster)).agg(F.collect_set("b").alias("__against"))
    x = clusters.select(key, cluster, weight).join(both, [key, cluster], "left")
    x = x.withColumn("__against", F.coalesce("__against", F.array().cast(both.schema["__against"].dataType)))
    x = x.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col(weight)).alias("w"), F.col(cluster).alias("c"), F.col("__against").alias("against")))).alias("all"))

    def place(persons, c):
        fits = F.transform(persons, lambda p: ~F.arrays_overlap(p, c["against"]))
        at = F.array_position(fits, True)
        put = F.transform(persons, lambda p, i: F.when(i + 1 == at, F.concat(p, F.array(c["c"]))).otherwise(p))
        return F.when(at > 0, put).otherwise(F.concat(persons, F.array(F.array(c["c"]))))

    kind = f"array<array<{clusters.schema[cluster].dataType.simpleString()}>>"
    x = x.select(key, F.posexplode(F.aggregate("all", F.array().cast(kind), place)).alias("person", "held"))
    return clusters.join(x.select(key, "person", F.explode("held").alias(cluster)), [key, cluster])


def opposite_closure(pairs: DataFrame, known: DataFrame, values: tuple[str, str], most_rounds: int | None = None) -> DataFrame:
    """(node, value): known values spread over pairs (a, b), whose ends have opposite values, until nothing new is learnt. A node keeps its first value; of several in one round the least. Fails after most_rounds, if given."""
    x, y = values
    both = pairs.select("a", "b").union(pairs.select("b", "a")).distinct()
    state = as_table(known.select("node", "value").dropDuplicates(["node"]), "known")
    fresh = state
    for k in count():
        if k == most_rounds:
            raise RuntimeError("values did not settle")
        flipped = F.when(F.col("value") == x, y).otherwise(x)
        learnt = both.join(fresh, both["a"] == fresh["node"]).groupBy(F.col("b").alias("node")).agg(F.min(flipped).alias("value")).join(state, "node", "left_anti")
        fresh = as_table(learnt, "learnt")
        if fresh.isEmpty():
            return state
        state = as_table(state.unionByName(fresh), "known")


def depths(edges: DataFrame, nodes: DataFrame, group: Sequence[str], most: int | None = None) -> DataFrame:
    """nodes with depth: the longest path of (node, previous) edges that ends there, 0 for those without one. Nodes on a cycle, or after one, have none. A round for each level; fails where there are more than `most`, if given."""
    state = as_table(nodes.select(*group, "node").distinct().join(edges.select(*group, "node").distinct(), [*group, "node"], "left_anti").withColumn("depth", F.lit(0)), "depths")
    for d in count(1):
        # A node is ready once all of its predecessors are done.
        e = edges.select(*group, "node", "previous").distinct().join(state.select(*group, "node"), [*group, "node"], "left_anti")
        done = state.select(*group, F.col("node").alias("previous"), "depth")
        ready = e.join(done, [*group, "previous"], "left").groupBy(*group, "node").agg(F.count("*").alias("n"), F.count("depth").alias("k")).where("n = k")
        ready = as_table(ready.select(*group, "node", F.lit(d).alias("depth")), "ready")
        if ready.isEmpty():
            break
        if most is not None and d > most:
            raise RuntimeError("depths did not settle")
        state = as_table(state.unionByName(ready), "depths")
    return nodes.select(*group, "node").distinct().join(state, [*group, "node"], "left")


def draw_slots(entries: DataFrame, draw: Sequence[str], order: str, kind: str) -> DataFrame:
    """entries with slot from 0: a seed or extra entry takes a pair of slots alone and sits in its first; packed entries take one each, and an odd run is filled up to a pair."""
    w = Window.partitionBy(*draw).orderBy(order)
    x = entries.withColumn("__packed", (F.col(kind) == "packing").cast("int")).withColumn("__run", F.sum(F.when(F.col("__packed") == 1, 0).otherwise(1)).over(w))
    # Within a draw: every seed before counts two slots; each run of packed entries before counts its length, made even.
    run = Window.partitionBy(*draw, "__run").orderBy(order)
    x = x.withColumn("__in_run", F.coalesce(F.sum("__packed").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = x.groupBy(*draw, "__run").agg((F.count(F.when(F.col("__packed") == 0, 1)) * 2 + F.ceil(F.sum("__packed") / 2) * 2).alias("__width"))
    start = runs.withColumn("__start", F.coalesce(F.sum("__width").over(Window.partitionBy(*draw).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    seeds = F.when(F.col("__packed") == 1, F.when(F.col("__run") > 0, 2).otherwise(0)).otherwise(0)
    out = x.join(start.select(*draw, "__run", "__start"), [*draw, "__run"])
    return out.withColumn("slot", (F.col("__start") + seeds + F.when(F.col("__packed") == 1, F.col("__in_run")).otherwise(0)).cast("long")).drop("__packed", "__run", "__in_run", "__start")


def draw_winners(slots: DataFrame, results: DataFrame, draw: Sequence[str], rounds: int) -> DataFrame:
    """Who sits where in each round of a knockout draw: (draw, round, slot, entry). An entry without an opponent goes on (a bye); an undecided match leaves its slot empty.

    slots: draw, slot, entry. results: draw, winner, loser. Rounds are few (log2 of a draw's size), each a grouped join.
    """
    now = slots.select(*draw, F.lit(0).alias("round"), "slot", "entry")
    every = now
    for r in range(1, rounds + 1):
        pairs = now.groupBy(*draw, F.floor(F.col("slot") / 2).alias("slot")).agg(F.min("entry").alias("p"), F.max("entry").alias("q"), F.count("*").alias("n"))
        won = results.select(*draw, F.col("winner").alias("__w"), F.least("winner", "loser").alias("p"), F.greatest("winner", "loser").alias("q")).dropDuplicates([*draw, "p", "q"])
        now = pairs.join(won, [*draw, "p", "q"], "left").withColumn("entry", F.when(F.col("n") == 1, F.col("p")).otherwise(F.col("__w"))).where("entry is not null").select(*draw, F.lit(r).alias("round"), "slot", "entry")
        every = every.unionByName(now)
    return every
