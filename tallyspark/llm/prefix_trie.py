"""Trie of conversation prefixes with subtree sums by heavy-path decomposition.

Conversations are sequences of turns (role, text). A node is a distinct sequence of first turns; its members are the conversations
that begin with it. Every node takes its largest child (most members, then smallest conversation) as its heavy child; heavy edges chain
into paths, each of which ends in a leaf. Any way down from the root leaves a path at most log2(conversations) times, as every other
child has at most half of its parent's members. Sums over subtrees are suffix sums along path arrays; going from the paths that hang
deepest up, the sum of a whole path is then added to the node that it hangs on, one round for each number of light edges.

Nodes are told apart by two 64-bit hashes: of each turn with its place, xored over the prefix, so that a parent's are known from its child's.

``rebuilt`` gives conversations the first turns of another: the first h turns of c - c % 20 replace as many of c, h = crc32(c) % 4.

Edge cases: a null role or text is empty; turns without an order come first, and those that tie come by role and then in the
order of their texts' hashes; repeated rows are turns of their own. Rows without a conversation are left out. A conversation whose turns are all
replaced by none is a member of the root only. An empty table has no nodes. Columns but the four aren't looked at.

Scale: turns are numbered by a range sort, in which a long conversation spans several tasks (``numbered``); texts stay where they are
read, hashes move on. Parents and nodes with over a thousandth of all rows are broadcast (1,000 rows at most), so no key of a
join has more. Path arrays come in blocks of ``block`` nodes, so neither a long conversation nor a common prefix is ever one row. The ids that
end in a node are joined in runs of 4,096 possible ids, and only these runs are streamed through its digest in order, in one
task for each node, as SHA-256 needs: that is a third of all ids where a third of all conversations are equal, in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import written

KEY = ["depth", "px", "py"]
#: A key with more than one in so many rows is hot; there are fewer such keys than this.
HOT = 1000
_EMPTY = hashlib.sha256(b"").hexdigest()


def _carried(totals: DataFrame, group: str, values: dict[str, Column]) -> DataFrame:
    """For groups that span several parts: (group, part, values folded over the group's earlier parts). At most one row for each part and its neighbours."""
    many = totals.groupBy(group).agg(F.count(F.lit(1)).alias("__parts")).where("__parts > 1").select(group)
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A part is a range, so all but its first and last group lie whole inside it: `many` has fewer rows than there are parts.
    return totals.join(F.broadcast(many), group).select(group, "part", *[v.over(earlier).alias(k) for k, v in values.items()])


def numbered(turns: DataFrame, group: str, order: list[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """turns with `part` and `pos` (1, 2, ... in a group), as a table, and the rows of each group by part. Parts are ranges of group and order, so one group may have many."""
    dealt = turns.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, f"{name}_sorted")
    sizes = written(dealt.groupBy("part", group).agg(F.count(F.lit(1)).alias("n")), f"{name}_sizes")
    before = _carried(sizes, group, {"__before": F.sum("n")})
    pos = F.row_number().over(Window.partitionBy("part", group).orderBy(*order)).cast("long")
    return written(dealt.withColumn("pos", pos).join(F.broadcast(before), [group, "part"], "left").withColumn("pos", F.col("pos") + F.coalesce("__before", F.lit(0))).drop("__before"), name), sizes


def _mixed(depth: Column, a: Column, b: Column) -> tuple[Column, Column]:
    return F.xxhash64(depth, a, b), F.xxhash64(F.lit("second"), depth, b, a)


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, turn, role, a, b, n_words): ids, orders and roles, with two hashes of role and text, and the number of words."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    found = conversations.where(F.col(id_col).isNotNull())
    return found.select(F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("second"), role, text).alias("b"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"))


def rebuilt(turns: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Prefixes and conversations: (c, depth, px, py, x, y, n_words, ends) for each turn of each rebuilt conversation, and (c, depth) of all of them, depth being their length."""
    placed, sizes = numbered(turns, "c", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("a"), F.col("b")], "turns")
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % heads).cast("long")
    lengths = sizes.groupBy("c").agg(F.sum("n").alias("own")).select("c", "own", h.alias("h"), (F.col("c") - F.col("c") % family).alias("base"))
    first = placed.where(F.col("pos") < heads).groupBy(F.col("c").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "n_words"))).alias("turns"))
    # A base has at most `family` conversations.
    convs = lengths.join(first, "base", "left").select("c", "own", "h", F.slice(F.coalesce("turns", F.expr("cast(array() AS array<struct<pos: bigint, a: bigint, b: bigint, n_words: bigint>>)")), F.lit(1), F.col("h").cast("int")).alias("head"))
    marked = F.transform("head", lambda t: F.struct(t["pos"].alias("depth"), *[v.alias(k) for k, v in zip("xy", _mixed(t["pos"], t["a"], t["b"]))], t["n_words"].alias("n_words")))
    convs = convs.select("c", "own", "h", F.size("head").cast("long").alias("k"), marked.alias("head"))
    convs = written(convs.select("*", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "conversations")

    fold = lambda turns, f: F.aggregate(turns, F.lit(0).cast("long"), lambda s, t: s.bitwiseXOR(t[f]))
    each = convs.select("c", "length", "head", F.posexplode("head").alias("i", "t"))
    ahead = each.select("c", "length", "t.*", *[fold(F.slice("head", F.lit(1), F.col("i") + 1), f).alias(f"p{f}") for f in "xy"])

    kept = placed.join(convs.select("c", "h", "k", "length", *[fold(F.col("head"), f).alias(f"h{f}") for f in "xy"]), "c").where("pos > h")
    kept = kept.withColumn("depth", F.col("pos") - F.col("h") + F.col("k"))
    kept = written(kept.select("c", "part", "length", "depth", "hx", "hy", *[v.alias(k) for k, v in zip("xy", _mixed(F.col("depth"), F.col("a"), F.col("b")))], "n_words"), "kept")
    totals = kept.groupBy("part", "c").agg(F.bit_xor("x").alias("tx"), F.bit_xor("y").alias("ty"))
    earlier = _carried(totals, "c", {"ex": F.bit_xor("tx"), "ey": F.bit_xor("ty")})
    running = Window.partitionBy("part", "c").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    own = kept.select("*", F.bit_xor("x").over(running).alias("rx"), F.bit_xor("y").over(running).alias("ry")).join(F.broadcast(earlier), ["c", "part"], "left")
    whole = lambda f: F.col(f"h{f}").bitwiseXOR(F.col(f"r{f}")).bitwiseXOR(F.coalesce(f"e{f}", F.lit(0).cast("long")))
    behind = own.select("c", "length", "depth", "x", "y", "n_words", whole("x").alias("px"), whole("y").alias("py"))
    prefixes = ahead.unionByName(behind).select("c", *KEY, "x", "y", "n_words", (F.col("depth") == F.col("length")).alias("ends"))
    return written(prefixes, "prefixes"), convs.select("c", F.col("length").alias("depth"))


def _node_table(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes with members and the parent's key; the root has depth 0 and no parent."""
    zero = F.lit(0).cast("long")
    found = prefixes.groupBy(*KEY).agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_words").alias("n_words"), F.first("x").alias("x"), F.first("y").alias("y"))
    found = found.select(*KEY, "conv_id", "n_convs", "n_words", F.col("px").bitwiseXOR(F.col("x")).alias("ux"), F.col("py").bitwiseXOR(F.col("y")).alias("uy"))
    root = convs.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("px"), zero.alias("py"), "conv_id", "n_convs", zero.alias("n_words"), F.lit(None).cast("long").alias("ux"), F.lit(None).cast("long").alias("uy"))
    return written(found.unionByName(root), "nodes")


def _by_key(rows: DataFrame, lookup: DataFrame, on: list[str], hot: Column, how: str = "left") -> DataFrame:
    """rows joined with lookup (unique by `on`): the hot keys, at most HOT, by broadcast, the rest by a shuffle."""
    common = lookup.where(hot)
    usual = rows.join(F.broadcast(common.select(*on)), on, "left_anti").join(lookup.where(~hot).hint("shuffle_merge"), on, how)
    return rows.join(F.broadcast(common), on).unionByName(usual)


def _linked(nodes: DataFrame) -> DataFrame:
    """Nodes with parent_conv_id, n_children and light (whether the edge to the parent is light)."""
    size = nodes.count()
    largest = F.max(F.struct("n_convs", (-F.col("conv_id")).alias("m")))
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("ux").alias("px"), F.col("uy").alias("py")).agg(F.count(F.lit(1)).alias("n_children"), largest.alias("top"))
    parents = nodes.join(below, KEY).select((F.col("depth") + 1).alias("depth"), F.col("px").alias("ux"), F.col("py").alias("uy"), F.col("conv_id").alias("parent_conv_id"), (-F.col("top.m")).alias("heavy"), "n_children")
    parents = written(parents, "parents")
    up = _by_key(nodes.where("depth > 0"), parents.withColumnRenamed("n_children", "n"), ["depth", "ux", "uy"], F.col("n") > size / HOT).drop("n")
    root = nodes.where("depth = 0").select("*", F.lit(None).cast("long").alias("parent_conv_id"), F.lit(None).cast("long").alias("heavy"))
    linked = up.unionByName(root).withColumn("light", F.coalesce(F.col("heavy") != F.col("conv_id"), F.lit(False))).drop("heavy")
    count = parents.select((F.col("depth") - 1).alias("depth"), F.col("ux").alias("px"), F.col("uy").alias("py"), "n_children")
    return written(linked.join(count, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "linked")


def _paths(linked: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Nodes with path (the conversation of the leaf where their heavy path ends), top (the depth where it begins) and level (light edges above it)."""
    rows = prefixes.count()
    leaves = linked.where("n_children = 0").select(F.col("conv_id").alias("path"), F.col("depth").alias("end"))
    # The smallest conversation of a leaf ends there, and its prefixes are all nodes above it.
    down = prefixes.select(F.col("c").alias("path"), *KEY).join(leaves, "path").where("depth <= end")
    down = written(down, "down")
    light = _by_key(down, linked.where("light").select(*KEY, "n_convs"), KEY, F.col("n_convs") > rows / HOT, "inner")
    tops = leaves.join(light.groupBy("path").agg(F.max("depth").alias("top"), F.count(F.lit(1)).alias("level")), "path", "left")
    tops = tops.select("path", F.coalesce("top", F.lit(0).cast("long")).alias("top"), F.coalesce("level", F.lit(0).cast("long")).alias("level"))
    inside = down.join(tops, "path").where("depth >= top").select(*KEY, "path", "top", "level")
    # One path has no light edge above it, and begins at the root.
    root = tops.where("level = 0").select(*[F.lit(0).cast("long").alias(k) for k in KEY], "path", "top", "level")
    return written(linked.join(inside.unionByName(root), KEY), "paths")


def _blocks(paths: DataFrame, block: int) -> DataFrame:
    """(level, path, block, first, leaves, tokens, on_path, on_depth): path arrays, by block; the last two say where the path hangs."""
    node = F.struct("depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("tokens"))
    arrays = paths.groupBy("level", "path", "top", F.floor(F.col("depth") / block).alias("block")).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    arrays = arrays.select("level", "path", "top", "block", F.col("nodes")[0]["depth"].alias("first"), F.col("nodes.leaves").alias("leaves"), F.col("nodes.tokens").alias("tokens"))
    heads = paths.where((F.col("depth") == F.col("top")) & (F.col("level") > 0)).select("path", F.col("ux").alias("px"), F.col("uy").alias("py"), (F.col("depth") - 1).alias("depth"))
    size = paths.count()
    held = paths.select(*KEY, F.col("path").alias("on_path"), "n_children")
    hangs = _by_key(heads, held, KEY, F.col("n_children") > size / HOT).select("path", "on_path", F.col("depth").alias("on_depth"))
    return written(arrays.join(hangs, "path", "left"), "blocks")


def _suffix_sums(blocks: DataFrame, hung: DataFrame | None, block: int) -> DataFrame:
    """blocks with their arrays as sums over the rest of the path, what hangs on it included."""
    if hung is None:
        held = blocks.select("*", F.lit(None).cast("array<struct<depth:long,leaves:long,tokens:long>>").alias("hung"))
    else:
        at = hung.groupBy(F.col("on_path").alias("path"), F.floor(F.col("on_depth") / block).alias("block")).agg(F.collect_list(F.struct(F.col("on_depth").alias("depth"), "leaves", "tokens")).alias("hung"))
        held = blocks.join(at, ["path", "block"], "left")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for name in ("leaves", "tokens"):
                sums = []
                for values, first, more in zip(x[name], x["first"], x["hung"]):
                    own = np.array(values, np.int64)
                    for one in more if more is not None else ():
                        own[one["depth"] - first] += one[name]
                    sums.append(np.cumsum(own[::-1])[::-1])
                x[name] = sums
            yield x.drop(columns="hung")

    summed = held.mapInPandas(add, blocks.schema)
    below = Window.partitionBy("path").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    rest = lambda name: F.coalesce(F.sum(F.col(name)[0]).over(below), F.lit(0).cast("long"))
    ahead = summed.select("*", rest("leaves").alias("l"), rest("tokens").alias("t"))
    return ahead.withColumn("leaves", F.transform("leaves", lambda v: v + F.col("l"))).withColumn("tokens", F.transform("tokens", lambda v: v + F.col("t"))).select(*blocks.columns)


def subtree_sums(paths: DataFrame, block: int = 1024) -> DataFrame:
    """(path, depth, n_leaves, saved_tokens) of every node, level by level from the paths that hang deepest."""
    ship_package(paths.sparkSession)
    blocks = _blocks(paths, block)
    deepest = blocks.agg(F.max("level")).first()[0]
    hung, done = None, []
    for level in range(-1 if deepest is None else deepest, -1, -1):
        sums = written(_suffix_sums(blocks.where(F.col("level") == level), hung, block), f"level{level}")
        done.append(sums)
        tops = sums.where(F.col("first") == F.col("top"))
        hung = tops.groupBy("on_path", "on_depth").agg(F.sum(F.col("leaves")[0]).alias("leaves"), F.sum(F.col("tokens")[0]).alias("tokens"))
    whole = blocks if not done else done[0]
    for sums in done[1:]:
        whole = whole.unionByName(sums)
    each = whole.select("path", "first", F.posexplode(F.arrays_zip("leaves", "tokens")).alias("i", "s"))
    return each.select("path", (F.col("first") + F.col("i")).alias("depth"), F.col("s.leaves").alias("n_leaves"), F.col("s.tokens").alias("saved_tokens"))


def digests(ends: DataFrame) -> DataFrame:
    """(depth, px, py, ends_sha256): the SHA-256 of the decimal ids `c` of each key, ascending, joined by commas."""
    runs = ends.groupBy(*KEY, F.shiftright("c", 12).alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, hashlib.sha256(), []
        for x in batches:
            for d, px, py, ids in zip(x["depth"], x["px"], x["py"], x["ids"]):
                if (d, px, py) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (d, px, py), hashlib.sha256(ids.encode())
            if out:
                yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
            out = []
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=[*KEY, "ends_sha256"])

    sorted_runs = runs.repartition(*KEY).sortWithinPartitions(*KEY, "run")
    return sorted_runs.mapInPandas(digest, "depth long, px long, py long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 20, heads: int = 4, block: int = 1024) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations."""
    prefixes, convs = rebuilt(turns_of(conversations, id_col, turn_col, role_col, text_col), family, heads)
    linked = _linked(_node_table(prefixes, convs))
    paths = _paths(linked, prefixes)
    sums = subtree_sums(paths, block)
    zero = F.lit(0).cast("long")
    ends = prefixes.where("ends").select("c", *KEY).unionByName(convs.where("depth = 0").select("c", "depth", zero.alias("px"), zero.alias("py")))
    found = paths.join(sums, ["path", "depth"]).join(digests(ends), KEY, "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
