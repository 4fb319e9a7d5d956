"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

Texts become template words: numbers, names (runs of capitalised words inside a sentence) and units are typed placeholders, the
rest is lower-cased without punctuation. Windows of ``window`` template words are hash-joined: all those of the benchmark
items and of the documents, at every word, so that any ``window`` words in a row that a document shares with an item bring
them together, wherever they stand; an item shorter than a window is looked up by its whole template. Then the item's whole template is laid on the document
where the windows met: it leaks if at least ``min_match`` of its words agree and the slots are consistent, that is, each
value of the item stands for one value of the document (two of its values may have become equal). Words count that agree at one offset, or
those of the runs of met windows that follow each other in both texts, whatever their offsets, so words may be put in or
left out. A run of ``passage`` words with consistent slots is a leak by itself. This catches verbatim
passages as well as questions with other numbers, names or units. A window of nothing but slots says nothing by its template, and any text
of numbers would meet any other there; such windows meet by their values instead. (What agrees in slots only has to have the item's own values
anyway, and where words agree besides, windows that hold one of them meet.)

Edge cases: a null or empty text has no windows. Where under half a window of the words that agree aren't placeholders, the
template alone tells too little, and the values have to be the item's own. An item of a few words so leaks wherever a
document holds them in a row. Rows without an id (on either side) are left out. Rows that repeat give one result for each id and item. Empty tables give an empty result.

Scale: the texts are read, canonicalised and probed in one pass without a shuffle. The benchmark's windows are broadcast up
to ``broadcast_rows``, beyond that they are shuffled by hash. Only documents that met a window are read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
#: Stands for the spaces inside a name.
JOINT = "\ue003"
_MARKS = f"{NUMBER}-{JOINT}"
# A run of capitalised words inside a sentence is one name. The class comes first: the engine looks behind only where it holds.
# Groups repeat possessively (*+), here and below: the engine loops over those, but calls itself for each repeat of a greedy one, and runs of 2000 overflow its stack.
_NAMES = r"\p{Lu}(?<=[\p{Ll}\p{N},;:)] .)[\p{L}\p{N}]*(?: \p{Lu}\p{Ll}[\p{L}\p{N}]*)*+"
# The same names in two steps, for texts that keep what stood in a slot: join the words of each run, then find it.
_RUNS = r"(\G(?!\A)|(?<=[\p{Ll}\p{N},;:)] ))(\p{Lu}[\p{L}\p{N}]*) (?=\p{Lu}\p{Ll})"
_JOINED = f"\\p{{Lu}}(?<=[\\p{{Ll}}\\p{{N}},;:)] .)[\\p{{L}}\\p{{N}}{JOINT}]*"
_NUMBERS = r"\p{N}+(?:[.,:/]\p{N}+)*+"
# Units that may follow a number.
UNITS = "kg|mg|g|km/h|km|cm|mm|ml|mph|mi|m|ft|lbs|lb|oz|hours|hour|hrs|hr|h|minutes|minute|mins|min|seconds|second|sec|ms|s|days|day|weeks|week|years|year|usd|eur|gbp|dollars|dollar|euros|euro|percent|%|°c|°f|°|$|€|£"
_UNITS = rf"(\p{{N}}) *((?i:{UNITS.replace('$', chr(92) + '$')}))(?![\p{{L}}\p{{N}}])"
_KEPT_NAME = f"({NAME}[\\p{{L}}\\p{{N}}{JOINT}]*)"
_PUNCTUATION = f"[^\\p{{L}} {_MARKS}]+"


def template_words(text: Column, values: bool = False) -> Column:
    """The template words of a text; with values, a slot is its placeholder followed by what stood there."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{_MARKS}]", " ")
    if not values:
        s = F.regexp_replace(s, _NAMES, f" {NAME} ")
        s = F.regexp_replace(s, _UNITS, f"$1 {UNIT} ")
        s = F.regexp_replace(s, _NUMBERS, f" {NUMBER} ")
        s = F.regexp_replace(s, _PUNCTUATION, " ")
    else:
        # What a name holds is neither number nor unit: it is matched first and put back, and the placeholder without a value that this leaves goes.
        s = F.regexp_replace(F.regexp_replace(s, _RUNS, f"$2{JOINT}"), _JOINED, f" {NAME}$0 ")
        s = F.replace(F.regexp_replace(s, f"{_KEPT_NAME}|{_UNITS}", f"$1$2 {UNIT}$3 "), F.lit(f"{UNIT} "), F.lit(""))
        s = F.replace(F.regexp_replace(s, f"{_KEPT_NAME}|({_NUMBERS})", f"$1 {NUMBER}$2 "), F.lit(f"{NUMBER} "), F.lit(""))
        s = F.regexp_replace(s, f"([{_MARKS}][^ ]*)|{_PUNCTUATION}", "$1 ")
    return F.array_remove(F.split(F.lower(s), " "), "")


def _is_slot(word: Column) -> Column:
    return word.rlike(f"^[{NUMBER}-{UNIT}]")


def _windows(words: Column, window: int) -> Column:
    """For each word, a struct of the ``window`` words from there on; null beyond the end."""
    return F.arrays_zip(*(F.slice(words, j + 1, F.greatest(F.size(words), F.lit(0))).alias(f"c{j}") for j in range(window)))


def _hash(length: int, values: bool = False) -> Column:
    """Hash of the first words of a window; null where the text ends before, and where all of them are slots, or, with values, not all of them. Plain columns, as these compile and lambdas don't."""
    # Not a regular expression: placeholders are the only words that begin beyond the letters.
    empty = reduce(lambda a, b: a & b, (F.col(f"x.c{j}").between(NUMBER, UNIT + "\U0010ffff") for j in range(length)))
    return F.when(F.col(f"x.c{length - 1}").isNotNull() & (empty if values else ~empty), F.xxhash64(F.lit(values), *(f"x.c{j}" for j in range(length))))


_PART = "struct<k: int, at: int, n: int>"


def _chain(runs: Column) -> Column:
    """The parts of runs (k, at, n; sorted) that cover most words of the item, each after the one before it in document and item; overlaps count once."""

    def longer(c: Column, r: Column) -> Column:
        over = F.greatest(F.lit(0), c["ie"] - r["at"], c["ke"] - r["k"])
        part = F.struct((r["k"] + over).alias("k"), (r["at"] + over).alias("at"), (r["n"] - over).alias("n"))
        return F.struct((c["total"] + part["n"]).alias("total"), (part["at"] + part["n"]).alias("ie"), (part["k"] + part["n"]).alias("ke"), F.concat(c["parts"], F.array(part)).alias("parts"))

    def add(chains: Column, r: Column) -> Column:
        new = F.array_max(F.filter(F.transform(chains, lambda c: longer(c, r)), lambda c: c["parts"][F.size(c["parts"]) - 1]["n"] > 0))
        # A chain that ends later in both and covers no more than another is of no use.
        beaten = lambda b: F.exists(chains, lambda c: (c["ie"] <= b["ie"]) & (c["ke"] <= b["ke"]) & (c["total"] >= b["total"]))
        return F.concat(chains, F.filter(F.array(new), lambda b: ~beaten(b)))

    none = F.array(F.struct(F.lit(0).alias("total"), F.lit(0).alias("ie"), F.lit(0).alias("ke"), F.array().cast(f"array<{_PART}>").alias("parts")))
    return F.array_max(F.aggregate(runs, none, add))["parts"]


def _part(k: Column, at: Column, n: Column) -> Column:
    return F.struct(k.cast("int").alias("k"), at.cast("int").alias("at"), n.cast("int").alias("n"))


def _candidates(met: DataFrame, sizes: DataFrame, window: int, passage: int, min_match: float) -> DataFrame:
    """(id, item, parts, own): what to lay on each document: the whole item at each offset, chains of runs at several offsets, and, with own, each long run. sizes: item, size (words).

    A chain is looked for within stretches of the document of four item lengths, which overlap by two, and only where runs at different offsets
    cover min_match of the item together; so its work is bounded by the item's length for each stretch, however often a text repeats itself.
    """
    w = Window.partitionBy("id", "item", "d").orderBy("at", "k")
    runs = met.withColumn("d", F.col("k") - F.col("at")).withColumn("run", F.col("at") - F.row_number().over(w))
    runs = runs.groupBy("id", "item", "d", "run").agg(F.min("k").alias("k"), F.min("at").alias("at"), F.count("*").alias("n"), F.min("length").alias("length"))
    runs = written(runs.select("id", "item", _part(F.col("k"), F.col("at"), F.col("n") + F.col("length") - 1).alias("r")), "runs")
    d = F.col("r.k") - F.col("r.at")
    whole = runs.select("id", "item", F.array(_part(F.greatest(d, F.lit(0)), F.greatest(-d, F.lit(0)), F.lit(2**31 - 1))).alias("parts")).distinct()
    long = runs.where(F.col("r.n") >= passage).select("id", "item", F.array("r").alias("parts"), F.lit(True).alias("own"))

    half = F.col("size") * 2
    near = runs.join(F.broadcast(sizes), "item").withColumn("block", F.explode(F.array(F.floor(F.col("r.k") / half), F.floor(F.col("r.k") / half) - 1)))
    several = Window.partitionBy("id", "item", "block")
    near = near.withColumn("low", F.min(d).over(several)).withColumn("high", F.max(d).over(several)).where("low < high")
    # Words that some run covers: each run adds what reaches beyond the runs that begin before it.
    before = F.max(F.col("r.at") + F.col("r.n")).over(several.orderBy("r.at", "r.k", "r.n").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("r.at") + F.col("r.n") - F.greatest(F.col("r.at"), F.coalesce(before, F.lit(0))))
    near = near.withColumn("fresh", fresh).withColumn("covered", F.sum("fresh").over(several)).where(F.col("covered") >= min_match * F.col("size"))
    chains = near.groupBy("id", "item", "block").agg(F.sort_array(F.collect_list("r")).alias("runs")).select("id", "item", _chain(F.col("runs")).alias("parts")).distinct()
    return whole.unionByName(chains).withColumn("own", F.lit(False)).unionByName(long)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 6, min_match: float = 0.8, passage: int = 13, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(id_col, item_col, n_words, n_equal, n_slots, changed): for each document and each item that it leaks, how far the templates agree and how many slots have another value."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    items = benchmark.select(F.col(item_col).alias("item"), template_words(F.col(item_text_col)).alias("iw"), template_words(F.col(item_text_col), True).alias("iv"))
    items = written(items.where(F.col("item").isNotNull() & (F.size("iw") > 0)), "items")
    # At most window lengths: those of items that are shorter, and window.
    lengths = sorted(r[0] for r in items.select(F.least(F.size("iw"), F.lit(window))).distinct().collect()) or [window]

    def keys(words: str, values: bool) -> DataFrame:
        """Where each item's windows begin."""
        x = items.select("item", F.least(F.size(words), F.lit(window)).alias("length"), F.posexplode(_windows(F.col(words), window)).alias("at", "x"))
        return x.select(F.coalesce(*(F.when(F.col("length") == n, _hash(n, values)) for n in lengths)).alias("h"), "item", "at", "length").where("h is not null")

    def probes(words: DataFrame, values: bool) -> DataFrame:
        x = words.select("id", F.posexplode(_windows(F.col("w"), lengths[-1])).alias("k", "x"))
        return x.select("id", "k", _hash(lengths[0], values).alias("h") if len(lengths) == 1 else F.explode(F.array(*(_hash(n, values) for n in lengths))).alias("h")).where("h is not null")

    def meet(asked: DataFrame, starts: DataFrame) -> DataFrame:
        small = starts.count() <= broadcast_rows
        return asked.join(F.broadcast(starts) if small else starts, "h").select("id", "item", "k", "at", "length").distinct()

    met = meet(probes(texts.select("id", template_words(F.col("text")).alias("w")), False), keys("iw", False))
    slots_only = written(keys("iv", True), "slot_windows")
    if not slots_only.isEmpty():
        # Only texts with so many slots in a row are read with their values.
        marks = F.array_join(F.transform(template_words(F.col("text")), lambda x: F.when(_is_slot(x), "s").otherwise(".")), "")
        full = texts.where(F.contains(marks, F.lit("s" * lengths[0])))
        met = met.unionByName(meet(probes(full.select("id", template_words(F.col("text"), True).alias("w")), True), slots_only)).distinct()
    met = written(met, "met")
    ids = met.select("id").distinct()
    again = texts.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, "id", "left_semi")
    sizes = items.groupBy("item").agg(F.max(F.size("iw")).alias("size"))
    # What is laid reaches over six item lengths at most; so a candidate meets a page of its document and never the whole of it.
    most = sizes.agg(F.max("size")).first()[0] or 1
    step, reach = 4 * most, 10 * most
    words = again.select("id", template_words(F.col("text")).alias("w"), template_words(F.col("text"), True).alias("v"))
    page = F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.size("w") - 1, F.lit(0)) / step).cast("int"))).alias("page")
    pages = words.select("id", "w", "v", page).select("id", "page", *(F.slice(c, F.col("page") * step + 1, reach).alias(c) for c in "wv"))
    laid = _candidates(met, sizes, window, passage, min_match).join(items, "item").withColumn("page", F.floor(F.col("parts")[0]["k"] / step).cast("int")).join(pages, ["id", "page"])

    def pairs(part: Column) -> Column:
        k = part["k"] - F.col("page") * step
        n = F.least(part["n"], F.size("iw") - part["at"], F.size("w") - k)
        cut = lambda words, start: F.slice(words, start + 1, n)
        return F.arrays_zip(cut("iw", part["at"]).alias("a"), cut("w", k).alias("b"), cut("iv", part["at"]).alias("p"), cut("v", k).alias("q"))

    laid = laid.withColumn("same", F.filter(F.flatten(F.transform("parts", pairs)), lambda x: x["a"] == x["b"]))
    slots = F.filter("same", lambda x: _is_slot(x["a"]))
    laid = laid.select("id", "item", "own", F.size("iw").cast("long").alias("n_words"), F.size("same").cast("long").alias("n_equal"), slots.alias("slots"))
    one = lambda f: F.size(F.array_distinct(F.transform("slots", f)))
    consistent = one(lambda x: F.struct(x["p"], x["q"])) == one(lambda x: x["p"])
    laid = laid.where((F.col("own") | (F.col("n_equal") >= min_match * F.col("n_words"))) & consistent)
    laid = laid.withColumn("n_slots", F.size("slots").cast("long")).withColumn("changed", F.size(F.filter("slots", lambda x: x["p"] != x["q"])).cast("long")).drop("slots")
    laid = laid.where((F.col("n_equal") - F.col("n_slots") >= window // 2) | (F.col("changed") == 0))
    best = laid.groupBy("id", "item").agg(F.max(F.struct("n_equal", "n_words", "n_slots", "changed")).alias("best"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.n_words", "best.n_equal", "best.n_slots", "best.changed")
