"""Fact tables from detail documents: a row for each player and match, and one for each player and entry.

Everything is a join on (tournament, year, category, entry), so the work is spread by category and entry, not by player.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import compatibility_key, person_key
from ..functions.labels import category_parts, placement_kind, placement_strength, resolve_tier, round_order
from ..operators.joins import first_wins
from ..sources import details as D

KEYS = D.KEYS


def player_index(players: DataFrame) -> DataFrame:
    """(key, player): ids by normalised name, the first one listed of each. players: position, id, lastName, firstName."""
    x = players.select("position", F.col("id").alias("player"), compatibility_key(F.concat_ws("", "lastName", "firstName")).alias("key"))
    return first_wins(x, ["key"], F.asc("position")).select("key", "player")


def identified(participants: DataFrame, index: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """participants with name, person key and player: the id by alias (tournament, year, lastName, firstName), else by name, else null."""
    x = participants.withColumn("name", F.concat_ws(" ", "lastName", "firstName")).withColumn("key", compatibility_key(F.concat_ws("", "lastName", "firstName")))
    x = x.join(index, "key", "left")
    if aliases is not None:
        a = aliases.select("tournament", "year", "lastName", "firstName", F.col("player").alias("__alias"), F.col("team").alias("__team"))
        x = x.join(a, ["tournament", "year", "lastName", "firstName"], "left").withColumn("player", F.coalesce("__alias", "player")).withColumn("team", F.coalesce("__team", "team")).drop("__alias", "__team")
    return x.withColumn("person", person_key(F.col("name"), F.coalesce("team", F.lit(""))))


def seats(entries: DataFrame, people: DataFrame) -> DataFrame:
    """(keys, entry, person, player, name, team, partner): who plays in which entry; the first listing of an id counts."""
    p = people.dropDuplicates([*KEYS, "id"]).select(*KEYS, "id", "person", "player", "name", "team")
    x = entries.select(*KEYS, "entry", F.explode("ids").alias("id")).join(p, [*KEYS, "id"])
    # An entry listed twice is one; its players are few.
    x = x.groupBy(*KEYS, "entry").agg(F.collect_set(F.struct("id", "person", "player", "name", "team")).alias("all"))
    others = F.filter("all", lambda o: o["id"] != F.col("s.id"))
    return x.select(*KEYS, "entry", "all", F.explode("all").alias("s")).select(*KEYS, "entry", "s.*", F.array_min(F.transform(others, lambda o: o["name"])).alias("partner"))


def match_facts(details: DataFrame, people: DataFrame, meta: DataFrame, seated: DataFrame | None = None) -> DataFrame:
    """A row for each player and match. meta: tournament, year, start, is_major, is_national (one row each). Matches of an entry against itself or one that shares a player are left out. seated: the seats, where they are already built.

    Matches meet the players of both sides while they are one row each; only then are they a row for each player.
    """
    d = D.standard(details)
    m = D.matches(d).where("entry_a is not null AND entry_b is not null AND entry_a <> entry_b")
    s = seats(D.entries(d), people) if seated is None else seated
    players = s.groupBy(*KEYS, "entry").agg(F.array_sort(F.collect_list(F.struct("person", "player", "name", "team", "partner", "id"))).alias("seats"))
    of = lambda a: players.select(*KEYS, F.col("entry").alias(f"entry_{a}"), F.col("seats").alias(f"seats_{a}"))
    m = m.join(of("a"), [*KEYS, "entry_a"]).join(of("b"), [*KEYS, "entry_b"])
    foes = lambda b: F.transform(f"seats_{b}", lambda p: F.struct(*(p[c].alias(c) for c in ("person", "player", "name", "team"))))
    side = lambda a, b: F.struct(F.col(f"entry_{a}").alias("entry"), F.col(f"entry_{b}").alias("other"), F.col(f"score_{a}").alias("own"), F.col(f"score_{b}").alias("against"), F.col(f"seats_{a}").alias("seats"), foes(b).alias("opponents"))
    own = [*KEYS, "match", "position", "round", "winner", "retired", "stage"]
    x = m.select(*own, F.explode(F.array(side("a", "b"), side("b", "a"))).alias("s")).select(*own, "s.*")
    x = x.select(*own, "entry", "other", "own", "against", "opponents", F.explode("seats").alias("p")).select(*own, "entry", "other", "own", "against", "opponents", "p.*").where(~F.exists("opponents", lambda o: o["person"] == F.col("person")))
    outcome = F.when(F.col("winner") == F.col("entry"), "win").when(F.col("winner") == F.col("other"), "lose").when(F.col("own") > F.col("against"), "win").when(F.col("own") < F.col("against"), "lose").otherwise("draw")
    x = x.withColumn("result", outcome).withColumn("counts", ~F.col("retired")).withColumn("round_order", round_order(F.col("round")))
    return _dated(x, meta).drop("winner")


def entry_facts(details: DataFrame, people: DataFrame, meta: DataFrame, seated: DataFrame | None = None) -> DataFrame:
    """A row for each player and entry, with its placement, and whether it reached the final and the semifinal. seated: the seats, where they are already built."""
    d = D.standard(details)
    rank = F.col("rank")
    kind = F.when(rank.isNotNull(), placement_kind(rank["kind"], rank["bestLevel"])).when(F.col("robin").isNotNull(), "group").otherwise("unknown")
    placed = D.results(d).select(*KEYS, "entry", kind.alias("placement"), rank["round"].alias("lost_round"), F.col("robin.rank").alias("group_rank"))
    s = seats(D.entries(d), people) if seated is None else seated
    x = s.join(placed, [*KEYS, "entry"], "left").fillna("unknown", ["placement"])
    x = x.withColumn("strength", placement_strength(F.col("placement"), F.coalesce("lost_round", F.lit(0))))
    return _dated(x.withColumn("reached_final", F.col("strength") >= 900).withColumn("reached_semifinal", F.col("strength") >= 800), meta)


def _dated(x: DataFrame, meta: DataFrame) -> DataFrame:
    """x with the edition's date and tier and the category's parts; editions without meta data have neither date nor a tier above local. Editions are few, so facts aren't moved for them."""
    out = x.join(F.broadcast(meta.select("tournament", "year", F.col("start").alias("date"), "is_major", "is_national")), ["tournament", "year"], "left").fillna(False, ["is_major", "is_national"])
    out = out.withColumn("tier", resolve_tier(F.col("is_major"), F.col("is_national"))).withColumn("__c", category_parts(F.col("category")))
    return out.withColumn("discipline", F.col("__c.kind")).withColumn("gender", F.col("__c.gender")).drop("__c")


def reverse_index(facts: DataFrame) -> DataFrame:
    """The bridge table (player, cat_key) of identified players."""
    return facts.where("player is not null").select("player", F.concat_ws("/", "tournament", F.col("year").cast("string"), "category").alias("cat_key")).distinct()


def latest_team(facts: DataFrame) -> DataFrame:
    """(person, team): as of the last appearance; of equal dates the last position counts."""
    w = Window.partitionBy("person").orderBy(F.desc_nulls_last("date"), F.desc("position"))
    return facts.where("team is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").select("person", "team")
