"""Documents to facts to statistics, on a small made-up tournament."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import facts as T
from tallyspark.plans import mainpath
from tallyspark.plans.statistics import SECTIONS, statistics
from tallyspark.sources import details as D
from tallyspark.sources import sinks
from tallyspark.sources.tables import attach_children, text_rows

PEOPLE = [{"id": i, "lastName": n, "firstName": "X", "team": t} for i, n, t in (("a", "Ari", "T1"), ("b", "Bo", "T1"), ("c", "Cy", "T2"), ("d", "Dee", "T2"), ("e", "Eve", None), ("f", "Fay", None))]
ENTRIES = [{"entryNo": 1, "playerIds": ["a", "b"], "type": "seed"}, {"entryNo": 2, "playerIds": ["c", "d"], "type": "packing"}, {"entryNo": 3, "playerIds": ["e", "f"], "type": "packing"}]
MATCHES = [
    {"matchId": "m1", "entries": [2, 3], "scores": {"2": 4, "3": 1}, "round": "semifinal", "winnerEntryNo": 2},
    {"matchId": "m2", "entries": [1, 2], "scores": {"1": 4, "2": 2}, "round": "final", "winnerEntryNo": 1, "prevMatchIds": ["m1"]},
    {"matchId": "m3", "entries": [1, 3], "scores": {"1": 1, "3": 0}, "round": "x", "winnerEntryNo": 1, "retired": True},
    {"matchId": "m4", "entries": [1, 1], "scores": {}, "round": "x"},
]
RESULTS = [{"entryNo": 1, "tournament": {"rank": {"kind": "winner"}}}, {"entryNo": 2, "tournament": {"rank": {"kind": "runnerup"}}}, {"entryNo": 2, "tournament": {"rank": {"kind": "winner"}}}, {"entryNo": 3, "tournament": {"rank": {"kind": "best", "bestLevel": 4}}}]


@pytest.fixture(scope="module")
def details(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("details")
    docs = {
        "cup/2023/doubles-none-boys": {"participants": PEOPLE, "entries": ENTRIES, "matches": MATCHES, "results": RESULTS},
        "cup/2024/doubles-none-boys": {"participants": PEOPLE, "entries": ENTRIES, "matches": MATCHES, "results": RESULTS},
        "cup/2024/singles-none-boys": {"matches": [{"matchId": "r", "entries": [1, 2], "stage": "roundrobin"}]},
        "cup/2024/team-none-boys": {"matches": [{"matchId": "r", "entries": [1, 2]}]},
        "cup/2024/mixed-none-mixed": {"entries": []},
        "cup/misc/ignored": {"matches": []},
    }
    for path, doc in docs.items():
        f = root / f"{path}.json"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(json.dumps(doc))
    (root / "cup/2024/broken-none-boys.json").write_text("{")
    return D.read_details(spark, str(root)).cache()


@pytest.fixture(scope="module")
def built(spark, details):
    index = T.player_index(spark.createDataFrame([(0, 7, "Ari", "X"), (1, 8, "Ari", "X"), (2, 9, "Ｂｏ", "X")], "position int, id int, lastName string, firstName string"))
    alias = spark.createDataFrame([("cup", 2024, "Cy", "X", 50, "T9")], "tournament string, year int, lastName string, firstName string, player int, team string")
    people = T.identified(D.participants(D.standard(details)), index, alias)
    meta = spark.createDataFrame([("cup", 2023, "2023-05-01", True, True)], "tournament string, year int, start string, is_major boolean, is_national boolean")
    return T.match_facts(details, people, meta).cache(), T.entry_facts(details, people, meta).cache(), people


def test_variants_and_quarantine(details):
    assert {(r["year"], r["category"]): r["variant"] for r in D.quarantined(details).collect()} == {(2024, "singles-none-boys"): "round_robin_only", (2024, "team-none-boys"): "matches_only", (2024, "mixed-none-mixed"): "mixed", (2024, "broken-none-boys"): "unknown"}
    assert D.standard(details).count() == 2


def test_ids_by_alias_then_first_name_listed(built):
    got = {(r["year"], r["lastName"]): (r["player"], r["team"]) for r in built[2].collect()}
    assert got[2023, "Ari"] == (7, "T1") and got[2023, "Bo"] == (9, "T1") and got[2023, "Cy"] == (None, "T2") and got[2024, "Cy"] == (50, "T9")


def test_match_facts(built):
    matches, _, _ = built
    x = matches.where("year = 2023 AND name = 'Ari X'").select("match", "result", "counts", "own", "against", "partner", "round_order", "tier").collect()
    assert sorted(tuple(r) for r in x) == [("m2", "win", True, 4, 2, "Bo X", 102, "major"), ("m3", "win", False, 1, 0, "Bo X", 0, "major")]
    assert matches.where("year = 2023").count() == 12
    assert {len(r[0]) for r in matches.select("opponents").collect()} == {2}
    assert {r[0] for r in matches.where("year = 2024").select("tier").collect()} == {"local"}


def test_entry_facts_take_the_first_result(built):
    x = {r["name"]: (r["placement"], r["reached_final"]) for r in built[1].where("year = 2023").collect()}
    assert x == {"Ari X": ("winner", True), "Bo X": ("winner", True), "Cy X": ("runnerup", True), "Dee X": ("runnerup", True), "Eve X": ("best4", False), "Fay X": ("best4", False)}


def test_every_section(built):
    out = statistics(built[0], built[1])
    assert set(out) == set(SECTIONS)
    for name, df in out.items():
        assert "person" in df.columns, name
        df.collect()
    career = {(r["person"], r["discipline"]): (r["wins"], r["losses"]) for r in out["career"].collect()}
    assert career["AriX@T1", "all"] == (2, 0) and career["CyX@T2", "doubles"] == (1, 1)
    assert {tuple(r) for r in out["title_streaks"].where("person = 'AriX@T1'").collect()} == {("AriX@T1", "cup", 2023, 2024, 2)}
    points = {(r["person"], r["year"]): (r["points"], r["rnk"]) for r in out["rankings"].collect()}
    assert points["AriX@T1", 2023] == (100.0, 1) and points["DeeX@T2", 2023] == (70.0, 3) and points["AriX@T1", 2024] == (20.0, 1)


def test_sections_for_one_person(built):
    out = statistics(built[0], built[1], ["by_year"], person="DeeX@T2")
    assert sorted((r["year"], r["wins"], r["losses"], r["entries"], r["best"]) for r in out["by_year"].collect()) == [(2023, 1, 1, 1, "runnerup"), (2024, 1, 1, 1, "runnerup")]


def test_bridge_and_latest_team(built):
    assert sorted(tuple(r) for r in T.reverse_index(built[0]).where("player = 7").collect()) == [(7, "cup/2023/doubles-none-boys"), (7, "cup/2024/doubles-none-boys")]
    assert dict(tuple(r) for r in T.latest_team(built[0]).collect())["AriX@T1"] == "T1"


def test_empty_facts(built):
    for name, df in statistics(built[0].limit(0), built[1].limit(0)).items():
        assert df.count() == 0, name


def test_sinks(spark, tmp_path):
    x = spark.createDataFrame([(i, f"n{i}", "t0") for i in range(7)], "id long, name string, generated_at string")
    sinks.write_buckets(x, "id", 3, str(tmp_path / "b"))
    assert sorted(p.name for p in (tmp_path / "b").glob("bucket=*")) == ["bucket=0", "bucket=1", "bucket=2"]
    later = x.withColumn("generated_at", F.lit("t1")).withColumn("name", F.when(F.col("id") == 4, "new").otherwise(F.col("name")))
    assert [r["id"] for r in sinks.changed(later, x, "id").collect()] == [4]
    assert [r["id"] for r in sinks.stale(x, x.where("id > 0"), "id").collect()] == [0]
    nested = x.select("id", F.struct("name", F.col("name").alias("_secret")).alias("s"), F.array(F.struct(F.col("id").alias("k"), F.lit(1).alias("_x"))).alias("a"))
    assert sinks.without_fields(nested, lambda n: n.startswith("_")).schema.simpleString() == "struct<id:bigint,s:struct<name:string>,a:array<struct<k:bigint>>>"
    assert json.loads(sinks.documents(x.where("id = 1"), "id").first()["document"])["name"] == "n1"


def test_lines_and_children(spark, tmp_path):
    (tmp_path / "l.txt").write_text("1 Ari\nnoise\n2 Bo\n")
    assert [tuple(r) for r in text_rows(spark, str(tmp_path / "l.txt"), r"^(\d+) (\w+)$", {"no": 1, "name": 2}).collect()] == [("1", "Ari"), ("2", "Bo")]
    g = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "match int, game int, v string")
    m = attach_children(spark.createDataFrame([(1,), (2,)], "match int"), g, "match", "game", "games")
    assert {r["match"]: r["games"] and [tuple(x) for x in r["games"]] for r in m.collect()} == {1: [(1, "x"), (2, "y")], 2: None}


def test_large_documents_come_in_parts(spark, small, monkeypatch):
    facts = lambda: [sorted(map(repr, x.drop("position").collect())) for x in mainpath.facts_of(spark, small)]
    monkeypatch.setattr(mainpath, "_BUILT", {})
    whole, streaks = facts(), sorted(map(tuple, mainpath.SECTIONS["streaks"](*mainpath.facts_of(spark, small)).collect()))
    mainpath._BUILT.clear()
    monkeypatch.setattr(mainpath, "PART", 5)
    read = mainpath.read_back(spark, small)
    documents = read.groupBy(*D.KEYS).agg(F.count("*").alias("parts"), F.max(F.size("matches")).alias("most"), F.sum(F.size("matches")).alias("matches"))
    # Ranges are drawn from samples, so a part is only about as large as asked for.
    assert documents.agg(F.max("parts")).first()[0] > 1 and documents.agg(F.max("most")).first()[0] <= 20 and documents.agg(F.sum("matches")).first()[0] == mainpath.orders(spark, small).count()
    ordered = D.matches(read).select(*D.KEYS, "position", F.col("match").cast("long").alias("k")).collect()
    by = lambda n: [(r["tournament"], r["year"], r["category"], r["k"]) for r in sorted(ordered, key=lambda r: (r["tournament"], r["year"], r["category"], r[n]))]
    assert by("position") == by("k")
    assert facts() == whole and sorted(map(tuple, mainpath.SECTIONS["streaks"](*mainpath.facts_of(spark, small)).collect())) == streaks
    assert D.quarantined(read).count() == D.quarantined(read).select(*D.KEYS).distinct().count()
