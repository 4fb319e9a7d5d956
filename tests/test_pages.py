"""Page operators and name functions on hand-made rows."""

from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.operators import pages as G


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_names_and_teams(spark):
    x = spark.createDataFrame([("山田", "太郎"), ("Lee ", " Ann"), (None, "Bo"), ("Cy", ""), (None, None)], "l string, f string")
    assert [r[0] for r in x.select(T.join_name(F.col("l"), F.col("f"))).collect()] == ["山田太郎", "Lee Ann", "Bo", "Cy", ""]
    raw = ["__A_A_East_", "_A_Ea_East", "_East", "_A_B_B", "A_A", None, "_A_Ea"]
    got = spark.createDataFrame([(t,) for t in raw], "t string").select(T.recover_team(F.col("t"), {"East": "Ea"}).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [("A", "East"), ("A", "East"), ("East", None), ("A_B", None), ("A_A", None), (None, None), ("A_Ea", None)]
    y = spark.createDataFrame([("x" * 500 + "校高校",), ("ab高校",), ("高校",)], "t string").select(T.strip_suffixes(F.col("t"), ["高校", "校"]).alias("t"))
    assert [r[0] for r in y.collect()] == ["x" * 500, "ab", "高校"]


def test_clamped_dates_and_collation(spark):
    x = spark.createDataFrame([("2024-05-01",), ("2025-01-01",), (None,)], "d string").select(T.clamped(F.col("d"), F.lit("2024-12-31")))
    assert [r[0] for r in x.collect()] == ["2024-05-01", "2024-12-31", None]
    words = spark.createDataFrame([(w,) for w in ("ほん", "あき", "アキ", "B", "a")], "w string")
    assert [r[0] for r in words.orderBy(T.collated(F.col("w"))).collect()][:2] == ["a", "B"]


def test_packed_pages_keep_a_table_of_strings(spark):
    x = spark.createDataFrame([(1, 10, "a", None), (1, 11, "b", "a"), (2, 12, "b", "b"), (3, 13, None, None)], "page int, id int, s string, t string")
    packed = G.pack_strings(x, ["page"], ["s", "t"], ["id"])
    got = {r["page"]: (r["strings"], [tuple(y) for y in r["rows"]]) for r in packed.collect()}
    assert got[1][0] == ["a", "b"] and sorted(got[1][1]) == [(10, 0, None), (11, 1, 0)] and got[2] == (["b"], [(12, 0, 0)]) and got[3] == ([], [(13, None, None)])
    assert rows(G.unpack_strings(packed, ["page"], ["s", "t"], ["id"]), "page", "id", "s", "t") == rows(x, "page", "id", "s", "t")


def test_stories_merges_and_gates(spark):
    a = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"]), (3, ["y", "x", "x"])], "k int, m array<string>")
    b = spark.createDataFrame([(9, ["y", "x"])], "k int, m array<string>")
    assert rows(G.without_told(a, b, "m"), "k") == [(2,)]
    m = spark.createDataFrame([("c1", "s", "p", "e1"), ("c1", "s", "q", "e1"), ("c2", "s", "p", "e1"), ("c2", "t", "q", "e1"), ("c3", "s", "p", None)], "c string, s string, m string, e string")
    assert rows(G.mergeable(m, "c", "s", "m", "e"), "c") == [("c2",), ("c3",)]
    i = spark.createDataFrame([(1, "published", "d", ["p"]), (2, "draft", "d", ["p"]), (3, "published", None, ["p"]), (4, "published", "d", []), (5, "published", "d", None)], "k int, state string, verified_at string, paragraphs array<string>")
    assert rows(G.published(i), "k") == [(1,)]
    t = spark.createDataFrame([("f", 1, 0.5), ("f", 2, 0.9), ("f", 3, 0.9), ("g", 1, None)], "file string, attempt int, score double")
    assert rows(G.best_attempt(t, ["file"], "attempt", "score"), "file", "attempt") == [("f", 2), ("g", 1)]


def test_runs_cross_games_and_skip_undecided_points(spark):
    p = spark.createDataFrame([("m", 1, 1, "A"), ("m", 1, 2, "A"), ("m", 2, 1, None), ("m", 2, 2, "A"), ("m", 2, 3, "B"), ("n", 1, 1, "B"), ("n", 1, 2, "B"), ("n", 2, 1, "B"), ("o", 1, 1, "A")], "match string, game int, point int, w string")
    got = G.longest_runs_across(p, "match", ["game", "point"], "w").collect()
    assert sorted((r["match"], r["w"], r["length"], tuple(r["first"]), tuple(r["last"])) for r in got) == [("m", "A", 3, (1, 1), (2, 2)), ("n", "B", 3, (1, 1), (2, 1))]


def test_team_entries_count_once_for_each_member(spark):
    r = spark.createDataFrame([("e1", ["a", "b"], "winner"), ("e1", ["c"], "best8"), ("e2", ["a", "z"], "round")], "event string, players array<string>, result string")
    team = spark.createDataFrame([("T", "a"), ("T", "b"), ("U", "c")], "team string, member string")
    assert rows(G.team_summary(r, team, "event", "players", "result", "team", "member"), "team", "events", "champions", "runners_up", "top8", "entries") == [("T", 2, 2, 0, 2, 3), ("U", 1, 0, 0, 1, 1)]
    e = spark.createDataFrame([("g", 2024, 1, 3, "x"), ("g", 2024, 2, 1, "y"), ("g", 2024, 1, 3, "z"), ("g", 2024, 1, 3, "z"), ("g", 2023, 0, 0, "w")], "g string, year int, priority int, place int, team string")
    assert rows(G.top_teams(e, ["g"], "year", "priority", "place", "team"), "team") == [("x",), ("z",)]
