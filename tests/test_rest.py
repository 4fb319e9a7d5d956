"""Small helpers that no registered query reaches: labels and weights, mining of single conditions, claims, sinks, JDBC and stream sinks."""

from pyspark.sql import functions as F

from tallyspark.functions import labels as L
from tallyspark.functions import numbers as N
from tallyspark.operators import joins as J
from tallyspark.operators import mining as M
from tallyspark.operators import points as P
from tallyspark.operators import texts as X
from tallyspark.sources import sinks
from tallyspark.sources.tables import database, table
from tallyspark.streaming import events as E


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_labels_and_standings(spark):
    x = spark.createDataFrame([("winner", 0), ("best8", 0), ("round", 3), ("odd", 0)], "k string, n int")
    assert [r[0] for r in x.select(L.placement_label(F.col("k"), F.col("n"))).collect()] == ["Winner", "Last 8", "Round 3", ""]
    y = spark.createDataFrame([(True, 102), (False, 102), (True, 101), (False, 101), (False, 100), (False, 3)], "w boolean, o int")
    assert [r[0] for r in y.select(L.standing_from_deepest(F.col("w"), F.col("o"))).collect()] == ["winner", "runnerup", "runnerup", "best4", "best8", "round"]


def test_shares_and_weights(spark):
    x = spark.createDataFrame([(1, 3), (1, 8), (0, 0)], "p int, n int")
    assert [r[0] for r in x.select(N.share_points(F.col("p"), F.col("n"))).collect()] == [33.3, 12.5, None]
    y = spark.createDataFrame([(1500.0,), (1900.0,), (1100.0,)], "r double").select(N.strength_weight(F.col("r")))
    assert [round(r[0], 9) for r in y.collect()] == [1.0, 10.0, 0.1]


def test_members_and_conditions(spark):
    x = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c")], "g int, m string")
    assert rows(J.members_of(x, ["g"], "m")) == [(1, ["a", "b"]), (2, ["c"])]
    y = spark.createDataFrame([("x", 1), ("x", 2), ("x", 1), ("y", None)], "f string, g int")
    assert rows(M.single_conditions(y, ["f", "g"], 1)) == [("f=y", 1, 4), ("g=2", 1, 3)]
    assert M.matching(y, {"f": "x", "g": 1}).count() == 2


def test_stored_scores_that_points_contradict(spark):
    p = spark.createDataFrame([(1, 1, "A"), (1, 1, "A"), (1, 1, "B"), (1, 2, "B")], "match int, game int, winner string")
    g = spark.createDataFrame([(1, 1, 2, 1), (1, 2, 1, 1)], "match int, game int, points_a int, points_b int")
    assert rows(P.score_conflicts(p, g)) == [(1, 2, 1, 1, 0, 1)]


def test_claims_carry_their_subject_and_are_verified(spark):
    s = spark.createDataFrame([(1, 1, "Ann won"), (1, 2, "she won again"), (1, 3, "Bob lost"), (2, 1, "nobody")], "k int, n int, t string")
    got = X.carry_subject(s, ["k"], "n", F.when(F.regexp_extract("t", "^(Ann|Bob)", 1) != "", F.regexp_extract("t", "^(Ann|Bob)", 1)))
    assert rows(got, "k", "n", "subject") == [(1, 1, "Ann"), (1, 2, "Ann"), (1, 3, "Bob"), (2, 1, None)]
    made = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4)], "k string, v int")
    assert rows(X.verify(made, spark.createDataFrame([("a", 2), ("b", 1)], "k string, v int"), ["k"], "v"), "k", "verdict") == [("a", "confirmed"), ("b", "contradicted"), ("c", "unknown")]


def test_boards_sitemap_and_outputs(spark, tmp_path):
    x = spark.createDataFrame([(2023, "boys", 1, "a"), (2023, "boys", 2, "b"), (2024, "boys", 1, "c")], "year int, gender string, place int, who string")
    path = str(tmp_path / "boards")
    sinks.write_boards(x, ["year", "gender"], ["place"], path)
    sinks.write_boards(x.where("year = 2024").withColumn("who", F.lit("d")), ["year", "gender"], ["place"], path)
    assert rows(spark.read.parquet(path), "year", "place", "who") == [(2023, 1, "a"), (2023, 2, "b"), (2024, 1, "d")]
    pages = spark.createDataFrame([("/b", 1), ("/a", 2), ("/b", 3), ("/c", 4)], "loc string, n int")
    assert [r["loc"] for r in sinks.sitemap(pages, spark.createDataFrame([("/c",)], "loc string")).collect()] == ["/a", "/b"]
    x.write.json(str(tmp_path / "json"))
    assert sinks.read_output(spark, str(tmp_path / "json"), "who string").count() == 3


def test_relational_tables_with_pushed_filters(spark):
    url = "jdbc:derby:memory:rest;create=true"
    spark.range(10).withColumn("name", F.concat(F.lit("n"), "id")).write.jdbc(url, "players", mode="overwrite")
    got = database(spark, url, {"players": "players"})["players"].where("id >= 7").select("name")
    assert rows(got) == [("n7",), ("n8",), ("n9",)]
    assert "id" in got._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def test_a_batch_merged_twice_counts_once(spark, small, tmp_path):
    table(spark, small, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartition(2).write.parquet(str(tmp_path / "in"))
    counted = {}

    def merge(batch, number):
        counted[number] = batch.count()

    q = E.each_batch(E.event_stream(spark, str(tmp_path / "in"), files_per_trigger=1), merge, str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    again = E.each_batch(E.event_stream(spark, str(tmp_path / "in"), files_per_trigger=1), merge, str(tmp_path / "state"))
    again.processAllAvailable()
    again.stop()
    assert len(counted) >= 2 and sum(counted.values()) == table(spark, small, "events").count()


