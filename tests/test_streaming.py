"""Streams over small files give what the batch gives."""

from pyspark.sql import functions as F

from tallyspark.streaming import events as E


def drain(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return stream.sparkSession.table(name)


def test_windowed_counts(spark, small, tmp_path):
    x = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    x.repartition(3).write.parquet(str(tmp_path / "e"))
    got = drain(E.windowed(E.event_stream(spark, str(tmp_path / "e")), "1 day", "60 days"), "windowed", "complete")
    want = x.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
    assert sorted(map(tuple, got.select("window_start", "event_type", "n").collect())) == sorted(map(tuple, want.collect()))


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1), (2, "2024-01-01 00:20:00", 1), (3, "2024-01-01 02:00:00", 1), (4, "2024-01-02 00:00:00", 2)]
    x = spark.createDataFrame([(i, t, u, "x", 1.0, "{}") for i, t, u in rows], "event_id long, t string, user_id long, event_type string, value double, props string")
    x.withColumn("ts", F.to_timestamp("t")).drop("t").coalesce(1).write.parquet(str(tmp_path / "e"))
    got = drain(E.sessions(E.event_stream(spark, str(tmp_path / "e"))), "sessions", "append")
    assert sorted((r["user_id"], r["n"]) for r in got.collect()) == [(1, 1), (1, 2)]


def test_scores_follow_the_points(spark, tmp_path):
    for b, part in enumerate(["ABB", "BAAAA"]):
        data = [(1, 1, b * 10 + i, w) for i, w in enumerate(part)]
        spark.createDataFrame(data, "match long, game long, point long, winner string").coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    s = spark.readStream.schema("match long, game long, point long, winner string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p"))
    got = drain(E.game_scores(s), "scores", "update")
    last = max((tuple(r) for r in got.collect()), key=lambda r: r[2] + r[3])
    assert last[2:4] == (5, 3)
