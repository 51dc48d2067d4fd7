"""The streaming extensions over a bounded source."""

from lodestrand.streaming.sessions import append_once, user_sessions


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    stream = user_sessions(spark.readStream.schema(events.schema).parquet(source), "30 minutes", late="3650 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("sessions_out").trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: (r["user_id"], r["start"], r["events"])
    assert sorted(map(key, spark.sql("SELECT * FROM sessions_out").collect())) == sorted(map(key, user_sessions(events).collect()))


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "out")
    run = append_once(["k"], path)
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    for batch in (a, b, b):
        run(batch, 0)
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]
