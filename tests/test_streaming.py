from pyspark.sql import functions as F

from quarrystone.streaming.refresh import VersionedTable, record_history, session_counts, watch, windowed_counts

SCHEMA = "file string, hash string, content string"


def test_watch_passes_only_changed_files(spark, tmp_path):
    src, seen = tmp_path / "in", []
    state = VersionedTable(spark, f"file://{tmp_path}/state", "file string, hash string")
    on_change = lambda df, n: seen.append((n, sorted(r["file"] for r in df.collect())))
    for rows in ([("a", "1", "x"), ("b", "1", "y")], [("a", "1", "x"), ("b", "2", "z"), ("c", "1", "w")]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        watch(spark.readStream.schema(SCHEMA).parquet(str(src)), state, on_change, str(tmp_path / "cp")).awaitTermination(60)
    assert [f for _, f in seen] == [["a", "b"], ["b", "c"]]
    assert {tuple(r) for r in state.read().collect()} == {("a", "1"), ("b", "2"), ("c", "1")}


def test_windows_batch_and_stream_agree(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    want = {(r["start"], r["event_type"], r["n"]) for r in windowed_counts(events, "ts", ["event_type"], "value").collect()}
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = windowed_counts(stream, "ts", ["event_type"], "value").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["start"], r["event_type"], r["n"]) for r in spark.table("w").collect()} == want


def test_sessions(spark):
    e = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:10:00"), ("u", "2024-01-01 02:00:00")], "k string, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["n"] for r in session_counts(e, "t", "k").collect()) == [1, 2]


def test_history_keeps_the_last_of_a_day(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/h", "day string, score int")
    for day, score in (("2024-01-01", 5), ("2024-01-01", 7), ("2024-01-02", 9), ("2024-01-03", 1)):
        record_history(t, spark.createDataFrame([(day, score)], "day string, score int"), keep=2)
    assert sorted(tuple(r) for r in t.read().collect()) == [("2024-01-02", 9), ("2024-01-03", 1)]
