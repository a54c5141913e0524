import datetime

from modelloom.streaming import labels


def test_latest_follows_the_log(spark, tmp_path):
    at = str(tmp_path / "log")
    schema = "entity string, seq long, value string, ts timestamp"
    t = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("a", 1, "x", t), ("b", 2, "y", t), ("a", 3, "z", t)], schema).coalesce(1).write.mode("append").parquet(at)
    q = labels.latest(labels.log_stream(spark, at, schema), "entity", ["seq"]).writeStream.outputMode("complete").format("memory").queryName("latest_labels_test").start()
    try:
        q.processAllAvailable()
        assert {(r.entity, r.value) for r in spark.table("latest_labels_test").collect()} == {("a", "z"), ("b", "y")}
        spark.createDataFrame([("b", 9, "w", t), ("a", 2, "old", t)], schema).coalesce(1).write.mode("append").parquet(at)
        q.processAllAvailable()
        assert {(r.entity, r.value) for r in spark.table("latest_labels_test").collect()} == {("a", "z"), ("b", "w")}
    finally:
        q.stop()


def test_windows_close(spark, tmp_path):
    at = str(tmp_path / "log")
    schema = "ts timestamp_ntz, label string"
    t = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(t, "a"), (t, "a"), (t + datetime.timedelta(hours=3), "b")], schema).coalesce(1).write.parquet(at)
    q = labels.windowed_drift(labels.log_stream(spark, at, schema), "ts", "label").writeStream.outputMode("append").format("memory").queryName("drift_test").start()
    try:
        q.processAllAvailable()
        assert [(r.label, r.n) for r in spark.table("drift_test").collect()] == [("a", 2)]
    finally:
        q.stop()
