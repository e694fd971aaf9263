import pytest
from pyspark.sql import functions as F

from motley.sources import tables as T
from motley.streaming.incremental import upserted, windowed_counts

DATA = "/root/testdata/sf0.001"


def test_frames_round_trip(spark, tmp_path):
    frames = T.lineitem_frames(spark, DATA, gaps=True).limit(50).withColumn("labels", F.transform("labels", lambda x: F.coalesce(x, F.lit(-1)))).withColumnRenamed("labels", "assigned_labels")
    path = T.write_table(frames, str(tmp_path / "t"), ["sample_id"], "v1")
    back = T.read_frames(spark, path)
    assert back.count() == 50 and back.where(F.exists("labels", lambda x: x < 0)).count() == 0


def test_csv_header_version(spark, tmp_path):
    path = str(tmp_path / "c")
    T.append_csv(spark.range(3), path, 1)
    T.append_csv(spark.range(2), path, 1)
    assert T.read_csv(spark, path, "id long, schema_version int").count() == 5
    with pytest.raises(ValueError):
        T.append_csv(spark.range(2), path, 2)


def test_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"analysis_id": "x", "analysis_type": "js", "created_at": "2024-01-01"}\n{"analysis_id": "y", "analysis_type": "js", "created_at": "2024-02-01"}')
    got = T.read_records(spark, str(tmp_path), "analysis_id string, analysis_type string, created_at string", "js")
    assert [r["analysis_id"] for r in got.collect()] == ["y", "x"]


def test_missing_source(spark):
    with pytest.raises(ValueError):
        T.only_sources(T.table(spark, DATA, "events"), "event_type", ["nothing"])


def test_stream_counts_equal_batch(spark, tmp_path):
    events = T.table(spark, DATA, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, windowed_counts(events, "ts", "event_type").collect()))


def test_upsert(spark, tmp_path):
    old = spark.createDataFrame([("a", 1)], "k string, n long")
    old.write.parquet(str(tmp_path / "o"))
    assert sorted(map(tuple, upserted(spark.createDataFrame([("a", 2), ("b", 1)], "k string, n long"), str(tmp_path / "o"), ["k"]).collect())) == [("a", 3), ("b", 1)]
