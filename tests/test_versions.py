"""Tables in versions: two writers, repeated batches, parts that no manifest names."""

import pytest

from motley.sources import tables as S
from motley.sources import versions as V
from motley.streaming.incremental import counted_into


def rows_of(spark, path, number=None):
    return sorted(map(tuple, V.read(spark, path, number).collect()), key=repr)


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def frame(spark, *rows):
    return spark.createDataFrame(rows, "k string, v int")


def test_versions_stay_as_they_are(spark, path):
    assert V.current(spark, path) == (0, [], [])
    with pytest.raises(ValueError):
        V.read(spark, path)
    V.append(frame(spark, ("a", 1)), path)
    V.append(frame(spark, ("b", 2), ("b", 2)), path)
    V.upsert(frame(spark, ("b", 3), (None, 4)), path, ["k"])
    V.upsert(frame(spark, (None, 5)), path, ["k"])
    assert rows_of(spark, path) == [("a", 1), ("b", 3), (None, 5)]
    assert rows_of(spark, path, 1) == [("a", 1)] and rows_of(spark, path, 2) == [("a", 1), ("b", 2), ("b", 2)]
    with pytest.raises(ValueError):
        V.read(spark, path, 9)


def test_a_writer_that_is_overtaken_is_refused(spark, path):
    base = V.append(frame(spark, ("a", 1)), path)
    V.upsert(frame(spark, ("a", 2)), path, ["k"], base)
    with pytest.raises(V.StaleVersion):
        V.upsert(frame(spark, ("a", 3)), path, ["k"], base)
    with pytest.raises(V.StaleVersion):  # overtaken between the look and the publication
        V._published(spark, path, base, ["part-x"], [])
    assert rows_of(spark, path) == [("a", 2)] and V.current(spark, path).number == 2


def test_an_overtaken_append_follows(spark, path, monkeypatch):
    V.append(frame(spark, ("a", 1)), path)
    written = V._written

    def slow(df, where):
        monkeypatch.setattr(V, "_written", written)
        V.append(frame(spark, ("b", 2)), path)  # another writer meanwhile
        return written(df, where)

    monkeypatch.setattr(V, "_written", slow)
    V.append(frame(spark, ("c", 3)), path)
    assert rows_of(spark, path) == [("a", 1), ("b", 2), ("c", 3)] and V.current(spark, path).number == 3


def test_a_batch_is_added_once(spark, path):
    for batch in ("x", "y", "x", "y"):
        V.append(frame(spark, (batch, 1)), path, batch)
    assert rows_of(spark, path) == [("x", 1), ("y", 1)]
    counts = path + "-counts"
    sink = counted_into(counts, ["k"])
    for number in (0, 1, 1, 0, 2):
        sink(frame(spark, ("a", number), ("b", number), ("a", 9)), number)
    assert rows_of(spark, counts) == [("a", 6), ("b", 3)]


def test_parts_without_a_manifest_are_not_read(spark, path):
    V.append(frame(spark, ("a", 1)), path)
    V._written(frame(spark, ("lost", 0)), path)
    V.upsert(frame(spark, ("a", 2)), path, ["k"])
    assert rows_of(spark, path) == [("a", 2)]
    assert len(V.removed_parts(spark, path)) == 2 and rows_of(spark, path) == [("a", 2)]
    V.append(frame(spark, ("b", 1)), path)
    assert rows_of(spark, path) == [("a", 2), ("b", 1)] and V.current(spark, path).number == 3


def test_many_parts_become_one(spark, path, monkeypatch):
    monkeypatch.setattr(V, "MOST_PARTS", 3)
    for i in range(5):
        V.append(frame(spark, ("a", i)), path, str(i))
    assert len(V.current(spark, path).parts) <= 3 and rows_of(spark, path) == [("a", i) for i in range(5)]


def test_a_stream_into_a_table(spark, path, tmp_path):
    events = S.table(spark, "/root/testdata/sf0.001", "events").select("event_type", "event_id")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(counted_into(path, ["event_type"])).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows_of(spark, path) == sorted(map(tuple, events.groupBy("event_type").count().collect()), key=repr)
