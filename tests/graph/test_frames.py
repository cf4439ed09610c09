"""The frame store: commits, writers that die or meet, chains along bases, deletion, expiry; frames of events over two months."""

import datetime

import pytest
from graphlens.operators.fixpoint import new_folder
from graphlens.plans import queries, requests
from graphlens.sources import frames as frames_module
from graphlens.sources.frames import FrameStore
from pyspark.sql import functions as F


@pytest.fixture
def store(spark):
    return FrameStore(spark, new_folder(spark, "frames"), ["k"], "v", "k string, v long")


def rows(spark, values):
    return spark.createDataFrame(list(values.items()), "k string, v long")


def held(df):
    return {r.k: r.v for r in df.collect()}


def test_chains_along_bases_and_null_keys(spark, store):
    store.store("a", 1, "2024-01-01", rows(spark, {"x": 1, None: 5, "y": 2}))
    store.store("a", 2, "2024-01-02", rows(spark, {"x": 1, None: 6}), base_id=1)
    other = spark.createDataFrame([("b", 7, "delta", "a", 2)], "timeline_id string, graph_id long, frame_type string, base_timeline string, base_id long").withColumn("ts", F.lit("2024-01-05").cast("timestamp_ntz"))
    store.add(other, spark.createDataFrame([("b", 7, "add", "z", 9), ("b", 7, "remove", None, None)], "timeline_id string, graph_id long, op string, k string, v long"))
    assert held(store.fetch("a", 2)) == {"x": 1, None: 6} and held(store.fetch("b", 7)) == {"x": 1, "z": 9}
    assert store.data.where("graph_id = 2").count() == 2  # a null key is the same key
    assert store.latest("a") == 2 and held(store.fetch_latest("a")[1]) == {"x": 1, None: 6} and store.latest("c") is None
    with pytest.raises(ValueError, match="another version"):
        store.delete("a", 1)
    store.delete("b", 7)
    store.delete("a", 2)
    assert store.latest("a") == 1 and held(store.fetch("a", 1)) == {"x": 1, None: 5, "y": 2}
    store.delete("a")
    assert store.frames.count() == store.data.count() == 0


def test_errors_and_empty_frames(spark, store):
    store.store_error("a", 1, "2024-01-01", ["no network", "late"])
    assert store.errors("a", 1) == ["no network", "late"] and store.errors("a", 2) == []
    empty = spark.createDataFrame([("a", 2), ("a", 3)], "timeline_id string, graph_id long").withColumn("ts", F.lit("2024-01-02").cast("timestamp_ntz"))
    assert store.register_empty(empty) == 2 and store.register_empty(empty, overlap=True) == 0
    store.store_range("a", spark.createDataFrame([(1, "x", 1), (2, "x", 2)], "graph_id long, k string, v long"))
    assert held(store.fetch("a", 2)) == {"x": 2} and store.errors("a", 1) == []
    with pytest.raises(ValueError, match="not empty"):
        store.store_range("a", spark.createDataFrame([(2, "x", 1)], "graph_id long, k string, v long"))


def test_two_writers_of_one_frame(spark, store):
    other = FrameStore(spark, store.folder, ["k"], "v", "k string, v long")
    publish, met = store._publish, []

    def late(number, folders):
        if not met:
            met.append(other.store("a", 1, "2024-01-01", rows(spark, {"x": 2})))
        return publish(number, folders)

    store._publish = late
    with pytest.raises(ValueError, match="does not come after"):
        store.store("a", 1, "2024-01-01", rows(spark, {"x": 1}))
    assert held(store.fetch("a", 1)) == {"x": 2} and store.frames.count() == 1
    met.clear()
    other.store = lambda *args: FrameStore.store(other, "b", 1, "2024-01-01", args[3])
    store.store("a", 2, "2024-01-02", rows(spark, {"x": 3}))  # of different timelines both stay
    assert held(store.fetch("a", 2)) == {"x": 3} and held(store.fetch("b", 1)) == {"x": 2} and store.latest_commit()[0] == 3


def test_a_writer_that_dies(spark, store, monkeypatch):
    monkeypatch.setattr(frames_module, "PATIENCE", 0.2)
    store.store("a", 1, "2024-01-01", rows(spark, {"x": 1}))

    def dies(number, folders):
        raise KeyboardInterrupt

    other = FrameStore(spark, store.folder, ["k"], "v", "k string, v long")
    other._publish = dies
    with pytest.raises(KeyboardInterrupt):
        other.store("a", 2, "2024-01-02", rows(spark, {"x": 2}))
    assert store.latest("a") == 1 and store.data.count() == 1
    store._fs.create(store._path(f"{store.folder}/commits/{2:012d}"), False).close()  # begun and never ended
    store.store("a", 2, "2024-01-02", rows(spark, {"x": 3}))
    assert held(store.fetch("a", 2)) == {"x": 3} and store.clean(-1) >= 2 and held(store.fetch("a", 2)) == {"x": 3} and store.clean(-1) == 0


def test_expiry(spark, store):
    ends = {1: "2024-02-01", 2: "2024-02-01", 3: None, 4: "2024-02-01", 5: "2024-03-01", 6: "2024-02-01"}
    kinds = {1: "full", 2: "delta", 3: "delta", 4: "full", 5: "full", 6: "error"}
    table = spark.createDataFrame([("a", k, kinds[k], ends[k] and datetime.datetime.fromisoformat(ends[k]), datetime.datetime(2024, 1, k)) for k in ends], "timeline_id string, graph_id long, frame_type string, expires_at timestamp_ntz, ts timestamp_ntz")
    data = spark.createDataFrame([("a", 1, "full", "x", 1), ("a", 2, "change", "x", 2), ("a", 3, "add", "y", 3), ("a", 4, "full", "x", 4), ("a", 5, "full", "x", 5)], "timeline_id string, graph_id long, op string, k string, v long")
    store.add(table, data)
    assert store.expire("2024-02-15") == 2  # frames 1 and 2 make frame 3
    assert sorted(r[0] for r in store.frames.select("graph_id").collect()) == [1, 2, 3, 5] and held(store.fetch("a", 3)) == {"x": 2, "y": 3}
    assert store.data.where("graph_id = 4").isEmpty() and store.expire("2024-02-15") == 0


def test_frames_of_two_months(spark, tmp_path):
    stamps = [datetime.datetime(2024, 1, 5, 1), datetime.datetime(2024, 2, 5, 1), datetime.datetime(2024, 2, 6, 1), datetime.datetime(2025, 1, 5, 1)]
    events = spark.createDataFrame([(k, t, 1, "view", 1.0, "{}") for k, t in enumerate(stamps)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r.graph_id for r in queries._frames(spark, str(tmp_path)).collect()) == [5, 36, 37, 371]
    store = requests._store(spark, str(tmp_path), (5, 36))
    assert {r.user_id: r.n for r in store.fetch("events", 37).collect()} == {1: 1}


def test_timelines_and_bases(spark, store):
    store.create_timeline("a", {"ttl": 3})
    with pytest.raises(ValueError, match="already"):
        store.create_timeline("a", {})
    store.store("b", 4, "2024-01-01", rows(spark, {"x": 1}))
    store.store("b", 6, "2024-01-02", rows(spark, {"x": 2}))
    assert sorted((r.timeline_id, r.frames, r.first_id, r.last_id) for r in store.timelines().collect()) == [("a", 0, None, None), ("b", 2, 4, 6)]
    assert store.timeline_config("a") == {"ttl": 3} and store.timeline_config("b") == {}
    with pytest.raises(ValueError, match="no timeline"):
        store.timeline_config("c")
    lost = spark.createDataFrame([("b", 7, "delta", 5)], "timeline_id string, graph_id long, frame_type string, base_id long").withColumn("ts", F.lit("2024-01-05").cast("timestamp_ntz"))
    with pytest.raises(ValueError, match="no version"):
        store.add(lost)
    store.delete("a")
    assert [r.timeline_id for r in store.timelines().collect()] == ["b"]
