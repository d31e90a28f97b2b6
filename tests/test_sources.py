import datetime as dt

from pyspark.sql import functions as F

from lectern.operators import traces
from lectern.sources import files, snapshots
from lectern.streaming.traces import new_files, stream_to_daily, windowed_counts


def test_files_are_found_and_read(spark, tmp_path):
    folder = tmp_path / "docs" / "sub"
    folder.mkdir(parents=True)
    (folder / "a.MD".lower()).write_text("# Title\n\ntext", encoding="utf-8")
    (folder / "b.html").write_text("<h2>Head</h2><p>one &amp; two</p><script>var x = '</p>';</script><ul><li>item</ul>", encoding="utf-8")
    (folder / "c.pdf").write_bytes(b"%PDF")
    (folder / "d.bin").write_bytes(b"x")
    found = files.discover(spark, str(tmp_path / "docs"))
    assert {r["doc_type"] for r in found.collect()} == {"md", "html", "pdf"}
    parsed = {r["title"]: (r["markdown"], r["warning"]) for r in files.parse(found).collect()}
    assert parsed["a"] == ("# Title\n\ntext", None)
    assert "## Head" in parsed["b"][0] and "one & two" in parsed["b"][0] and "- item" in parsed["b"][0] and "var x" not in parsed["b"][0]
    assert parsed["c"] == (None, "no converter for pdf")
    assert {r["title"]: r["markdown"] for r in files.parse(found, lambda kind, content: f"{kind} {len(content)}").collect()}["c"] == "pdf 4"


def test_page_segments(spark):
    out = spark.createDataFrame([(331,), (20,), (0,), (None,)], "n int").select(files.page_segments(F.col("n")).alias("s")).collect()
    assert [len(r["s"]) if r["s"] is not None else None for r in out] == [9, 1, 0, 0]
    assert tuple(out[0]["s"][-1]) == (321, 331)


def test_snapshots_switch_as_a_whole(spark, tmp_path):
    root = str(tmp_path / "t")
    snapshots.write_snapshot(spark.range(3).toDF("x"), root)
    snapshots.write_snapshot(snapshots.read_snapshot(spark, root).where("x > 0"), root)
    assert {r["x"] for r in snapshots.read_snapshot(spark, root).collect()} == {1, 2}


EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _events(spark):
    at = lambda d, h, m=0: dt.datetime(2024, 5, d, h, m)
    return spark.createDataFrame([(1, at(1, 9), 1, "a", 1.0), (2, at(1, 9, 20), 1, "a", 2.0), (3, at(1, 11), 1, "b", 3.0), (4, at(2, 8), 2, "a", 4.0), (5, None, 2, "a", 5.0)], EVENT)


def test_traces(spark, tmp_path):
    events = _events(spark)
    assert [r["event_id"] for r in traces.tail(events, 5).collect()] == [4]
    assert {(r["user_id"], r["session"], r["events"]) for r in traces.sessions(events, "user_id", "ts", 30).collect()} == {(1, 0, 2), (1, 1, 1), (2, 0, 1)}
    path = str(tmp_path / "log")
    traces.append(events.where("ts is not null"), path)
    traces.append(events.where("event_id = 4"), path)
    assert traces.read(spark, path).count() == 5
    verdicts = spark.createDataFrame([("up", "x" * 2000), ("sideways", "y")], "verdict string, answer string")
    assert [(r["kind"], len(r["answer"])) for r in traces.feedback(verdicts).collect()] == [("feedback", 1000)]


def test_streams_agree_with_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    _events(spark).where("ts is not null").write.parquet(source)
    stream = spark.readStream.schema(EVENT).parquet(source)
    stream_to_daily(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert {r["day"].isoformat() if hasattr(r["day"], "isoformat") else r["day"] for r in spark.read.json(str(tmp_path / "out")).select("day").collect()} == {"2024-05-01", "2024-05-02"}
    query = windowed_counts(stream, late="0 seconds").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck2")).start()
    query.awaitTermination(120)
    batch = windowed_counts(spark.read.schema(EVENT).parquet(source))
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))


def test_new_files_stream(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.md").write_text("x")
    query = new_files(spark, str(tmp_path / "w")).select("path", "length").writeStream.format("memory").queryName("files").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    assert spark.table("files").count() == 1
