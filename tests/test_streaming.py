import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnlight.engine import Engine
from tarnlight.streaming.rollup import ContinuousQuery, ingest_stream, message_stream, rollup_stream, start_stream, topic_pattern
from tarnlight.sources import lineproto

UTC = dt.timezone.utc


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "hot"))


def query(**kw):
    text = "SELECT time_bucket(INTERVAL '10 minutes', time) AS time, host, count(*) AS n, sum(v) AS s FROM prod.cpu WHERE time >= '{start_time}' AND time < '{end_time}' GROUP BY 1, 2"
    return ContinuousQuery("q", "prod", "prod.cpu", "cpu_10m", kw.pop("query", text), kw.pop("interval", "10 minutes"), ["host"], **kw)


def test_windows_advance_and_reruns_change_nothing(engine):
    base = 1_700_000_000
    engine.write_lines(["\n".join(f"cpu,host=a v={i}i {base + i * 60}000000000" for i in range(60))], "prod")
    cq = query(last=dt.datetime.fromtimestamp(base - base % 600, UTC))
    now = dt.datetime.fromtimestamp(base + 3600, UTC)
    assert cq.run(engine, now=now, dry_run=True)["query"].count("2023-11-14T") == 2
    first = cq.run(engine, now=now)
    assert first["rows"] > 0 and cq.last == first["end"]
    rows = sorted(map(str, engine.sql("SELECT time, host, n, s FROM prod.cpu_10m").collect()))
    cq.run(engine, start=first["start"], end=first["end"])
    assert rows == sorted(map(str, engine.sql("SELECT time, host, n, s FROM prod.cpu_10m").collect()))
    assert cq.run(engine, now=now)["rows"] == 0


def test_saved_queries_go_on_after_a_restart(engine):
    base = 1_700_000_000
    engine.write_lines(["\n".join(f"cpu,host=a v={i}i {base + i * 60}000000000" for i in range(300))], "prod")
    at = lambda s: dt.datetime.fromtimestamp(base + s, UTC)
    cq = query(last=at(-base % 600 - 600))
    cq.save(engine)
    cq.run(engine, now=at(3600))
    again = ContinuousQuery.load(engine, "prod", "q")
    assert ContinuousQuery.names(engine, "prod") == ["q"] and again.last == cq.last and len(again.history) == 1
    again.run(engine, now=at(18_000))  # hours later: the gap is filled, too
    assert engine.sql("SELECT sum(n) AS n FROM prod.cpu_10m WHERE time < '2023-11-15 03:10:00'").collect()[0]["n"] >= 290
    from tarnlight.sources.catalog import Conflict

    with pytest.raises(Conflict):  # the first object does not know of the second run
        cq.run(engine, now=at(7200))
    assert engine.sql("SELECT count(*) AS n, count(DISTINCT time) AS k FROM prod.cpu_10m").collect()[0]["n"] == engine.sql("SELECT DISTINCT time FROM prod.cpu_10m").count()


def test_days_of_continuous_queries(engine):
    day, base = 86_400, 1_700_000_000
    engine.write_lines([f"cpu,host=a v=1i {base - 40 * day}000000000", f"cpu,host=a v=2i {base}000000000"], "prod")
    now = dt.datetime.fromtimestamp(base + 600, UTC)
    cq = query(last=now - dt.timedelta(days=60), retention_days=10, delete_source_after_days=30)
    cq.run(engine, now=now)
    assert [r["s"] for r in engine.sql("SELECT s FROM prod.cpu_10m").collect()] in ([2], [])
    assert [r["v"] for r in engine.sql("SELECT v FROM prod.cpu").collect()] == [2]
    with pytest.raises(ValueError):
        query(retention_days=0)


def test_output_without_time_is_stamped(engine):
    engine.write_lines(["cpu,host=a v=1i 1700000000000000000"], "prod")
    cq = query(query="SELECT host, count(*) AS n FROM prod.cpu WHERE time >= '{start_time}' AND time < '{end_time}' GROUP BY host")
    start = dt.datetime(2023, 11, 14, 22, tzinfo=UTC)
    cq.run(engine, start=start, end=start + dt.timedelta(hours=1))
    assert engine.sql("SELECT time FROM prod.cpu_10m").collect()[0]["time"] == start.replace(tzinfo=None)


@pytest.mark.parametrize("kw", [{"interval": "5 seconds"}, {"interval": "1 month"}, {"query": "SELECT 1"}])
def test_bad_definitions(kw):
    with pytest.raises(ValueError):
        query(**kw)


def test_stream_rollup(spark, engine, tmp_path):
    src = tmp_path / "in"
    rows = [(dt.datetime(2024, 1, 1, 0, m), "a" if m % 2 else "b", float(m)) for m in range(40)]
    spark.createDataFrame(rows, "time timestamp, host string, v double").write.parquet(str(src))
    for _ in range(2):
        stream = spark.readStream.schema("time timestamp, host string, v double").parquet(str(src))
        roll = rollup_stream(stream, "time", "10 minutes", ["host"], {"n": F.count("*"), "s": F.sum("v")})
        start_stream(engine, roll, "d", "roll", ["host"], str(tmp_path / f"cp{_}")).awaitTermination(120)
    got = engine.sql("SELECT count(*) AS k, sum(n) AS n, sum(s) AS s FROM d.roll").collect()[0]
    assert (got["k"], got["n"], got["s"]) == (8, 40, sum(range(40)))


def test_stream_ingest(spark, engine, tmp_path):
    src = tmp_path / "lines"
    src.mkdir()
    (src / "a.txt").write_text("cpu,host=a v=1i 1700000000000000000\ncpu,host=b v=2i 1700000000000000000\n")
    for _ in range(2):  # a restart from the checkpoint writes nothing twice
        stream = lineproto.parse_lines(spark.readStream.text(str(src)))
        ingest_stream(engine, stream, "d", str(tmp_path / "cp"), every=None).awaitTermination(120)
    assert engine.sql("SELECT sum(v) AS s FROM d.cpu").collect()[0]["s"] == 3


def test_a_repeated_batch_is_written_once(engine):
    pts = lineproto.parse_lines(engine.spark.createDataFrame([("cpu v=1i 1700000000000000000",)], "value string"))
    for number in (0, 0, 1):
        engine._write_points(pts, "d", ("stream", number))
    assert engine.count("d", "cpu") == 2


def test_sessions_of_many_files(spark, tmp_path, monkeypatch):
    from tarnlight.plans import services
    from tarnlight.streaming.rollup import session_stream

    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i * 37 % 1000), "x", i % 7, i, 1.0) for i in range(300)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, user_id long, event_id long, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(services, "STREAM_ROWS", 50)
    out = session_stream(services._stream(spark, str(tmp_path)), "time", "2 hours", ["user_id"], late="60 days")
    batches = []
    put = lambda batch, n: batches.append(batch.collect())
    done = out.writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(put).trigger(availableNow=True).start()
    done.awaitTermination(120)
    plan = done._jsq.explainInternal(False)
    aggregated = max(i for i, x in enumerate(plan.splitlines()) if "Aggregate" in x)
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning" in "\n".join(plan.splitlines()[aggregated:])
    assert sum(r["n"] for r in batches[0]) == 300 and len(batches) == 1


@pytest.mark.parametrize("filter_,topic,fits", [("a/+/c", "a/b/c", True), ("a/+/c", "a/b/d/c", False), ("a/#", "a", True), ("a/#", "a/b/c", True), ("#", "x/y", True), ("a.b", "aXb", False)])
def test_topic_filters(filter_, topic, fits):
    import re

    assert bool(re.match(topic_pattern(filter_), topic)) == fits


def test_message_stream(spark, engine, tmp_path):
    src = tmp_path / "in"
    rows = [("plant/a/temp", '{"m": "t", "v": 1, "timestamp": 1700000000}'), ("other", '{"v": 2}'), ("plant/b", "rubbish")]
    spark.createDataFrame(rows, "topic string, value string").write.parquet(str(src))
    stream = spark.readStream.schema("topic string, value string").parquet(str(src))
    message_stream(engine, stream, {"plant/#": "plant"}, str(tmp_path / "cp"), every=None).awaitTermination(120)
    assert [tuple(r) for r in engine.sql("SELECT v FROM plant.t").collect()] == [(1,)]
    assert [tuple(r) for r in engine.sql("SELECT v FROM default.mqtt").collect()] == [(2,)]
