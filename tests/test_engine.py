import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tarnlight.engine import Engine
from tarnlight.operators import joins, maintain, series
from tarnlight.plans import dialect
from tarnlight.plans.validate import Rejected
from tarnlight.sources import messages

HOUR = 3_600_000_000


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "hot"), str(tmp_path / "cold"))


def lines(n, start=1_700_000_000, step=600, host="a"):
    return "\n".join(f"cpu,host={host} v={i}i,x={i}.5 {start + i * step}000000000" for i in range(n))


def test_write_scan_and_sql(engine):
    assert engine.write_lines([lines(30), "mem free=1i 1700000000000000000"], "prod") == {"cpu": 30, "mem": 1}
    assert engine.sql("SHOW DATABASES").collect()[0]["database"] == "prod"
    assert [r["table_name"] for r in engine.sql("SHOW TABLES FROM prod").collect()] == ["cpu", "mem"]
    assert engine.sql("SELECT count(*) AS n, max(v) AS top FROM prod.cpu").collect()[0].asDict() == {"n": 30, "top": 29}
    assert engine.sql("SELECT host FROM CPU WHERE v = 3", "prod").collect()[0]["host"] == "a"
    assert engine.sql("WITH c AS (SELECT * FROM prod.cpu) SELECT count(*) AS n FROM c, prod.mem m").collect()[0]["n"] == 30
    assert engine.sql("SELECT a.v FROM prod.cpu a JOIN prod.cpu AS b ON a.v = b.v + 1 ORDER BY a.v LIMIT 2").collect()[1]["v"] == 2
    assert engine.sql("SELECT * FROM prod.nothing").count() == 0
    assert engine.sql("SELECT v FROM prod.cpu", max_rows=3).count() == 3
    assert engine.count("prod", "cpu") == 30
    assert engine.estimate("SELECT * FROM prod.cpu") == {"estimated_rows": 30, "warning_level": "none"}
    rows = engine.measurement("prod", "cpu", where="v < 10", limit=2, offset=1).collect()
    assert [r["v"] for r in rows] == [8, 7]
    for bad in ("DROP TABLE prod.cpu", "SELECT * FROM parquet.`/etc`"):
        with pytest.raises(Rejected):
            engine.sql(bad)
    with pytest.raises(Rejected):
        engine.sql("SELECT * FROM prod.cpu", "prod")
    with pytest.raises(Rejected):
        engine.measurement("prod", "cpu", where="v = 1 UNION SELECT 1")


def test_union_by_name(engine):
    engine.write_lines(["a x=1i,y=2i 1\nb y=3i 2"], "d")
    rows = engine.sql("SELECT x, y FROM d.a UNION ALL BY NAME SELECT y FROM d.b").collect()
    assert sorted((r["y"], r["x"]) for r in rows) == [(2, 1), (3, None)]


def test_time_bounds_prune_files(engine):
    engine.write_lines([lines(48, step=3600)], "d")
    text = "SELECT count(*) AS n FROM d.cpu WHERE time >= '2023-11-15 00:00:00' AND time < '2023-11-15 06:00:00' AND v > 0"
    out = engine.sql(text)
    assert out.collect()[0]["n"] == 6
    files = len(out.inputFiles())
    assert 6 <= files <= 7 < len(engine.sql("SELECT * FROM d.cpu").inputFiles())
    assert engine.sql("SELECT count(*) AS n FROM d.cpu WHERE time >= '2023-11-15' OR v = 0").collect()[0]["n"] == 47


def test_schema_grows_and_widens(engine):
    engine.write_lines(["m v=1i 1000000000"], "d")
    engine.write_lines(['m v=2.5,s="x" 2000000000'], "d")
    assert [tuple(r) for r in engine.sql("SELECT v, s FROM d.m ORDER BY v").collect()] == [(1.0, None), (2.5, "x")]


def test_results(engine, spark):
    df = spark.sql("SELECT 1 AS a, double('NaN') AS b, timestamp'2024-01-01 00:00:00' AS t, 'x' AS s")
    assert json.loads(engine.to_json_rows(df).collect()[0]["value"]) == {"a": 1, "b": None, "t": "2024-01-01T00:00:00Z", "s": "x"}
    assert messages.unpack(engine.to_msgpack(df.select("a", "s")))["data"] == [[1], ["x"]]
    assert len(engine.to_ipc(df, "zstd")) > 0
    assert str(engine.to_arrow(spark.sql("SELECT 'x' AS s FROM range(50)"), dictionary=True).schema.field("s").type).startswith("dictionary")


def test_compaction_keeps_the_last_write(engine):
    for i in range(12):
        engine.write_lines([f"cpu,host=a v={i}i 1700000000000000000\ncpu,host=b v={100 + i}i {1700000000 + i}000000000"], "d")
    before = engine.compaction_candidates("d", "cpu")
    assert len(before) == 1 and len(before[0]["files"]) == 12
    report = engine.compact("d", "cpu")[0]
    assert report["rows_before"] == 24 and report["rows_after"] == 13 and report["files_after"] < 12
    rows = engine.sql("SELECT host, v FROM d.cpu").collect()
    assert [r["v"] for r in rows if r["host"] == "a"] == [11] and sum(r["host"] == "b" for r in rows) == 12
    assert engine.compaction_candidates("d", "cpu") == []
    assert set(engine.catalog.files.sizes(engine.catalog.path("d", "cpu"))) >= {p if p.startswith("file:") else p for p in engine.catalog.manifest("d", "cpu")["files"]}


def test_all_hours_are_compacted_by_one_commit(engine):
    for i in range(10):
        engine.write_lines(["\n".join(f"cpu,host=a v={10 * h + i}i {1_700_000_000 + 3600 * h}000000000\ncpu,host=b{i} v=0i {1_700_000_000 + 3600 * h}000000000" for h in range(4))], "d")
    assert engine.compact("d", "cpu") == [{"files_before": 10, "files_after": 1, "rows_before": 20, "rows_after": 11}] * 4
    known = engine.catalog.manifest("d", "cpu")
    assert known["version"] == 11 and {f["seq"] for f in known["files"].values()} == {10}
    assert sorted(r["v"] for r in engine.sql("SELECT v FROM d.cpu WHERE host = 'a'").collect()) == [9, 19, 29, 39]


def test_compaction_normalises_time(spark):
    df = spark.createDataFrame([("1700000000000000",), ("2023-11-14 22:13:20",)], "time string")
    assert {r["time"] for r in maintain.normalised_time(df).collect()} == {dt.datetime(2023, 11, 14, 22, 13, 20)}


def test_retention_removes_whole_old_files(engine):
    engine.write_lines(["m v=1i 1577836800000000000", "m v=2i 1700000000000000000"], "d")
    now = 1_700_000_100_000_000
    assert engine.retention("d", 30, now=now, dry_run=True)["m"]["rows"] == 1
    assert engine.count("d", "m") == 2
    engine.retention("d", 30, now=now)
    assert [r["v"] for r in engine.sql("SELECT v FROM d.m").collect()] == [2]


def test_delete_spares_nulls(engine):
    engine.write_lines(['m v=1i,s="a" 1000000000\nm v=2i 2000000000\nm v=3i,s="b" 3000000000'], "d")
    assert engine.delete_where("d", "m", "s = 'a'", dry_run=True) == {"rows": 1, "files": 1, "dry_run": True}
    engine.delete_where("d", "m", "s = 'a'")
    assert sorted(r["v"] for r in engine.sql("SELECT v FROM d.m").collect()) == [2, 3]
    with pytest.raises(ValueError):
        engine.delete_where("d", "m", "1 = 1")
    engine.delete_where("d", "m", "1 = 1", confirm=True)
    assert engine.sql("SELECT * FROM d.m").count() == 0


def test_a_confirmed_delete_takes_any_number_of_rows(engine, spark):
    n = maintain.MOST_ROWS + 10
    rows = spark.range(n).select(F.timestamp_seconds(F.lit(1_700_000_000)).alias("time"), F.col("id").alias("v"))
    engine.write_df(rows, "d", "m", tags=[])
    for bounds in ({}, {"confirm": True, "most_rows": n - 6}):
        with pytest.raises(ValueError, match="limit"):
            engine.delete_where("d", "m", "v >= 5", **bounds)
    assert engine.delete_where("d", "m", "v >= 5", confirm=True)["rows"] == n - 5
    assert sorted(r["v"] for r in engine.sql("SELECT v FROM d.m").collect()) == [0, 1, 2, 3, 4]


def test_tiers_and_snapshots(engine, tmp_path):
    engine.write_lines([lines(20, step=3600)], "d")
    files = list(engine.catalog.manifest("d", "cpu")["files"])
    maintain.compact(engine.catalog, "d", "cpu", files, "daily")
    assert maintain.migrate(engine.catalog, "d", "cpu", 30) >= 1
    assert {f["tier"] for f in engine.catalog.manifest("d", "cpu")["files"].values()} == {"cold"}
    assert engine.sql("SELECT count(*) AS n FROM d.cpu").collect()[0]["n"] == 20
    assert maintain.snapshot(engine.catalog, "d", str(tmp_path / "snap"))["rows"] == 20
    engine.catalog.drop_database("d")
    assert engine.catalog.databases() == []
    maintain.restore(engine.catalog, str(tmp_path / "snap"), "d")
    assert engine.sql("SELECT count(*) AS n FROM d.cpu").collect()[0]["n"] == 20


def test_names_are_checked(engine):
    for bad in ("1a", "a/b", "..", "a" * 65, ""):
        with pytest.raises(ValueError):
            engine.catalog.create_database(bad)


def test_asof(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 3), (None, 4)], "k string, s int").selectExpr("k", "timestamp_seconds(s) AS t", "s")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("b", 7, 70)], "k string, s int, v int").selectExpr("k", "timestamp_seconds(s) AS t", "v")
    got = lambda **kw: {(r["k"], r["s"]): r["v"] for r in joins.asof_join(left, right, ["k"], "t", "t", **kw).collect()}
    assert got() == {("a", 1): None, ("a", 5): 50, ("a", 9): 50, ("b", 3): None, (None, 4): None}
    assert got(exact=False)[("a", 5)] == 20
    assert got(direction="forward") == {("a", 1): 20, ("a", 5): 50, ("a", 9): None, ("b", 3): 70, (None, 4): None}
    assert got(how="inner") == {("a", 5): 50, ("a", 9): 50}
    assert got(tolerance_us=3_000_000)[("a", 9)] is None


@pytest.mark.parametrize("kw", [{}, {"exact": False}, {"direction": "forward"}, {"direction": "forward", "exact": False}, {"tie": "v"}])
def test_asof_in_pieces(spark, kw):
    rng = random.Random(7)
    rows = lambda n: [(rng.choice(["a", "a", "b", None]), rng.randint(-500, 500), i) for i in range(n)]
    kw = {"tie": "v"} | kw
    left, right = (spark.createDataFrame(rows(n), f"k string, s int, {c} int").selectExpr("k", "timestamp_seconds(s) AS t", c) for n, c in ((200, "i"), (60, "v")))
    got = [sorted(map(str, joins.asof_join(left, right, ["k"], "t", "t", split=s, **kw).select("k", "t", "i", "v").collect())) for s in (None, "1 minute", "1 hour")]
    assert got[0] == got[1] == got[2]


def test_positional_and_range_join(spark):
    a, b = spark.range(7).select("id"), spark.range(100, 104).withColumnRenamed("id", "x")
    rows = joins.positional_join(a, b, ["id"], ["x"]).collect()
    assert sorted((r["id"], r["x"]) for r in rows if r["x"]) == [(0, 100), (1, 101), (2, 102), (3, 103)] and len(rows) == 7
    pts = spark.createDataFrame([(float(i),) for i in range(20)], "p double")
    spans = spark.createDataFrame([(0.5, 3.0), (2.0, 2.0), (10.0, 18.5)], "lo double, hi double")
    got = sorted((r["p"], r["lo"]) for r in joins.range_join(pts, spans, "p", "lo", "hi", 4.0).collect())
    assert got == [(p, lo) for p in map(float, range(20)) for lo, hi in [(0.5, 3.0), (10.0, 18.5)] if lo <= p < hi]


def test_a_large_range_join_is_written_in_few_bits(spark, tmp_path):
    pts = spark.range(4000).selectExpr("id * 7919 % 4000 AS i", "id * 7919 % 4000 / 512.0D AS p")
    spans = spark.range(4000).selectExpr("id * 6101 % 4000 AS j", "id * 6101 % 4000 / 512.0D AS lo", "(id * 6101 % 4000 + 800) / 512.0D AS hi")
    out = joins.range_join(pts, spans, "p", "lo", "hi", 0.5)
    assert out.columns == ["i", "p", "j", "lo", "hi"]
    out.select("i", "j").write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    n = sum(min(800, 4000 - j) for j in range(4000))
    assert (got.count(), got.distinct().count(), got.filter("i < j OR i >= j + 800").count()) == (n, n, 0)
    assert 8 * sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 4 * n


def test_series(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("a", 2, 8), ("a", 4, 1), ("b", 1, 1)], "k string, o int, v int")
    got = [r["g"] for r in series.groups_frame(df, ["k"], "o", "v", 1, "g").orderBy("k", "o", "v").collect()]
    assert got == [5, 20, 20, 16, 1]
    assert {r["v"] for r in series.latest(df, ["k"], "o", "v").collect()} == {1}


def test_frames_in_time_are_merged_from_two_running_ones(engine, spark):
    rng = random.Random(5)
    value = lambda: rng.choice([None, *range(-8, 9)])
    rows = [(i, rng.choice(["a", "b", None]), None if i % 50 == 0 else rng.randint(-400, 400), value()) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, k string, s int, v int").selectExpr("i", "k", "timestamp_seconds(s) AS t", "v / 4.0D AS v", "bigint(v) AS n")
    df.createOrReplaceTempView("frames")
    over = "OVER (PARTITION BY k ORDER BY t RANGE BETWEEN INTERVAL 1 MINUTE PRECEDING AND CURRENT ROW)"
    hows = {"avg": "v", "sum": "n", "count": "v", "min": "v", "max": "n"}
    text = f"SELECT i, {', '.join(f'{how}(e.{c}) {over} AS x_{how}' for how, c in hows.items())} FROM frames e"
    want = sorted(map(tuple, spark.sql(text).collect()))
    assert "INTERVAL" not in dialect.translate(text + " WHERE i >= 0 QUALIFY i < 900")
    for q in (text, text + " WHERE i >= 0 QUALIFY i < 900"):
        assert sorted(map(tuple, engine.sql(q).collect())) == want
    out = series.rolling(df, ["k"], "t", "1 minute", **{f"x_{how}": (how, c) for how, c in hows.items()})
    assert sorted(map(tuple, out.drop("k", "t", "v", "n").collect())) == want
    everywhere = f"SELECT i, sum(n) {over.replace('PARTITION BY k ', '')} AS s FROM frames"
    assert sorted(map(tuple, engine.sql(everywhere).collect())) == sorted(map(tuple, spark.sql(everywhere).collect()))
    for plain in (text.replace("ORDER BY t", "ORDER BY t DESC"), text.replace("1 MINUTE", "1 MONTH"), text + " JOIN frames f ON f.i = e.i", text.replace("SELECT i", "SELECT e.*")):
        assert "INTERVAL" in dialect.translate(plain)


def test_asof_and_positional_text(engine):
    engine.write_lines(["\n".join(f"a,k=x v={i}i {i * 10}000000000" for i in range(1, 4)), "b,k=x w=1i 5000000000\nb,k=x w=2i 20000000000\nb,k=y w=3i 1000000000"], "d")
    text = "SELECT a.v, b.w FROM d.a ASOF {} JOIN d.b ON a.k = b.k AND a.time {} b.time ORDER BY a.v"
    got = lambda how, op: [tuple(r) for r in engine.sql(text.format(how, op)).collect()]
    assert got("LEFT", ">=") == [(1, 1), (2, 2), (3, 2)]
    assert got("", ">") == [(1, 1), (2, 1), (3, 2)]
    assert got("LEFT", "<=") == [(1, 2), (2, 2), (3, None)]
    assert engine.sql("SELECT v, w FROM d.a x ASOF JOIN d.b AS y USING (k, time) WHERE w = 2").count() == 2
    assert len(engine.sql("SELECT * FROM d.a POSITIONAL JOIN d.b").collect()) == 3


def test_concurrent_writers_lose_nothing(engine):
    import threading

    failed = []

    def put(i):
        try:
            engine.write_lines([f"m,host=h{i} v={i}i 17000000000000000{i:02d}"], "d")
        except Exception as e:  # told below
            failed.append(e)

    threads = [threading.Thread(target=put, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and engine.count("d", "m") == 8 == engine.sql("SELECT v FROM d.m").count()
    assert engine.catalog.manifest("d", "m")["version"] == 8


def test_replaced_twice_is_a_conflict(engine):
    from tarnlight.sources.catalog import Conflict

    engine.write_lines(["m v=1i 1"], "d")
    files = list(engine.catalog.manifest("d", "m")["files"])
    old = engine.sql("SELECT v FROM d.m")
    engine.catalog.commit("d", "m", remove=files)
    with pytest.raises(Conflict):
        engine.catalog.commit("d", "m", remove=files)
    assert [r["v"] for r in old.collect()] == [1]  # a reader keeps its files until their grace time is over
    assert engine.sql("SELECT v FROM d.m").columns == ["v"] and engine.sql("SELECT v FROM d.m").count() == 0
    assert engine.catalog.vacuum("d", "m", grace=-1) == 1 and not engine.catalog.files.exists(files[0])


def test_checkpoints_of_the_log(engine, monkeypatch):
    from tarnlight.sources import catalog

    monkeypatch.setattr(catalog, "CHECKPOINT", 3)
    engine.write_lines(["m v=1i 1"], "d")
    for i in range(10):
        engine.catalog.commit("d", "m", {f"x/batch=1/f{i}": {"rows": 1, "min": i, "max": i, "bytes": 1, "level": "hour", "tier": "hot", "seq": 0, "made": 0}})
    fresh = Engine(engine.spark, engine.catalog.root).catalog
    assert fresh.manifest("d", "m")["version"] == 11 and fresh.row_count("d", "m") == 11
    assert len(fresh.files.names(f"{fresh.path('d', 'm')}/_commits", False)) < 12


def test_a_late_write_outlives_compaction(engine):
    for i in range(3):
        engine.write_lines([f"cpu,host=a v={i}i 1700000000000000000"], "d")
    files = list(engine.catalog.manifest("d", "cpu")["files"])
    engine.write_lines(["cpu,host=a v=9i 1700000000000000000"], "d")
    maintain.compact(engine.catalog, "d", "cpu", files)
    maintain.compact(engine.catalog, "d", "cpu", list(engine.catalog.manifest("d", "cpu")["files"]))
    assert [r["v"] for r in engine.sql("SELECT v FROM d.cpu").collect()] == [9]


def test_kinds_that_differ_become_text(engine):
    engine.write_lines(["m v=1.5 1"], "d")
    engine.write_lines(['m v="x" 2'], "d")
    assert sorted(r["v"] for r in engine.sql("SELECT v FROM d.m").collect()) == ["1.5", "x"]


def test_predicates_are_gated(engine):
    engine.write_lines(["m v=1i 1"], "d")
    for bad in ("reflect('java.lang.System', 'getProperty', 'user.home') = 'x'", "v IN (SELECT 1)"):
        with pytest.raises(Rejected):
            engine.delete_where("d", "m", bad)


def test_explain_and_describe(engine):
    engine.write_lines([lines(3)], "d")
    assert "Scan parquet" in engine.sql("EXPLAIN SELECT v FROM d.cpu WHERE v > 1").collect()[0]["plan"]
    assert "Optimized Logical Plan" in engine.sql("EXPLAIN EXTENDED SELECT v FROM cpu", "d").collect()[0]["plan"]
    assert ("v", "bigint") in [tuple(r) for r in engine.sql("DESCRIBE d.cpu").collect()]
    for bad in ("EXPLAIN DROP TABLE d.cpu", "EXPLAIN SELECT * FROM parquet.`/x`", "DESCRIBE d.nothing"):
        with pytest.raises(Rejected):
            engine.sql(bad)


def test_counts_come_from_the_log(engine):
    engine.write_lines([lines(48, step=1800)], "d")
    plan = engine.sql("SELECT count(*) AS n FROM d.cpu")
    assert plan.collect()[0]["n"] == 48 and plan.inputFiles() == []
    want = {r["h"]: r["n"] for r in engine.sql("SELECT epoch(date_trunc('hour', time))::BIGINT * 1000000 AS h, count(*) AS n FROM d.cpu GROUP BY 1").collect()}
    assert engine.catalog.bucket_counts("d", "cpu", HOUR) == want
    assert sum(engine.catalog.bucket_counts("d", "cpu", HOUR // 4).values()) == 48
