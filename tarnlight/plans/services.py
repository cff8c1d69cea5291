"""Queries that go through the service itself: files are written, kept healthy and read back.

Each takes whole tables, works in a store of its own in the shared folder, and has SQL
that says what must come out.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlight.engine import Engine
from tarnlight.operators import maintain, series
from tarnlight.plans.catalogue import query, table
from tarnlight.session import work_folder
from tarnlight.sources import imports, lineproto, messages, points
from tarnlight.streaming import rollup

_UTC = dt.timezone.utc
_DAY = 86_400_000_000


def store(spark: SparkSession) -> Engine:
    """An engine on a new, empty store with a cold tier."""
    root = work_folder(spark, "store")
    return Engine(spark, f"{root}/hot", f"{root}/cold")


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("time"), "event_type", F.col("user_id").cast("string").alias("user_id"), "event_id", "value")


def with_events(spark: SparkSession, sf_dir: str) -> Engine:
    """A store whose measurement prod.ev holds the events, one partition a day."""
    engine = store(spark)
    engine.write_df(events_of(spark, sf_dir), "prod", "ev", tags=["event_type", "user_id"], level="day")
    return engine


def plain_time(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names or ("time",)})


_EVENTS = "SELECT ts AS time, event_type, CAST(user_id AS VARCHAR) AS user_id, event_id, value FROM events"


# scans
@query(_EVENTS)
def svc_scan(spark, sf_dir):
    """A measurement written and read back by its qualified name."""
    return plain_time(with_events(spark, sf_dir).sql("SELECT time, event_type, user_id, event_id, value FROM prod.ev"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS a FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13' GROUP BY event_type")
def svc_scan_pruned(spark, sf_dir):
    """Time bounds of the text leave files of other days unopened."""
    engine = with_events(spark, sf_dir)
    out = engine.sql("SELECT event_type, count(*) AS n, round(avg(value), 6) AS a FROM ev WHERE time >= '2024-01-10' AND time < '2024-01-13' GROUP BY event_type", "prod")
    opened, held = len(out.inputFiles()), len(engine.catalog.manifest("prod", "ev")["files"])
    if opened > 4 or held < 20:
        raise AssertionError(f"{opened} of {held} files opened")
    return out


@query("SELECT 'prod' AS database, 'hot' AS tier UNION ALL SELECT 'world', 'hot'")
def svc_show_databases(spark, sf_dir):
    engine = with_events(spark, sf_dir)
    engine.catalog.create_database("world")
    return engine.sql("SHOW DATABASES")


@query("SELECT 'prod' AS database, 'ev' AS table_name, count(DISTINCT CAST(ts AS DATE)) AS file_count FROM events")
def svc_show_tables(spark, sf_dir):
    return with_events(spark, sf_dir).sql("SHOW TABLES FROM prod").select("database", "table_name", "file_count")


@query("SELECT c_custkey, CAST(NULL AS VARCHAR) AS note FROM customer")
def svc_never_written(spark, sf_dir):
    """A join with a measurement that never was written keeps the other side's rows."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return store(spark).sql("SELECT c.c_custkey, n.note FROM customer c LEFT JOIN prod.notes n ON c.c_custkey = n.k")


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def svc_two_databases(spark, sf_dir):
    engine = store(spark)
    for database, name in (("geo", "nation"), ("world", "region")):
        engine.write_df(table(spark, sf_dir, name).withColumn("time", F.lit("2024-01-01").cast("timestamp")), database, name)
    return engine.sql("SELECT r.r_name, count(*) AS n FROM geo.nation n JOIN world.region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")


@query("SELECT event_id, value FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 40 OFFSET 10")
def svc_measurement(spark, sf_dir):
    """The measurement end point: condition, order, limit and offset."""
    return with_events(spark, sf_dir).measurement("prod", "ev", where="event_type = 'click'", order_by="event_id DESC", limit=40, offset=10).select("event_id", "value")


@query("SELECT count(*) AS estimated_rows, CASE WHEN count(*) > 1000000 THEN 'high' WHEN count(*) > 100000 THEN 'medium' WHEN count(*) > 10000 THEN 'low' ELSE 'none' END AS warning_level FROM lineitem WHERE l_quantity > 10")
def svc_estimate(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    got = store(spark).estimate("SELECT * FROM lineitem WHERE l_quantity > 10")
    return spark.createDataFrame([(got["estimated_rows"], got["warning_level"])], "estimated_rows long, warning_level string")


@query("SELECT count(*) AS n FROM events")
def svc_count(spark, sf_dir):
    """A bare count comes from the log: no file is opened."""
    out = with_events(spark, sf_dir).sql("SELECT COUNT(*) AS n FROM prod.ev")
    if out.inputFiles():
        raise AssertionError("files were opened")
    return out


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n FROM events GROUP BY 1")
def svc_bucket_counts(spark, sf_dir):
    """Rows per day from the log alone."""
    counts = with_events(spark, sf_dir).catalog.bucket_counts("prod", "ev", _DAY)
    return spark.createDataFrame(list(counts.items()), "at long, n long").select(F.timestamp_micros("at").cast("timestamp_ntz").alias("day"), "n")


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 123")
def svc_row_cap(spark, sf_dir):
    return with_events(spark, sf_dir).sql("SELECT event_id FROM prod.ev ORDER BY event_id", max_rows=123)


# writing
@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1")
def svc_hour_partitions(spark, sf_dir):
    """Rows and time range of each hour's files, from their footers."""
    engine = store(spark)
    known = engine.write_df(events_of(spark, sf_dir), "prod", "ev", tags=["event_type"])
    files = spark.createDataFrame([(f["min"] // 3_600_000_000 * 3_600_000_000, f["rows"], f["min"], f["max"]) for f in known["files"].values()], "hour long, n long, lo long, hi long")
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return files.groupBy("hour").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(at("hour").alias("hour"), "n", at("lo").alias("lo"), at("hi").alias("hi"))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS out_of_order FROM events")
def svc_sorted_write(spark, sf_dir):
    """Within each file rows are in the order of the sort columns and time."""
    engine = store(spark)
    known = engine.write_df(events_of(spark, sf_dir), "prod", "ev", sort=("event_type",), level="day")
    df = engine.catalog.read(sorted(known["files"]), (F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")))
    before = F.lag(F.struct("event_type", "time")).over(Window.partitionBy("f").orderBy("i"))
    return df.select((F.struct("event_type", "time") < before).alias("bad")).agg(F.count("*").alias("n"), F.count_if("bad").alias("out_of_order"))


@query("SELECT ts AS time, event_id, CASE WHEN event_id % 2 = 0 THEN value END AS value, CASE WHEN event_id % 2 = 1 THEN event_type END AS event_type FROM events")
def svc_schema_growth(spark, sf_dir):
    """Two batches with different columns are one measurement."""
    engine, e = store(spark), events_of(spark, sf_dir)
    engine.write_df(e.filter("event_id % 2 = 0").select("time", "event_id", "value"), "prod", "ev", level="day")
    engine.write_df(e.filter("event_id % 2 = 1").select("time", "event_id", "event_type"), "prod", "ev", level="day")
    return plain_time(engine.sql("SELECT time, event_id, value, event_type FROM prod.ev"))


# imports
@query("SELECT TIMESTAMP '2024-01-01' AS time, s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
def svc_csv_import(spark, sf_dir):
    engine, at = store(spark), work_folder(spark, "csv")
    table(spark, sf_dir, "supplier").select(F.lit("1704067200").alias("when"), "*").write.option("header", True).csv(at)
    engine.import_csv(at, "prod", "supplier", time_col="when")
    return plain_time(engine.sql("SELECT time, s_suppkey, s_name, s_nationkey, s_acctbal FROM prod.supplier"))


@query("SELECT o_orderdate AS time, o_orderkey, o_totalprice, o_orderpriority FROM orders")
def svc_parquet_import(spark, sf_dir):
    engine, at = store(spark), work_folder(spark, "parquet")
    # one instant a month keeps the hours few; the order's own date travels beside it
    o = table(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").alias("time"), "o_orderdate", "o_orderkey", "o_totalprice", "o_orderpriority")
    o.write.parquet(at)
    engine.import_parquet(at, "prod", "orders")
    return engine.sql("SELECT o_orderdate AS time, o_orderkey, o_totalprice, o_orderpriority FROM prod.orders").withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("SELECT count(*) AS rows, CAST(1 AS BIGINT) AS partitions, TIMESTAMP '2024-01-01' AS min_time, TIMESTAMP '2024-01-01' AS max_time, CAST(9 AS BIGINT) AS columns FROM part JOIN (SELECT 1) ON true")
def svc_import_report(spark, sf_dir):
    engine, at = store(spark), work_folder(spark, "parquet")
    table(spark, sf_dir, "part").select(F.lit("2024-01-01").cast("timestamp").alias("time"), "*", F.lit(1).alias("a"), F.lit(2).alias("b")).write.parquet(at)
    r = engine.import_parquet(at, "prod", "part")
    return spark.createDataFrame([(r["rows"], r["partitions"], r["min_time"], r["max_time"], len(r["columns"]))], "rows long, partitions long, min_time timestamp_ntz, max_time timestamp_ntz, columns long")


@query("SELECT * FROM (VALUES ('ts,,b', 'empty'), ('ts,b,b', 'repeated'), ('a,b', 'no time'), ('ts,time', 'renaming'), ('ts, a', 'fine')) AS t(header, verdict)")
def svc_import_headers(spark, sf_dir):
    def verdict(header):
        try:
            imports.checked_header(header.split(","), "ts")
            return "fine"
        except ValueError as e:
            return next(w for w in ("empty", "repeated", "no time", "renaming") if w in str(e))

    return spark.createDataFrame([(h, verdict(h)) for h in ("ts,,b", "ts,b,b", "a,b", "ts,time", "ts, a")], "header string, verdict string")


@query("SELECT ts AS time, CAST(user_id AS VARCHAR) AS user_id, event_id, value FROM events")
def lp_import(spark, sf_dir):
    """Line protocol from compressed text files."""
    engine, at = store(spark), work_folder(spark, "lines")
    e = table(spark, sf_dir, "events").withColumn("hour0", F.date_trunc("day", "ts"))
    lines = lineproto.render(e.repartition(4, "event_id"), "ev", ["user_id"], ["event_id", "value"], "ts")
    lines.write.option("compression", "gzip").text(at)
    pts = lineproto.read_lines(spark, at)
    engine.write_df(points.columns(pts, "ev", ["user_id"], {"event_id": "long", "value": "double"}), "prod", "ev", level="day")
    return plain_time(engine.sql("SELECT time, user_id, event_id, value FROM prod.ev"))


_ISS = "ISS (ZARYA)\n1 25544U 98067A   08264.51782528 -.00002182  00000-0 -11606-4 0  2927\n2 25544  51.6416 247.4627 0006703 130.5360 325.0288 15.72125391563537"


@query("""SELECT TIMESTAMP '2008-09-20 12:25:40.104192' AS time, '25544' AS norad_id, 'ISS (ZARYA)' AS object_name, 'U' AS classification, '98067A' AS international_designator, 'LEO' AS orbit_type, 51.6416::DOUBLE AS inclination_deg,
247.4627::DOUBLE AS raan_deg, 0.0006703::DOUBLE AS eccentricity, 130.5360::DOUBLE AS arg_perigee_deg, 325.0288::DOUBLE AS mean_anomaly_deg, 15.72125391::DOUBLE AS mean_motion_rev_day, -0.000011606::DOUBLE AS bstar, 56353::DOUBLE AS revolution_number,
round(1440 / 15.72125391, 6) AS period_min, round(pow(3.986004418e14 / pow(15.72125391 * 2 * pi() / 86400, 2), 1.0 / 3) / 1000, 4) AS semi_major_axis_km,
round(pow(3.986004418e14 / pow(15.72125391 * 2 * pi() / 86400, 2), 1.0 / 3) / 1000 * 1.0006703 - 6378.137, 4) AS apogee_km, round(pow(3.986004418e14 / pow(15.72125391 * 2 * pi() / 86400, 2), 1.0 / 3) / 1000 * 0.9993297 - 6378.137, 4) AS perigee_km""")
def svc_tle_import(spark, sf_dir):
    """An orbital element set, its derived columns and its bad neighbour, from a text file."""
    engine, at = store(spark), work_folder(spark, "tle")
    bad = _ISS.replace("2927", "2928")
    spark.createDataFrame([(_ISS + "\r\n" + bad,)], "value string").coalesce(1).write.text(at)
    engine.import_tle(at, "space")
    names = "time norad_id object_name classification international_designator orbit_type inclination_deg raan_deg eccentricity arg_perigee_deg mean_anomaly_deg mean_motion_rev_day bstar revolution_number"
    out = engine.sql(f"SELECT {', '.join(names.split())}, round(period_min, 6) AS period_min, round(semi_major_axis_km, 4) AS semi_major_axis_km, round(apogee_km, 4) AS apogee_km, round(perigee_km, 4) AS perigee_km FROM space.satellite_tle")
    return plain_time(out)


@query("SELECT conv_id, turn, role FROM conversations UNION ALL SELECT conv_id, turn, role FROM conversations")
def msgpack_bodies(spark, sf_dir):
    """MessagePack bodies, gzip and zstd."""
    import pyarrow as pa


    def packed(stream):
        import gzip

        import zstandard

        squeeze = zstandard.ZstdCompressor().compress
        for b in stream:
            bodies = []
            for r in b.to_pylist():
                body = messages.pack({"m": "c", "t": 1704067200, "fields": {"conv_id": r["conv_id"], "turn": r["turn"]}, "tags": {"role": r["role"]}})
                bodies += [gzip.compress(body), squeeze(body)]
            yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary())], ["value"])

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    pts = messages.decode(c.mapInArrow(packed, "value binary"), bad="fail")
    return points.columns(pts, "c", ["role"], {"conv_id": "long", "turn": "long"}).select("conv_id", "turn", "role")


# upkeep
def _customers(spark, sf_dir, batches: int) -> Engine:
    """Customers as a measurement of three hours, written in several batches; every third row twice."""
    engine, c = store(spark), table(spark, sf_dir, "customer")
    hour = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("c_custkey") % 3 * 3600 + F.col("c_custkey") % 3600)
    c = c.select(hour.alias("time"), F.col("c_custkey").cast("string").alias("k"), "c_name", "c_acctbal")
    for b in range(batches):
        own = c.filter(F.pmod(F.col("k").cast("long"), F.lit(batches)) == b)
        again = c.filter(F.pmod(F.col("k").cast("long"), F.lit(3 * batches)) == b - 1).withColumn("c_acctbal", F.col("c_acctbal") + 1)
        engine.write_df(own.unionByName(again) if b else own, "prod", "cust", tags=["k"])
    return engine


_LATEST = "SELECT CAST(c_custkey AS VARCHAR) AS k, c_name, c_acctbal + CASE WHEN c_custkey % 30 BETWEEN 0 AND 8 THEN 1 ELSE 0 END AS c_acctbal FROM customer"


@query(_LATEST)
def svc_compact_hourly(spark, sf_dir):
    """Ten batches become one file an hour, of a row written twice the later one stays."""
    engine = _customers(spark, sf_dir, 10)
    for report in engine.compact("prod", "cust"):
        if not report["files_after"] < report["files_before"]:
            raise AssertionError(report)
    return engine.sql("SELECT k, c_name, c_acctbal FROM prod.cust")


@query("SELECT CAST(TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 3 AS INTEGER)) AS TIMESTAMP) AS hour, CAST(10 AS BIGINT) AS files FROM customer GROUP BY 1")
def svc_compact_candidates(spark, sf_dir):
    """Hours with ten files are candidates; hours younger than an hour are not."""
    engine = _customers(spark, sf_dir, 10)
    now = 1_704_067_200_000_000 + 5 * _DAY
    found = engine.compaction_candidates("prod", "cust", now=now)
    if engine.compaction_candidates("prod", "cust", now=1_704_067_200_000_000 + 3 * 3_600_000_000) and len(found) < 3:
        raise AssertionError("young hours are candidates")
    hours = spark.createDataFrame([(c["partition"], len(c["files"])) for c in found], "at long, files long")
    return hours.select(F.timestamp_micros("at").cast("timestamp_ntz").alias("hour"), "files")


@query("SELECT event_type, event_id, value FROM events")
def svc_compact_plain(spark, sf_dir):
    """Without tags no row is dropped, equal times or not."""
    engine, e = store(spark), events_of(spark, sf_dir).withColumn("time", F.date_trunc("week", "time"))
    for half in (0, 1):
        engine.write_df(e.filter(F.col("event_id") % 2 == half), "prod", "ev", tags=[], level="hour")
    files = list(engine.catalog.manifest("prod", "ev")["files"])
    maintain.compact(engine.catalog, "prod", "ev", files)
    return engine.sql("SELECT event_type, event_id, value FROM prod.ev")


@query("SELECT CAST(c_custkey AS VARCHAR) AS k, c_name, c_acctbal FROM customer")
def svc_compact_daily(spark, sf_dir):
    """A day of 24 hour files becomes one day file, once it is a day old."""
    engine, c = store(spark), table(spark, sf_dir, "customer")
    hour = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("c_custkey") % 24 * 3600 + F.col("c_custkey") % 3600)
    engine.write_df(c.select(hour.alias("time"), F.col("c_custkey").cast("string").alias("k"), "c_name", "c_acctbal"), "prod", "cust", tags=["k"])
    young = engine.compaction_candidates("prod", "cust", "daily", now=1_704_067_200_000_000 + _DAY + _DAY // 2)
    report = engine.compact("prod", "cust", "daily")
    if young or [r["files_before"] for r in report] != [24] or report[0]["files_after"] != 1:
        raise AssertionError((young, report))
    return engine.sql("SELECT k, c_name, c_acctbal FROM prod.cust")


@query("SELECT 'no time column' AS skipped, CAST(1 AS BIGINT) AS files, count(*) AS rows FROM region")
def svc_compact_without_time(spark, sf_dir):
    """Files without a time column are left alone."""
    engine = store(spark)
    at = f"{engine.catalog.path('prod', 'odd')}/batch=1"
    table(spark, sf_dir, "region").coalesce(1).write.parquet(at)
    path = next(p for p in engine.catalog.files.sizes(at) if p.endswith(".parquet"))
    n = table(spark, sf_dir, "region").count()
    engine.catalog.commit("prod", "odd", {path: {"rows": n, "min": None, "max": None, "bytes": 1, "level": "hour", "tier": "hot", "seq": 0, "made": 0}})
    r = maintain.compact(engine.catalog, "prod", "odd", [path])
    return spark.createDataFrame([(r["skipped"], r["files"], engine.count("prod", "odd"))], "skipped string, files long, rows long")


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def svc_count_per_file(spark, sf_dir):
    """Rows of each file, by the day in its path."""
    engine = with_events(spark, sf_dir)
    df = engine.catalog.read(sorted(engine.catalog.manifest("prod", "ev")["files"]), (F.col("_metadata.file_path").alias("f"),))
    part = lambda name: F.regexp_extract("f", rf"/{name}=(\d+)", 1).cast("int")
    return df.groupBy("f").agg(F.count("*").alias("n")).groupBy(F.make_date(part("year"), part("month"), part("day")).alias("day")).agg(F.sum("n").alias("n"))


@query(_EVENTS)
def svc_tiers(spark, sf_dir):
    """Day files older than the limit move to the cold root; queries read both tiers."""
    engine = with_events(spark, sf_dir)
    now = int(dt.datetime(2024, 1, 30, tzinfo=_UTC).timestamp() * 1e6)
    moved = maintain.migrate(engine.catalog, "prod", "ev", 14, now)
    tiers = {f["tier"] for f in engine.catalog.manifest("prod", "ev")["files"].values()}
    if not moved or tiers != {"hot", "cold"}:
        raise AssertionError(tiers)
    return plain_time(engine.sql("SELECT time, event_type, user_id, event_id, value FROM prod.ev"))


@query("SELECT event_id, ts AS time FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-16' OR date_trunc('day', ts) IN (SELECT d FROM (SELECT date_trunc('day', ts) AS d, max(ts) AS m FROM events GROUP BY 1) WHERE m >= TIMESTAMP '2024-01-16 00:00:00')")
def svc_retention(spark, sf_dir):
    """Whole files behind the cutoff go: seven days and a buffer of seven, on January 30."""
    engine = with_events(spark, sf_dir)
    engine.retention("prod", 7, now=int(dt.datetime(2024, 1, 30, tzinfo=_UTC).timestamp() * 1e6))
    return plain_time(engine.sql("SELECT event_id, time FROM prod.ev"))


@query("SELECT count(*) AS rows, count(DISTINCT CAST(ts AS DATE)) AS files, true AS dry_run FROM events WHERE ts < (SELECT date_trunc('day', max(ts)) - INTERVAL 20 DAYS FROM events)")
def svc_retention_dry(spark, sf_dir):
    engine = with_events(spark, sf_dir)
    newest = max(f["max"] for f in engine.catalog.manifest("prod", "ev")["files"].values())
    r = engine.retention("prod", 13, now=newest // _DAY * _DAY, dry_run=True)["ev"]
    return spark.createDataFrame([(r["rows"], r["files"], r["dry_run"])], "rows long, files long, dry_run boolean")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value FROM events WHERE (CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END > 50) IS NOT TRUE")
def svc_delete(spark, sf_dir):
    """A delete removes rows for which the predicate is true, not those where it is null."""
    engine = store(spark)
    e = events_of(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 4 != 0, F.col("value")))
    engine.write_df(e, "prod", "ev", tags=["user_id"], level="day")
    engine.delete_where("prod", "ev", "value > 50", confirm=True)  # however many rows these are
    return engine.sql("SELECT event_id, value FROM prod.ev")


@query(_EVENTS)
def svc_backup(spark, sf_dir):
    """A database dropped and brought back from a snapshot."""
    engine, to = with_events(spark, sf_dir), work_folder(spark, "snapshot")
    maintain.snapshot(engine.catalog, "prod", to)
    engine.catalog.drop_database("prod")
    if engine.catalog.databases():
        raise AssertionError("not dropped")
    maintain.restore(engine.catalog, to, "prod")
    return plain_time(engine.sql("SELECT time, event_type, user_id, event_id, value FROM prod.ev"))


# continuous queries and streams
_CQ = "SELECT time_bucket(INTERVAL '1 hour', time) AS time, event_type, count(*) AS n, round(sum(value), 6) AS s FROM prod.ev WHERE time >= '{start_time}' AND time < '{end_time}' GROUP BY 1, 2"


@query("""SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS time, event_type, count(*) AS n, round(sum(value), 6) AS s FROM events
WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-10' GROUP BY 1, 2""")
def svc_continuous(spark, sf_dir):
    """Three runs, one after a restart and one that repeats a window, leave each bucket once."""
    engine = with_events(spark, sf_dir)
    at = lambda day: dt.datetime(2024, 1, day, tzinfo=_UTC)
    cq = rollup.ContinuousQuery("hourly", "prod", "prod.ev", "ev_1h", _CQ, "1 hour", ["event_type"], last=at(3))
    cq.save(engine)
    cq.run(engine, now=at(6))
    cq = rollup.ContinuousQuery.load(engine, "prod", "hourly")
    cq.run(engine, now=at(10))
    cq.run(engine, start=at(5), end=at(8))
    return plain_time(engine.sql("SELECT time, event_type, n, s FROM prod.ev_1h"))


@query("SELECT * FROM (VALUES (TIMESTAMP '2024-01-03 00:00:00', TIMESTAMP '2024-01-03 05:00:00', true, true)) AS t(start_time, end_time, dry_run, named)")
def svc_continuous_dry(spark, sf_dir):
    """A dry run tells its window, whose end is a whole interval, and writes nothing."""
    engine = with_events(spark, sf_dir)
    cq = rollup.ContinuousQuery("hourly", "prod", "prod.ev", "ev_1h", _CQ, "1 hour", ["event_type"], last=dt.datetime(2024, 1, 3, tzinfo=_UTC))
    r = cq.run(engine, now=dt.datetime(2024, 1, 3, 5, 30, tzinfo=_UTC), dry_run=True)
    bare = lambda t: t.replace(tzinfo=None)
    return spark.createDataFrame([(bare(r["start"]), bare(r["end"]), r["dry_run"], "'2024-01-03T05:00:00'" in r["query"] and "ev_1h" not in engine.catalog.measurements("prod"))], "start_time timestamp_ntz, end_time timestamp_ntz, dry_run boolean, named boolean")


@query("SELECT event_type, count(*) AS n, sum(event_id) AS ids FROM events GROUP BY event_type")
def lp_stream(spark, sf_dir):
    """A stream of lines, restarted from its checkpoint: every point once."""
    engine, at = store(spark), work_folder(spark, "lines")
    e = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("week", "ts") + F.expr("make_dt_interval(0, 0, 0, event_id / 1000000.0)"))
    lineproto.render(e.repartition(3, "event_id"), "ev", ["event_type"], ["event_id"], "ts").write.text(at)
    for _ in range(2):
        rollup.ingest_stream(engine, rollup.line_stream(spark, at, most_files=2), "prod", at + "-checkpoint", every=None).awaitTermination()
    return engine.sql("SELECT event_type, count(*) AS n, sum(event_id) AS ids FROM prod.ev GROUP BY event_type")


@query("SELECT TIMESTAMP '2024-01-03' AS time, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-05' GROUP BY event_type")
def svc_continuous_stamp(spark, sf_dir):
    """Rows without a time get the start of their window."""
    engine = with_events(spark, sf_dir)
    text = "SELECT event_type, count(*) AS n FROM prod.ev WHERE time >= '{start_time}' AND time < '{end_time}' GROUP BY event_type"
    cq = rollup.ContinuousQuery("plain", "prod", "prod.ev", "ev_2d", text, "1 day", ["event_type"], last=dt.datetime(2024, 1, 3, tzinfo=_UTC))
    cq.run(engine, now=dt.datetime(2024, 1, 5, 7, tzinfo=_UTC))
    return plain_time(engine.sql("SELECT time, event_type, n FROM prod.ev_2d"))


@query("SELECT CASE WHEN role = 'user' THEN 'asked' ELSE 'told' END AS database, count(*) AS n, sum(turn) AS turns FROM conversations GROUP BY 1")
def json_message_stream(spark, sf_dir):
    """JSON messages of a stream go to the databases of their topics, each once though it is run twice."""
    engine, at = store(spark), work_folder(spark, "messages")
    body = F.to_json(F.struct(F.lit("turns").alias("m"), F.lit(1704067200).alias("timestamp"), "conv_id", "turn"))
    table(spark, sf_dir, "conversations").select(F.concat(F.lit("chat/"), "role").alias("topic"), body.alias("value")).write.parquet(at)
    for _ in range(2):
        stream = spark.readStream.schema("topic string, value string").parquet(at)
        rollup.message_stream(engine, stream, {"chat/user": "asked", "chat/+": "told"}, at + "-checkpoint", every=None).awaitTermination()
    part = lambda d: engine.sql(f"SELECT '{d}' AS database, count(*) AS n, sum(turn) AS turns FROM {d}.turns")
    return part("asked").unionByName(part("told"))


#: Rows of one file of a stream, so that large streams are read by many even tasks.
STREAM_ROWS = 250_000


def _stream(spark, sf_dir) -> DataFrame:
    at = work_folder(spark, "stream")
    e = events_of(spark, sf_dir)
    e.write.option("maxRecordsPerFile", STREAM_ROWS).parquet(at)
    return spark.readStream.schema(e.schema).parquet(at)


@query("SELECT CAST(time_bucket(INTERVAL '1 day', ts) AS TIMESTAMP) AS time, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1, 2")
def svc_stream_rollup(spark, sf_dir):
    """A streaming rollup keeps a measurement up to date."""
    engine, at = store(spark), work_folder(spark, "checkpoint")
    rolled = rollup.rollup_stream(_stream(spark, sf_dir), "time", "1 day", ["event_type"], {"n": F.count("*"), "s": F.round(F.sum("value"), 4)}, late="60 days")
    rollup.start_stream(engine, rolled, "prod", "ev_1d", ["event_type"], at).awaitTermination()
    return plain_time(engine.sql("SELECT time, event_type, n, s FROM prod.ev_1d"))


@query("SELECT event_type, ts AS time, v AS value, p AS previous FROM (SELECT event_type, ts, v, lag(v) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM (SELECT event_type, ts, CAST(max(event_id % 2) AS DOUBLE) AS v FROM events GROUP BY 1, 2)) WHERE p IS NULL OR p <> v")
def json_stream_changes(spark, sf_dir):
    """Custom state in a stream: rows whose value differs from the one before, over two micro-batches."""
    engine, at = store(spark), work_folder(spark, "stream")
    e = events_of(spark, sf_dir).groupBy("event_type", "time").agg(F.max(F.col("event_id") % 2).cast("double").alias("value"))
    middle = F.lit("2024-01-15").cast("timestamp")
    for nth, half in enumerate((e.filter(F.col("time") < middle), e.filter(F.col("time") >= middle))):
        half.coalesce(1).write.mode("append").parquet(at)
        stream = rollup.change_stream(spark.readStream.schema(e.schema).parquet(at), "time", "value", ["event_type"], forget="60 days")
        put = lambda batch, n: engine.write_df(batch, "prod", "changes", tags=["event_type"], level="day") if not batch.isEmpty() else None
        stream.writeStream.option("checkpointLocation", at + "-checkpoint").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return plain_time(engine.sql("SELECT event_type, time, value, previous FROM prod.changes"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def svc_stream_sessions(spark, sf_dir):
    """Session windows of a stream, summed over each user's sessions."""
    engine, at = store(spark), work_folder(spark, "checkpoint")
    sessions = rollup.session_stream(_stream(spark, sf_dir), "time", "2 hours", ["user_id"], late="60 days")
    put = lambda batch, n: engine.write_df(batch.withColumn("time", F.col("start")), "prod", "sessions", tags=["user_id"], level="day")
    writer = sessions.writeStream.outputMode("complete").option("checkpointLocation", at).foreachBatch(put)
    writer.trigger(availableNow=True).start().awaitTermination()
    return engine.sql("SELECT user_id, sum(n) AS n FROM prod.sessions GROUP BY user_id").withColumn("user_id", F.col("user_id").cast("long"))


@query("""SELECT event_id, round((value - avg(value) OVER w) / nullif(stddev(value) OVER w, 0), 5) AS z FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 144 PRECEDING AND 1 PRECEDING)""")
def zscore_pieces(spark, sf_dir):
    """Rolling z-scores with each key cut into days."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    out = series.rolling_rows(e, ["event_type"], "ts", ["event_id"], 144, "1 day", m=lambda w: F.avg("value").over(w), s=lambda w: F.stddev("value").over(w))
    return out.select("event_id", F.round((F.col("value") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)), 5).alias("z"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), 6) AS a FROM events")
def rolling_pieces(spark, sf_dir):
    """A rolling mean over an hour, merged from two running ones."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    out = series.rolling(e, ["event_type"], "ts", "1 hour", a=("avg", "value"))
    return out.select("event_id", F.round("a", 6).alias("a"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(median(l_extendedprice), 6) AS med FROM lineitem GROUP BY l_returnflag")
def percentile_bins(spark, sf_dir):
    """Exact quantiles by a histogram and a sort of two bins."""
    out = series.percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p95": 0.95, "med": 0.5})
    return out.select("l_returnflag", F.round("p95", 6).alias("p95"), F.round("med", 6).alias("med"))


@query("SELECT * FROM (VALUES ('plant/a/temp', 'plant'), ('plant/b', 'plant'), ('lab/x/y', 'lab'), ('lab/x', 'other'), ('else', 'other')) AS t(topic, database)")
def svc_topics(spark, sf_dir):
    """The database of a message follows from its topic."""
    topics = spark.createDataFrame([(t,) for t in ("plant/a/temp", "plant/b", "lab/x/y", "lab/x", "else")], "topic string")
    return topics.select("topic", rollup.topic_database(F.col("topic"), {"plant/#": "plant", "lab/+/y": "lab"}, "other").alias("database"))


# results
@query("""SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","time":"' || strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || 'Z","none":null}' AS value FROM events""")
def svc_json_rows(spark, sf_dir):
    engine = with_events(spark, sf_dir)
    return engine.to_json_rows(engine.sql("SELECT event_id, event_type, date_trunc('second', time) AS time, CAST(NULL AS DOUBLE) AS none FROM prod.ev"))


@query("SELECT n_name, n_regionkey, CAST(n_regionkey % 2 = 0 AS INTEGER) AS even FROM nation")
def svc_arrow_ipc(spark, sf_dir):
    """An Arrow IPC stream with dictionaries, read back."""
    import pyarrow as pa

    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    data = Engine.to_ipc(store(spark).sql("SELECT n_name, n_regionkey, CAST(n_regionkey % 2 = 0 AS INTEGER) AS even FROM nation"), "zstd", dictionary=True)
    back = pa.ipc.open_stream(data).read_all()
    return spark.createDataFrame([tuple(r.values()) for r in back.to_pylist()], "n_name string, n_regionkey int, even int")


@query("SELECT r_name, r_regionkey FROM region")
def msgpack_result(spark, sf_dir):
    """A result as MessagePack columns, read back."""
    table(spark, sf_dir, "region").createOrReplaceTempView("region")
    got = messages.unpack(Engine.to_msgpack(store(spark).sql("SELECT r_name, r_regionkey FROM region")))
    return spark.createDataFrame(list(zip(*got["data"])), "r_name string, r_regionkey int")


# query text that Spark's parser does not know
def _as_text(name: str, text: str, oracle: str, *tables: str):
    @query(oracle)
    def run(spark, sf_dir):
        for t in tables:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        e = table(spark, sf_dir, "events")
        e.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.min("event_id").alias("event_id")).createOrReplaceTempView("clicks")
        e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase_id")).createOrReplaceTempView("purchases")
        return store(spark).sql(text)

    from tarnlight.plans.catalogue import ORACLES, QUERIES

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


_PARTS = """WITH clicks AS (SELECT user_id, ts, min(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2), purchases AS (SELECT user_id, ts, max(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) """
_ASOF = "SELECT c.event_id, c.user_id, p.purchase_id FROM clicks c ASOF LEFT JOIN purchases p ON c.user_id = p.user_id AND c.ts >= p.ts"
_as_text("text_asof", _ASOF, _PARTS + _ASOF)
_POSITIONAL = "SELECT n_name, r_name FROM nation POSITIONAL JOIN region"
_as_text("text_positional", _POSITIONAL, _POSITIONAL, "nation", "region")
_NAMED = "SELECT n_name AS name, n_regionkey AS k FROM nation UNION ALL BY NAME SELECT r_regionkey AS k FROM region"
_as_text("text_union_by_name", _NAMED, _NAMED, "nation", "region")
