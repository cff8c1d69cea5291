import datetime as dt
import gzip

import pytest

from tarnlight.sources import imports, lineproto, messages, points, timeunits, tle


def parsed(spark, lines, precision="ns"):
    return lineproto.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), precision)


def test_line_protocol_types_and_escapes(spark):
    lines = [
        r'disk,host=a,path=/a\ b\,c used=42i,free=1024u,ratio=1.5e2,ok=true,bad=F,msg="disk \"full\", yes" 1700000000000000000',
        "cpu usage=90.5 1700000000123456789", "# comment", "", "broken", "nofield ",
    ]
    out = points.measurements(parsed(spark, lines))
    assert sorted(out) == ["cpu", "disk"]
    row = out["disk"].collect()[0].asDict()
    assert row == {"time": dt.datetime(2023, 11, 14, 22, 13, 20), "host": "a", "path": "/a b,c", "bad": False, "free": 1024, "msg": 'disk "full", yes', "ok": True, "ratio": 150.0, "used": 42}
    assert out["cpu"].collect()[0]["time"] == dt.datetime(2023, 11, 14, 22, 13, 20, 123456)
    assert points.tag_names(out["disk"]) == ["host", "path"]


@pytest.mark.parametrize("precision,stamp", [("ns", 1700000000000000000), ("us", 1700000000000000), ("ms", 1700000000000), ("s", 1700000000)])
def test_line_protocol_precision(spark, precision, stamp):
    assert parsed(spark, [f"m v=1 {stamp}"], precision).collect()[0]["time"] == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_long_lines(spark):
    """A megabyte of string and ten thousand fields: no recursion, no quadratic scan."""
    long = 'x y\\"' * 250_000
    rows = parsed(spark, [f'm s="{long}" 1', "m " + ",".join(f"f{i}={i}i" for i in range(10_000)) + " 1", "m," + ",".join(f"t{i}=v" for i in range(1000)) + " v=1 1", "m\\ " * 5000 + " v=1 1"]).collect()
    assert [(len(r["tags"]), len(r["fields"])) for r in rows] == [(0, 1), (0, 10_000), (1000, 1), (0, 1)]
    assert rows[0]["fields"]["s"] == f'"{long}"' and rows[1]["fields"]["f9999"] == "9999i"


@pytest.mark.parametrize("line", ['m s="open 1', "m", "m ", " v=1", "m v=1 2 3", "m v= 1", "m v=5x3i", ",t=a v=1 1", "m v=1\\", "m =1 1"])
def test_lines_that_are_no_points(spark, line):
    assert [r["fields"] for r in parsed(spark, [line, "good v=1 1"]).collect() if r["measurement"] == "good"] == [{"v": "1"}]


def test_line_protocol_without_time_is_now(spark):
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    for line in ("m v=1", "m v=1 soon", "m v=1 99999999999999999999999"):
        assert abs(parsed(spark, [line]).collect()[0]["time"] - now) < dt.timedelta(minutes=5)


def test_field_named_like_a_tag_and_mixed_kinds(spark):
    out = points.measurements(parsed(spark, ["m,a=x a=1i,b=2i 1", "m,a=y a=2i,b=2.5 2"]))["m"].orderBy("time").collect()
    assert [(r["a"], r["a_value"], r["b"]) for r in out] == [("x", 1, 2.0), ("y", 2, 2.5)]
    with pytest.raises(ValueError):
        points.measurements(parsed(spark, ["m b=1i 1", 'm b="x" 2']))


def test_render_parses_back(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5, 678), "a b", 'q"\\x', 5, 2.5, True), (dt.datetime(1969, 1, 1), None, "é=,", -1, -0.5, False)], "time timestamp, t string, s string, i bigint, d double, b boolean")
    back = points.measurements(lineproto.parse_lines(lineproto.render(df, "m", ["t"], ["s", "i", "d", "b"], "time")))["m"]
    assert sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, df.collect()))


def test_messagepack_forms(spark):
    row = {"m": "cpu", "t": 1700000000, "h": "web", "fields": {"v": 1, "ok": True, "s": "x"}, "tags": {"r": "eu"}}
    column = {"m": 7, "columns": {"time": [1700000000000, 1700000001000], "v": [1.5, None]}}
    assert messages.unpack(messages.pack(row)) == row
    df = spark.createDataFrame([(bytearray(gzip.compress(messages.pack(row))),), (bytearray(messages.pack({"batch": [column, {"m": "f", "f": [1, 2.5]}]})),), (bytearray(b"\xc1"),)], "value binary")
    out = {m: d.orderBy("time").collect() for m, d in points.measurements(messages.decode(df)).items()}
    assert sorted(out) == ["cpu", "f", "measurement_7"]
    assert out["cpu"][0].asDict() == {"time": dt.datetime(2023, 11, 14, 22, 13, 20), "host": "web", "r": "eu", "ok": True, "s": "x", "v": 1}
    assert [r["v"] for r in out["measurement_7"]] == [1.5, None]
    assert (out["f"][0]["field_0"], out["f"][0]["field_1"], out["f"][0]["host"]) == (1, 2.5, "unknown")


@pytest.mark.parametrize("bad", [{"m": "a", "columns": {"time": [1, 2], "v": [1]}}, {"fields": {}}, 5, {"m": "a", "t": "x", "fields": {"v": 1}}, {"m": "a", "fields": {"v": [1]}}, {"m": "a", "fields": {"v": 1 << 63}}])
def test_messagepack_rejects(bad):
    with pytest.raises(ValueError):
        messages.rows_of(messages.unpack(messages.pack(bad)), 0)


def test_json_messages(spark):
    df = spark.createDataFrame([('{"timestamp": 1700000000, "sensor": "a", "t": 21.5, "n": 3, "deep": {"x": 1}}',), ("not json",), ('[{"m": "z", "time": "2024-01-01T00:00:00Z", "tags": {"k": "v"}, "fields": {"x": 1}}]',)], "value string")
    out = {m: d.collect()[0].asDict() for m, d in points.measurements(messages.decode(df, form="json")).items()}
    assert out["mqtt"] == {"time": dt.datetime(2023, 11, 14, 22, 13, 20), "n": 3, "sensor": "a", "t": 21.5}
    assert out["z"] == {"time": dt.datetime(2024, 1, 1), "k": "v", "x": 1}


ISS = "ISS (ZARYA)\n1 25544U 98067A   08264.51782528 -.00002182  00000-0 -11606-4 0  2927\n2 25544  51.6416 247.4627 0006703 130.5360 325.0288 15.72125391563537\n"


def test_two_line_elements(spark):
    bad = ISS.replace("2927", "2920")
    out = tle.parse_elements(spark.createDataFrame([(ISS.replace("\n", "\r\n") + bad + ISS.split("\n", 1)[1],)], "value string")).collect()
    assert len(out) == 2 and len(out[0]) == 20
    r = out[0]
    assert (r["norad_id"], r["object_name"], r["classification"], r["international_designator"], r["orbit_type"]) == ("25544", "ISS (ZARYA)", "U", "98067A", "LEO")
    assert r["time"].replace(microsecond=0) == dt.datetime(2008, 9, 20, 12, 25, 40)
    assert (r["inclination_deg"], r["eccentricity"], r["bstar"], r["mean_motion_dot"], r["revolution_number"]) == (51.6416, 0.0006703, -1.1606e-05, -2.182e-05, 56353.0)
    assert abs(r["semi_major_axis_km"] - 6730.96) < 0.1 and abs(r["period_min"] - 91.596) < 0.01 and r["perigee_km"] < r["apogee_km"]
    assert out[1]["object_name"] == ""


def test_csv_import(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("ts,i,d,b,s,e,z\n2024-01-01T00:00:00Z,1,1.5,true,x,,0\n1704067201,2,2,no,,,1\n2024-01-01 00:00:02,,,yes,y,,1\n")
    df = imports.read_csv(spark, str(p), time_col="ts")
    assert dict(df.dtypes) == {"time": "timestamp", "i": "bigint", "d": "double", "b": "boolean", "s": "string", "e": "string", "z": "bigint"}
    rows = df.orderBy("time").collect()
    assert [r["time"].second for r in rows] == [0, 1, 2] and [r["i"] for r in rows] == [1, 2, None] and [r["b"] for r in rows] == [True, False, True] and [r["s"] for r in rows] == ["x", "", "y"]
    hour = 1_704_067_200_000_000
    report = imports.import_report(df.columns, [{"rows": 2, "min": hour, "max": hour + 5}, {"rows": 1, "min": hour + 3, "max": hour + 9}])
    assert (report["rows"], report["partitions"], report["max_time"]) == (3, 1, dt.datetime(2024, 1, 1, 0, 0, 0, 9))


@pytest.mark.parametrize("header", ["ts,,b", "ts,b,b", "a,b", "ts,time"])
def test_csv_header_faults(spark, tmp_path, header):
    with pytest.raises(ValueError):
        imports.checked_header(header.split(","), "ts")


def test_parquet_import(spark, tmp_path):
    spark.sql("SELECT timestamp_ntz'2024-01-01 01:00:00' AS t, CAST(1 AS INT) AS i, CAST(1.5 AS FLOAT) AS f, CAST(2.5 AS DECIMAL(8,2)) AS d, binary('x') AS b").write.parquet(str(tmp_path / "p"))
    assert dict(imports.read_parquet(spark, str(tmp_path / "p"), "t").dtypes) == {"time": "timestamp", "i": "bigint", "f": "double", "d": "decimal(8,2)", "b": "string"}
    assert dict(imports.read_parquet(spark, str(tmp_path / "p"), "t", compat=True).dtypes)["d"] == "double"


def test_time_units():
    assert [timeunits.unit_of(x) for x in (9_999_999_999, 10**10, 10**13, 10**16, -5)] == ["s", "ms", "us", "ns", "s"]
    assert timeunits.unit_of(-(10**16), signed=False) == "ns"
    assert timeunits.to_micros(-1500, "ns") == -1
    assert timeunits.parse_text("2024-01-01T02:00:00.123456789+02:00") == 1704067200123456
    assert timeunits.parse_text("2024-01-01") == 1704067200000000 and timeunits.parse_text("soon") is None
    assert timeunits.any_micros("1704067200") == timeunits.any_micros("1704067200000") == timeunits.any_micros(1704067200000000000) == 1704067200000000
