"""Bulk import of CSV and Parquet files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.functions.timefns import MICROS

_LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][XXX]", "yyyy-MM-dd")
_BOOLS = ("true", "false", "t", "f", "yes", "no")


def checked_header(names: list[str], time_col: str) -> list[str]:
    """Names without surrounding space; empty, repeated or missing ones are errors."""
    names = [n.strip() for n in names]
    if any(not n for n in names):
        raise ValueError("empty column name in header")
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise ValueError(f"repeated column names: {sorted(twice)}")
    if time_col not in names:
        raise ValueError(f"no time column {time_col!r}")
    if time_col != "time" and "time" in names:
        raise ValueError("renaming the time column would give two columns named time")
    return names


def instant(c: Column, form: str = "auto") -> Column:
    """Import cells as instants: ``epoch_s|ms|us|ns``, or by magnitude, or as text."""
    whole = c.try_cast("bigint")
    scaled = {"epoch_s": whole * 1_000_000, "epoch_ms": whole * 1_000, "epoch_us": whole, "epoch_ns": (whole / 1000).cast("bigint")}
    if form != "auto":
        return F.timestamp_micros(scaled[form])
    size = F.abs(whole)
    micros = F.when(size < 10**10, scaled["epoch_s"]).when(size < 10**13, scaled["epoch_ms"]).when(size < 10**16, scaled["epoch_us"]).otherwise(scaled["epoch_ns"])
    text = F.coalesce(c.try_cast("timestamp"), *[F.try_to_timestamp(c, F.lit(x)) for x in _LAYOUTS[2:]])
    return F.when(whole.isNotNull(), F.timestamp_micros(micros)).otherwise(text)


def inferred_types(df: DataFrame, skip: tuple[str, ...] = ()) -> dict[str, str]:
    """Narrowest of bigint, double, boolean and string per text column: one aggregate over all rows."""
    cols = [c for c in df.columns if c not in skip]
    if not cols:
        return {}
    checks = []
    for i, c in enumerate(cols):
        v = F.trim(F.col(f"`{c}`"))
        full = v.isNotNull() & (v != "")
        checks += [F.count_if(full).alias(f"n{i}"), F.count_if(full & v.try_cast("bigint").isNull()).alias(f"i{i}"), F.count_if(full & v.try_cast("double").isNull()).alias(f"d{i}"), F.count_if(full & ~F.lower(v).isin(*_BOOLS)).alias(f"b{i}")]
    r = df.agg(*checks).first()
    kind = lambda i: "string" if not r[f"n{i}"] else "bigint" if not r[f"i{i}"] else "double" if not r[f"d{i}"] else "boolean" if not r[f"b{i}"] else "string"
    return {c: kind(i) for i, c in enumerate(cols)}


def read_csv(spark: SparkSession, path: str, time_col: str = "time", time_format: str = "auto", delimiter: str = ",", skip_rows: int = 0) -> DataFrame:
    """A CSV file with header as a measurement; short rows are padded, types inferred over the whole column.

    Empty cells are null in numeric and boolean columns and '' in text columns.  Rows
    whose time cannot be read are left out.
    """
    options = dict(header=True, sep=delimiter, inferSchema=False, mode="PERMISSIVE", emptyValue="", nullValue="\u0000")
    if skip_rows:
        # the head lies in the first split of the file; numbers are needed there alone
        lines = spark.read.text(path, wholetext=False).withColumn("id", F.monotonically_increasing_id())
        raw = spark.read.csv(lines.filter(F.col("id") >= skip_rows).select("value").rdd.map(lambda r: r[0]), **options)
    else:
        raw = spark.read.csv(path, enforceSchema=False, **options)
    names = [n.lstrip("﻿") for n in raw.columns]
    raw = raw.toDF(*checked_header(names, time_col))
    types = inferred_types(raw, (time_col,))
    cols = [instant(F.trim(F.col(f"`{time_col}`")), time_format).alias("time")]
    for c, t in types.items():
        v = F.col(f"`{c}`")
        if t == "boolean":
            v = F.lower(F.trim(v)).isin("true", "t", "yes") & (F.trim(v) != "")
            v = F.when(F.trim(F.col(f"`{c}`")) != "", v)
        elif t != "string":
            v = F.trim(v).try_cast(t)
        else:
            v = F.coalesce(v, F.lit(""))
        cols.append(v.alias(c))
    return raw.select(*cols).filter("time IS NOT NULL")


def read_parquet(spark: SparkSession, path: str, time_col: str = "time", time_format: str = "auto", compat: bool = False) -> DataFrame:
    """A Parquet file as a measurement: integers long, floats double, binary text.

    ``compat`` also turns decimals into doubles and other timestamps into microseconds.
    """
    raw = spark.read.parquet(path)
    checked_header(raw.columns, time_col)
    cols = []
    for name, kind in raw.dtypes:
        c = F.col(f"`{name}`")
        if name == time_col:
            stamp = c.cast("timestamp") if kind in ("timestamp", "timestamp_ntz", "date") else instant(c.cast("string"), time_format)
            cols.insert(0, stamp.alias("time"))
            continue
        if kind in ("tinyint", "smallint", "int"):
            c = c.cast("bigint")
        elif kind == "float":
            c = c.cast("double")
        elif kind == "binary":
            c = c.cast("string")
        elif compat and kind.startswith("decimal"):
            c = c.cast("double")
        elif compat and kind in ("timestamp", "timestamp_ntz"):
            c = F.unix_micros(c.cast("timestamp"))
        elif kind.split("<")[0] in ("array", "map", "struct"):
            raise ValueError(f"column {name} of type {kind} cannot be stored")
        cols.append(c.alias(name))
    return raw.select(*cols)


def import_report(columns: list[str], files: list[dict]) -> dict:
    """Rows, hour partitions, time range and columns, from what the log says of the written files."""
    lows, highs = ([f[k] for f in files if f[k] is not None] for k in ("min", "max"))
    stamp = lambda t: dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=t)
    return {"rows": sum(f["rows"] for f in files), "partitions": len({t // MICROS["hour"] for t in lows}), "min_time": stamp(min(lows)) if lows else None, "max_time": stamp(max(highs)) if highs else None, "columns": columns}
