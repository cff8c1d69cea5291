"""Two-line orbital elements: fixed columns read with Spark expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Earth's gravity in m^3/s^2, its radius in km, and the height of a geostationary orbit. Fixed values.
MU, RADIUS, GEO_HEIGHT = 3.986004418e14, 6378.137, 35786.0
#: Output columns after time: text, then numbers. Fixed names.
TEXT = ("norad_id", "object_name", "classification", "international_designator", "orbit_type")
NUMBERS = ("inclination_deg", "raan_deg", "eccentricity", "arg_perigee_deg", "mean_anomaly_deg", "mean_motion_rev_day", "bstar", "mean_motion_dot", "mean_motion_ddot", "revolution_number", "semi_major_axis_km", "period_min", "apogee_km", "perigee_km")


def _cut(line: Column, first: int, last: int) -> Column:
    """Columns ``first`` to ``last`` of a line, counted from 1 as in the format's tables."""
    return F.trim(F.substring(line, first, last - first + 1))


def checksum_ok(line: Column) -> Column:
    """Digits count their value, minus signs one; the last column holds the sum modulo 10."""
    kept = F.regexp_replace(F.substring(line, 1, 68), "[^0-9-]", "")
    ones = F.length(kept) - F.length(F.replace(kept, F.lit("-"), F.lit("")))
    total = sum((d * (F.length(kept) - F.length(F.replace(kept, F.lit(str(d)), F.lit("")))) for d in range(1, 10)), ones)
    return (F.length(line) >= 69) & (total % 10 == F.substring(line, 69, 1).try_cast("int"))


def compact_exponential(text: Column) -> Column:
    """A number such as `` 12345-4`` for 0.12345e-4; blank and zero forms are 0, others null."""
    m = r"^([+-]?)\s*(\d*)([+-]\d+)$"
    value = F.concat(F.regexp_extract(text, m, 1), F.lit("0."), F.regexp_extract(text, m, 2), F.lit("e"), F.regexp_extract(text, m, 3)).try_cast("double")
    return F.when(text.rlike(r"^[0 +-]*$"), F.lit(0.0)).when(text.rlike(m), F.when(F.regexp_extract(text, m, 2) == "", F.lit(0.0)).otherwise(value))


def orbit_class(perigee: Column, apogee: Column, eccentricity: Column) -> Column:
    """SUB below ground; HEO, GEO, LEO and MEO by heights in km and eccentricity."""
    mean = (perigee + apogee) / 2
    return (
        F.when(perigee < 0, "SUB").when((eccentricity > 0.25) & (apogee > GEO_HEIGHT), "HEO").when((mean > GEO_HEIGHT - 200) & (mean < GEO_HEIGHT + 200), "GEO")
        .when(apogee < 2000, "LEO").when((perigee >= 2000) & (apogee <= GEO_HEIGHT), "MEO").otherwise("HEO")
    )


def parse_elements(texts: DataFrame, column: str = "value") -> DataFrame:
    """One row per valid entry of whole texts (one text per row), 20 columns.

    An entry is a line 1 followed by a line 2; a line before them that is neither is the
    object's name.  Entries with a bad checksum, number or mismatched satellite are left out.
    """
    lines = F.filter(F.transform(F.split(F.col(column), "\r?\n"), lambda x: F.rtrim(x)), lambda x: x != "")
    df = texts.select(lines.alias("ls"))
    is_line = lambda x, n: x.startswith(f"{n} ") & (F.length(x) >= 69)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("ls") - 1, F.lit(1))), lambda i: is_line(F.get("ls", i - 1), 1) & is_line(F.get("ls", i), 2))
    df = df.filter(F.size("ls") > 1).select("ls", F.explode(starts).alias("i"))
    before = F.get("ls", F.col("i") - 2)
    named = before.isNotNull() & ~before.rlike("^[12] ")
    df = df.select(F.get("ls", F.col("i") - 1).alias("a"), F.get("ls", F.col("i")).alias("b"), F.when(named, F.trim(F.regexp_replace(before, "^0 ", ""))).otherwise("").alias("object_name"))
    a, b = F.col("a"), F.col("b")
    df = df.filter(checksum_ok(a) & checksum_ok(b) & (_cut(a, 3, 7) == _cut(b, 3, 7)))
    num = lambda c: c.try_cast("double")
    year = _cut(a, 19, 20).try_cast("int")
    day = num(_cut(a, 21, 32))
    midnight = F.unix_micros(F.make_timestamp(F.when(year >= 57, 1900 + year).otherwise(2000 + year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    df = df.select(
        F.timestamp_micros(midnight + ((day - 1) * 86_400_000_000).cast("bigint")).alias("time"), _cut(a, 3, 7).alias("norad_id"), "object_name", F.substring(a, 8, 1).alias("classification"), _cut(a, 10, 17).alias("international_designator"),
        num(_cut(b, 9, 16)).alias("inclination_deg"), num(_cut(b, 18, 25)).alias("raan_deg"), num(F.concat(F.lit("0."), _cut(b, 27, 33))).alias("eccentricity"), num(_cut(b, 35, 42)).alias("arg_perigee_deg"),
        num(_cut(b, 44, 51)).alias("mean_anomaly_deg"), num(_cut(b, 53, 63)).alias("mean_motion_rev_day"), compact_exponential(F.substring(a, 54, 8)).alias("bstar"), num(_cut(a, 34, 43)).alias("mean_motion_dot"),
        compact_exponential(F.substring(a, 45, 8)).alias("mean_motion_ddot"), F.coalesce(num(_cut(b, 64, 68)), F.lit(0.0)).alias("revolution_number"),
    )
    needed = ("time", "inclination_deg", "raan_deg", "eccentricity", "arg_perigee_deg", "mean_anomaly_deg", "mean_motion_rev_day", "bstar", "mean_motion_dot", "mean_motion_ddot")
    df = df.dropna(subset=list(needed))
    motion = F.col("mean_motion_rev_day")
    moving = motion > 0
    axis = F.when(moving, F.pow(F.lit(MU) / F.pow(motion * (2 * math.pi / 86400), 2), F.lit(1 / 3)) / 1000).otherwise(0.0)
    df = df.withColumn("semi_major_axis_km", axis).withColumn("period_min", F.when(moving, 1440 / motion).otherwise(0.0))
    for name, sign in (("apogee_km", 1), ("perigee_km", -1)):
        df = df.withColumn(name, F.when(moving, F.col("semi_major_axis_km") * (1 + sign * F.col("eccentricity")) - RADIUS).otherwise(0.0))
    df = df.withColumn("orbit_type", F.when(moving, orbit_class(F.col("perigee_km"), F.col("apogee_km"), F.col("eccentricity"))).otherwise(""))
    return df.select("time", *TEXT, *NUMBERS)


def read_elements(spark: SparkSession, *paths: str) -> DataFrame:
    return parse_elements(spark.read.text(list(paths), wholetext=True))
