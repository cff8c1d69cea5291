"""Line protocol, parsed with Spark expressions: no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.sources.points import unescape

# Possessive quantifiers: each character is looked at once, and Java's matcher neither
# backtracks nor recurses, however long a part is.
_PART = r"(?:[^ \\]++|\\.)++"
_QUOTED = r'"(?:[^"\\]++|\\.)*+"'
_FIELDS = rf'(?:{_QUOTED}|\\.|[^ "\\]++)++'
_NAME = r"(?:[^=,\\]++|\\.)++"
_PAIR = rf"{_NAME}=(?:{_QUOTED}|(?:[^,\\]++|\\.)*+)"
_SCALE = {"s": 1_000_000, "ms": 1_000, "us": 1}


def _behind(text: Column, part: Column) -> Column:
    """What follows ``part`` at the beginning of ``text``."""
    return F.substr(text, F.length(part) + 1)


def _key(pair: Column) -> Column:
    """The name before the first equals sign that is not escaped."""
    return F.when(F.contains(pair, F.lit("\\")), F.regexp_extract(pair, f"^{_NAME}", 0)).otherwise(F.substring_index(pair, "=", 1))


def parse_lines(lines: DataFrame, precision: str = "ns", column: str = "value") -> DataFrame:
    """Points of a text column.

    Blank lines, comments and lines without a measurement or a readable field are left
    out.  A missing, unreadable or overflowing time is the time of the query.
    """
    if precision not in (*_SCALE, "ns"):
        raise ValueError(f"unknown precision {precision!r}")
    # Each step cuts its part off the front, so a line is scanned about once.  What is not a
    # point is dropped in one filter behind a column that keeps the filter from being moved
    # below the steps, where it would do all of them again.
    df = lines.select(F.trim(lines[column]).alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    df = df.select("line", F.regexp_extract("line", f"^{_PART}", 0).alias("head"))
    df = df.select("head", F.ltrim(_behind(F.col("line"), F.col("head"))).alias("rest"))
    df = df.select("head", "rest", F.regexp_extract("rest", f"^{_FIELDS}", 0).alias("body"))
    df = df.select("head", "body", _behind(F.col("rest"), F.col("body")).alias("after"))
    stamp = F.trim("after")
    whole = ((F.col("after") == "") | F.col("after").startswith(" ")) & ~F.contains(stamp, F.lit(" "))
    number = stamp.try_cast("bigint")
    micros = F.expr("stamp_n div 1000") if precision == "ns" else F.expr(f"try_multiply(stamp_n, {_SCALE[precision]})")
    parts = F.when(F.contains("head", F.lit("\\")), F.split("head", r"(?<!\\),")).otherwise(F.split("head", ","))
    df = df.select(whole.alias("whole"), number.alias("stamp_n"), parts.alias("parts"), F.regexp_extract_all("body", F.lit(_PAIR), F.lit(0)).alias("pairs"))
    value = lambda x: F.substr(x, F.length(_key(x)) + 2)
    tagged = F.filter(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), lambda x: F.contains(x, F.lit("=")) & ~x.startswith("="))
    tagged = F.filter(tagged, lambda x: F.length(x) > F.length(_key(x)))
    tags = F.map_from_entries(F.transform(tagged, lambda x: F.struct(unescape(_key(x)), unescape(value(x)))))
    given = F.transform("pairs", lambda x: F.struct(unescape(_key(x)).alias("n"), F.trim(value(x)).alias("l")))
    bad = lambda t: F.right(t, F.lit(1)).isin("i", "u") & t.rlike(r"^[+-]?[\d.]") & ~t.rlike(r"^[+-]?\d++[iu]$")
    fields = F.map_from_entries(F.filter(given, lambda x: (x["l"] != "") & ~bad(x["l"])))
    out = df.select("whole", unescape(F.col("parts")[0]).alias("measurement"), F.timestamp_micros(F.coalesce(micros, F.unix_micros(F.current_timestamp()))).alias("time"), tags.alias("tags"), fields.alias("fields"), F.spark_partition_id().alias("held"))
    good = F.col("whole") & (F.col("measurement") != "") & (F.size("fields") > 0) & (F.col("held") >= 0)
    return out.filter(good).select("measurement", "time", "tags", "fields")


def read_lines(spark: SparkSession, *paths: str, precision: str = "ns") -> DataFrame:
    """Points of text files; gzip files are decompressed by Spark's codecs."""
    return parse_lines(spark.read.text(list(paths)), precision)


def render(df: DataFrame, measurement: str, tags: list[str], fields: list[str], time: str) -> DataFrame:
    """Rows as line protocol, one text column ``value``; null tags and fields are left out."""
    def esc(c, marks=", ="):
        c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
        for m in marks:
            c = F.replace(c, F.lit(m), F.lit("\\" + m))
        return c

    kinds = dict(df.dtypes)

    def literal(c):
        if kinds[c] in ("bigint", "int", "smallint", "tinyint"):
            return F.concat(F.col(c).cast("string"), F.lit("i"))
        if kinds[c] == "string":
            return F.concat(F.lit('"'), esc(F.col(c), '"'), F.lit('"'))
        return F.col(c).cast("string")

    pair = lambda c, v: F.when(F.col(c).isNotNull(), F.concat(F.lit(c + "="), v))
    head = F.concat_ws(",", F.lit(measurement), *[pair(t, esc(F.col(t).cast("string"))) for t in tags])
    body = F.concat_ws(",", *[pair(c, literal(c)) for c in fields])
    stamp = F.concat((F.unix_micros(F.col(time).cast("timestamp"))).cast("string"), F.lit("000"))
    return df.select(F.concat_ws(" ", head, body, stamp).alias("value"))
