"""Points: the form in which every ingest format arrives before it becomes columns.

A point is (measurement, time, tags, fields): ``tags`` maps names to strings, ``fields``
maps names to literals in line-protocol spelling (``5i``, ``1.5``, ``true``, ``"text"``),
so one typed pivot serves all formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "measurement string, time timestamp, tags map<string,string>, fields map<string,string>"
_BOOL = r"^(?:[tT]|[tT][rR][uU][eE]|[fF]|[fF][aA][lL][sS][eE])$"
_INT, _FLOAT = r"^[+-]?\d+[iu]$", r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def kind_of(literal: Column) -> Column:
    """long, double, boolean or string."""
    return F.when(literal.rlike(_BOOL), "boolean").when(literal.rlike(_INT), "long").when(literal.rlike(_FLOAT), "double").otherwise("string")


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\([, =\"\\])", "$1")).otherwise(text)


def value_of(literal: Column, kind: str) -> Column:
    marked = F.right(literal, F.lit(1)).isin("i", "u")
    bare = F.when(marked, F.substr(literal, F.lit(1), F.length(literal) - 1)).otherwise(literal)
    if kind == "boolean":
        return F.lower(literal).isin("t", "true")
    if kind == "long":
        return F.coalesce(bare.try_cast("bigint"), bare.try_cast("double").cast("bigint"))
    if kind == "double":
        return F.when(literal.rlike(_BOOL), F.lit(None)).otherwise(bare.try_cast("double"))
    quoted = literal.startswith('"')
    return F.when(quoted, unescape(F.substr(literal, F.lit(2), F.length(literal) - F.when(literal.endswith('"') & (F.length(literal) > 1), 2).otherwise(1)))).otherwise(literal)


def layout(points: DataFrame) -> dict[str, tuple[list[str], dict[str, str]]]:
    """Per measurement its tag names and its fields' types: one aggregate over the points.

    Longs and doubles together are double; any other mix is an error.
    """
    tags = points.select("measurement", F.explode_outer(F.map_keys("tags")).alias("name"), F.lit("tag").alias("kind"))
    fields = points.select("measurement", F.explode("fields").alias("name", "literal")).select("measurement", "name", kind_of(F.col("literal")).alias("kind"))
    found: dict[str, tuple[set[str], dict[str, set[str]]]] = {}
    for r in tags.unionByName(fields).distinct().collect():
        own = found.setdefault(r["measurement"], (set(), {}))
        if r["kind"] == "tag":
            own[0].update([r["name"]] if r["name"] is not None else [])
        else:
            own[1].setdefault(r["name"], set()).add(r["kind"])
    out = {}
    for m, (names, kinds) in found.items():
        types = {}
        for name, k in kinds.items():
            if len(k) > 1 and k != {"long", "double"}:
                raise ValueError(f"{m}.{name} has values of kinds {sorted(k)}")
            types[name] = "double" if len(k) > 1 else next(iter(k))
        out[m] = (sorted(names), dict(sorted(types.items())))
    return out


def columns(points: DataFrame, measurement: str, tags: list[str], fields: dict[str, str]) -> DataFrame:
    """One measurement as ``time``, its tags and its typed fields.

    A field that bears a tag's name gets ``_value``; names that start with ``_`` are
    dropped.  Tags are marked in the column metadata.
    """
    own = points.filter(F.col("measurement") == measurement)
    cols = [F.col("time")]
    cols += [F.col("tags")[t].alias(t, metadata={"tag": True}) for t in tags if not t.startswith("_") and t != "time"]
    for name, kind in fields.items():
        if not name.startswith("_"):
            cols.append(value_of(F.col("fields")[name], kind).alias(f"{name}_value" if name in tags or name == "time" else name))
    return own.select(*cols)


def measurements(points: DataFrame) -> dict[str, DataFrame]:
    """All measurements of the points as DataFrames."""
    return {m: columns(points, m, *shape) for m, shape in layout(points).items()}


def tag_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if (f.metadata or {}).get("tag")]


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMA))
