"""Shapes of time-series queries as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions.timefns import micros_of, parse_width, time_bucket


def rollup(df: DataFrame, time: str, width: str, tags: list[str], **aggs: Column) -> DataFrame:
    """Aggregates per bucket and tags."""
    return df.groupBy(time_bucket(width, time).alias("bucket"), *tags).agg(*[c.alias(n) for n, c in aggs.items()])


def latest(df: DataFrame, keys: list[str], time: str, *tie: str) -> DataFrame:
    """The newest row per key.

    ``max_by`` combines on the map side, where a ranking window would move every row.
    """
    newest = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(time, *tie))
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(newest.alias("r")).select("r.*")


def decimate(df: DataFrame, time: str, value: str, bins: int, start: str, end: str, tags: list[str]) -> DataFrame:
    """Smallest and largest value with their times in each of ``bins`` equal bins, for plots."""
    t = micros_of(F.col(time))
    lo, hi = micros_of(F.lit(start).cast("timestamp_ntz")), micros_of(F.lit(end).cast("timestamp_ntz"))
    at = F.floor((t - lo) * bins / (hi - lo)).cast("int")
    pair = F.struct(value, time)
    return df.filter((t >= lo) & (t < hi)).groupBy(*tags, at.alias("bin")).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.min_by(time, pair).alias("t_lo"), F.max_by(time, pair).alias("t_hi"))


def zscore(df: DataFrame, keys: list[str], order: list[str], value: str, before: int, out: str = "z") -> DataFrame:
    """Distance of each value from the mean of the ``before`` rows before it, in standard deviations."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-before, -1)
    sd = F.stddev(value).over(w)
    return df.withColumn(out, F.when(sd != 0, (F.col(value) - F.avg(value).over(w)) / sd))


def sessions(df: DataFrame, keys: list[str], time: str, gap: str) -> DataFrame:
    """Session windows: rows of a key less than ``gap`` apart."""
    s = F.session_window(F.col(time), gap)
    return df.groupBy(*keys, s.alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def groups_frame(df: DataFrame, keys: list[str], order: str, value: str, before: int, out: str) -> DataFrame:
    """Sum over the rows of this and the ``before`` earlier distinct order values (a GROUPS frame)."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(order))
    w = Window.partitionBy(*keys).orderBy("__rank").rangeBetween(-before, 0)
    return df.withColumn("__rank", rank.cast("long")).withColumn(out, F.sum(value).over(w)).drop("__rank")


#: How the aggregates of two parts make that of the whole.
MERGED = {
    "count": lambda a, b: a + b,
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "min": F.least,
    "max": F.greatest,
}


def rolling(df: DataFrame, keys: list[str], time: str, before: str, **aggs: tuple[str, str]) -> DataFrame:
    """Aggregates over the time ``before`` each row and its peers (a RANGE frame), in time that does not grow with the frame.

    ``aggs`` are a column and one of avg, count, sum, min and max.  A key is cut into pieces as long as the
    frame, so a frame is the end of one piece and the beginning of the next: two running
    aggregates, merged.  Each row is copied to the piece after its own, ``before`` later,
    where it only serves the first; a key with a large share of the rows fills many tasks.
    """
    _, span = parse_width(before)
    if span <= 0:
        raise ValueError("the frame is a fixed width")
    parts = {}
    for how, value in aggs.values():
        for h in ("sum", "count") if how == "avg" else (how,):
            parts[h, value, how == "avg"] = f"__{len(parts)}"
    t = micros_of(F.col(time))
    piece = F.floor(t / F.lit(span)).cast("long")
    copies = F.when(t.isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    served = {*keys, *[value for _, value in aggs.values()]}
    spread = df.withColumn("__late", F.explode(copies)).withColumns({"__piece": piece + F.col("__late"), "__at": t + F.col("__late") * span})
    spread = spread.withColumns({c: F.when(F.col("__late") == 0, F.col(c)) for c in df.columns if c not in served})
    w = Window.partitionBy(*keys, "__piece").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sides = [(F.col("__late") == 0, w.orderBy("__at")), (F.col("__late") == 1, w.orderBy(F.desc("__at")))]

    def running(how: str, value: str, mean: bool, own: Column, over) -> Column:
        return getattr(F, how)(F.when(own, F.col(value).cast("double") if mean else F.col(value))).over(over)

    for i, (own, over) in enumerate(sides):
        spread = spread.withColumns({f"{n}_{i}": running(*part, own, over) for part, n in parts.items()})
    whole = {part: MERGED[part[0]](F.col(f"{n}_0"), F.col(f"{n}_1")) for part, n in parts.items()}
    mean = lambda v: F.when(whole["count", v, True] > 0, whole["sum", v, True] / whole["count", v, True])
    out = spread.filter("__late = 0")
    return out.select(*df.columns, *[(mean(v) if how == "avg" else whole[how, v, False]).alias(n) for n, (how, v) in aggs.items()])


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys, nulls being equal; the keys come from the left."""
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(right, on).drop(*[f"__r_{k}" for k in keys])


def rolling_rows(df: DataFrame, keys: list[str], time: str, order: list[str], before: int, split: str, **aggs) -> DataFrame:
    """Aggregates over the ``before`` rows ahead of each row (a ROWS frame), in pieces of ``split``.

    Per key and piece one count says which later pieces need which of its last rows; these
    are copied there, so each task holds one piece and ``before`` rows more.
    """
    _, size = parse_width(split)
    pieces = df.withColumn("__own", F.floor(micros_of(F.col(time)) / F.lit(size)).cast("long"))
    counts = pieces.groupBy(*keys, "__own").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__own")
    # rows up to and with each piece; the pieces after it, as far as `before` rows can reach
    counts = counts.withColumn("__upto", F.sum("__n").over(w))
    ahead = F.collect_list(F.struct(F.col("__own").alias("p"), (F.col("__upto") - F.col("__n")).alias("b"))).over(w.rowsBetween(1, before))
    counts = counts.withColumn("__ahead", F.filter(ahead, lambda x: x["b"] - F.col("__upto") < before)).drop("__n")
    joined = _join_null_safe(pieces, counts, [*keys, "__own"])
    last = F.row_number().over(Window.partitionBy(*keys, "__own").orderBy(*[F.desc(c) for c in [time, *order]]))
    targets = F.filter("__ahead", lambda x: x["b"] - F.col("__upto") + F.col("__last") <= before)
    spread = joined.withColumn("__last", last).withColumn("__piece", F.explode(F.concat(F.array("__own"), F.transform(targets, lambda x: x["p"]))))
    frame = Window.partitionBy(*keys, "__piece").orderBy(time, *order).rowsBetween(-before, -1)
    out = spread.withColumns({n: f(frame) for n, f in aggs.items()})
    return out.filter("__own = __piece").select(*df.columns, *aggs)


def percentiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], bins: int = 4096) -> DataFrame:
    """Exact continuous quantiles per key by a histogram, so that no task holds a key's values.

    The range of each key is cut into ``bins``; counts say in which bin a wanted rank lies,
    and only the rows of these bins are sorted.  Null values take no part.
    """
    if not keys:
        return percentiles(df.withColumn("__all", F.lit(0)), ["__all"], value, quantiles, bins).drop("__all")
    own = df.select(*keys, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    span = own.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    side = F.broadcast(span) if span.count() <= 1_000_000 else span
    place = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    binned = _join_null_safe(own, side, keys).select(*keys, "v", "n", F.when(F.col("hi") > F.col("lo"), place).otherwise(0).alias("bin"))
    sums = binned.groupBy(*keys, "bin").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    sums = sums.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys).orderBy("bin")))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q"), side_.alias("rank")) for name, q in quantiles.items() for side_ in (F.floor(F.lit(q) * (F.col("n") - 1)), F.ceil(F.lit(q) * (F.col("n") - 1)))])
    wanted = sums.withColumn("w", F.explode(F.array_distinct(ranks))).filter((F.col("w.rank") < F.col("upto")) & (F.col("w.rank") >= F.col("upto") - F.col("c")))
    wanted = wanted.select(*keys, "bin", "n", "w.name", "w.q", (F.col("w.rank") - (F.col("upto") - F.col("c"))).alias("nth"))
    needed = wanted.select(*keys, "bin").distinct()
    few = _join_null_safe(binned.drop("n"), needed, [*keys, "bin"])
    few = few.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "bin").orderBy("v")) - 1)
    hit = _join_null_safe(few, wanted, [*keys, "bin", "nth"])
    h = F.col("q") * (F.col("n") - 1)
    out = hit.groupBy(*keys, "name").agg((F.min("v") + (F.max("v") - F.min("v")) * F.first(h - F.floor(h))).alias("v"))
    return out.groupBy(*keys).pivot("name", list(quantiles)).agg(F.first("v"))
