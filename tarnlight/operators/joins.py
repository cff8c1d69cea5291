"""Joins that Spark SQL has no operator for: as-of, positional and range joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions.timefns import time_bucket
from tarnlight.session import work_folder


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, *, how: str = "left", direction: str = "backward", exact: bool = True, suffix: str = "_right", tolerance_us: int | None = None, tie: str | None = None, split: str | None = None) -> DataFrame:
    """Each left row with the nearest right row of its keys at or before its time.

    One shuffle on the keys: both sides are stacked and a window carries the last right
    row along.  ``direction`` "forward" takes the nearest at or after; ``exact=False``
    refuses equal times; ``tolerance_us`` bounds the distance; of right rows with one
    time the largest ``tie`` column wins.  ``how`` is "left" or "inner".  Right columns
    that clash get ``suffix``; null keys and times match nothing.

    ``split``, a width such as '1 day', cuts every key at whole widths, so that a key
    with a large share of the rows fills many tasks; the nearest right row of the earlier
    (or later) pieces is carried over, one row per key and piece.
    """
    if how not in ("left", "inner") or direction not in ("backward", "forward"):
        raise ValueError(f"{how} / {direction}")
    names = {c: c + suffix if c in left.columns else c for c in right.columns if c not in on}
    payload = F.struct(*[right[c].alias(n) for c, n in names.items()])
    keys = [F.col(k) for k in on]
    sign = 1 if direction == "backward" else -1
    before = 0 if exact else 2
    lhs = left.select(*keys, F.col(left_time).cast("timestamp_ntz").alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__tie"), F.struct(*[left[c] for c in left.columns]).alias("__l"), F.lit(None).alias("__r"))
    rhs = right.filter(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).cast("timestamp_ntz").alias("__t"), F.lit(before).alias("__side"), (F.col(tie).cast("long") if tie else F.lit(None).cast("long")).alias("__tie"), F.lit(None).alias("__l"), payload.alias("__r"))
    cuts = []
    if split:
        lhs, rhs = (x.withColumn("__cut", time_bucket(split, F.col("__t"))) for x in (lhs, rhs))
        edge = F.max_by if sign > 0 else F.min_by
        nearest = F.struct("__t", "__side", "__tie", "__r")
        pieces = lhs.select(*on, "__cut").unionByName(rhs.select(*on, "__cut")).distinct()
        rank = F.struct("__t", F.coalesce("__tie", F.lit(-(1 << 62))) * sign)
        ends = rhs.groupBy(*on, "__cut").agg(edge(nearest, rank).alias("__n"))
        by_cut = Window.partitionBy(*on).orderBy(F.col("__cut").asc() if sign > 0 else F.col("__cut").desc()).rowsBetween(Window.unboundedPreceding, -1)
        same = [pieces[k].eqNullSafe(ends[k]) for k in (*on, "__cut")]
        carried = pieces.join(ends, reduce(Column.__and__, same), "left").select(*[pieces[k] for k in (*on, "__cut")], "__n").withColumn("__n", F.last("__n", ignorenulls=True).over(by_cut))
        rhs = rhs.unionByName(carried.filter("__n IS NOT NULL").select(*on, "__cut", "__n.*", F.lit(None).alias("__l")))
        cuts = ["__cut"]
    order = [F.col("__t").asc_nulls_first() if sign > 0 else F.col("__t").desc_nulls_first(), "__side", F.col("__tie").asc_nulls_first()]
    w = Window.partitionBy(*on, *cuts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    far = lhs.unionByName(rhs).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).withColumn("__rt", F.last(F.when(F.col("__l").isNull(), F.col("__t")), ignorenulls=True).over(w))
    valid = reduce(Column.__and__, [k.isNotNull() for k in keys], F.col("__t").isNotNull())
    if tolerance_us is not None:
        gap = F.unix_micros(F.col("__t").cast("timestamp")) - F.unix_micros(F.col("__rt").cast("timestamp"))
        valid = valid & (F.abs(gap) <= tolerance_us)
    hit = F.when(valid, F.col("__r"))
    out = far.filter(F.col("__l").isNotNull()).select("__l.*", *[hit[n].alias(n) for n in names.values()], hit.isNotNull().alias("__hit"))
    return (out.filter("__hit") if how == "inner" else out).drop("__hit")


def numbered(df: DataFrame, order: list[str | Column] | None = None, name: str = "__row") -> DataFrame:
    """Rows with consecutive numbers from 0, without a single-partition window.

    The rows of each partition are counted, the counts (one per partition) are summed on
    the driver and added to the numbers within the partitions.  ``order`` sorts first;
    without it the number follows the partitions' order.  The tagged rows are written to
    the shared folder, so rows with equal order keep their numbers whatever task is lost.
    """
    spread = df.orderBy(*order) if order else df
    tagged = spread.withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id())
    path = work_folder(df.sparkSession, "numbered")
    tagged.write.parquet(path)
    tagged = df.sparkSession.read.schema(tagged.schema).parquet(path)
    counts = sorted((r["__part"], r["n"]) for r in tagged.groupBy("__part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    base = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__part int, __base long")
    low = F.col("__id") - F.shiftleft(F.col("__part").cast("long"), 33)
    return tagged.join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + low).drop("__part", "__base", "__id")


def positional_join(left: DataFrame, right: DataFrame, left_order: list[str] | None = None, right_order: list[str] | None = None) -> DataFrame:
    """Row i of the left beside row i of the right; the longer side is padded with nulls."""
    a, b = numbered(left, left_order, "__i"), numbered(right, right_order, "__j")
    return a.join(b, a["__i"] == b["__j"], "full").drop("__i", "__j")


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Left rows whose ``point`` lies in the right rows' [low, high), by bins of ``width``.

    Every right row goes to the bins it touches, so the join is an equi-join on bin and
    ``on`` instead of a nested loop.  Bins that are a fraction of the usual interval leave few
    pairs to refuse.  The merge join holds one bin's left rows and gives them anew for
    each right row: where the result is far larger than the input, it comes as runs of one
    right row beside the same left rows, which columnar files hold in a few bits a row.
    """
    keys = [*(on or []), "__bin"]
    a = left.withColumn("__bin", F.floor(F.col(point) / width))
    b = right.filter(F.col(high) > F.col(low)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    hit = (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))
    own = lambda df: [df[c] for c in df.columns if c not in keys]
    return b.join(a.hint("merge"), keys).filter(hit).select(*(on or []), *own(a), *own(b))
