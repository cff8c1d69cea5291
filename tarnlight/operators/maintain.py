"""Keeping measurements healthy: compaction, retention, deletes, tiers, snapshots."""

from __future__ import annotations

import bisect
import time as clock
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlight.plans.validate import check_predicate
from tarnlight.sources.catalog import Catalog

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Rows that a delete may take unconfirmed.
MOST_ROWS = 1_000_000


def normalised_time(df: DataFrame, column: str = "time") -> DataFrame:
    """``column`` as an instant, whether it holds instants, text or microseconds."""
    c = F.col(column)
    kind = dict(df.dtypes)[column]
    if kind in ("timestamp", "timestamp_ntz"):
        return df.withColumn(column, c.cast("timestamp"))
    if kind in ("bigint", "int"):
        return df.withColumn(column, F.timestamp_micros(c.cast("bigint")))
    text = c.cast("string")
    return df.withColumn(column, F.coalesce(text.try_cast("timestamp"), F.timestamp_micros(text.try_cast("bigint"))))


def last_write_wins(df: DataFrame, keys: list[str], sequence: list[str | Column]) -> DataFrame:
    """One row per key: the one that the sequence puts last.

    A key that many rows share is reduced before the shuffle, as ``max_by`` combines on
    the map side; null keys are equal.
    """
    order = F.struct(*[F.col(s) if isinstance(s, str) else s for s in sequence])
    newest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order)
    return df.groupBy(*[F.col(f"`{k}`").alias(f"__{i}") for i, k in enumerate(keys)]).agg(newest.alias("r")).select("r.*")


def candidates(catalog: Catalog, database: str, measurement: str, tier: str = "hourly", now: int | None = None, least_files: int | None = None) -> list[dict]:
    """Partitions worth compacting.

    hourly: hours at least an hour old with 10 files, counting again only when 10 are
    new.  daily: days at least a day old with 12 hour files; a day with a file younger
    than an hour waits until it is a week old.
    """
    now = int(clock.time() * 1e6) if now is None else now
    width, age, least = (HOUR, HOUR, 10) if tier == "hourly" else (DAY, DAY, 12)
    least = least_files or least
    groups: dict[int, list[tuple[str, dict]]] = defaultdict(list)
    for p, f in catalog.manifest(database, measurement)["files"].items():
        if f["min"] is not None and f["tier"] == "hot":
            groups[f["min"] // width].append((p, f))
    out = []
    for at, files in sorted(groups.items()):
        fresh = [(p, f) for p, f in files if f["level"] == "hour"] if tier == "daily" else [(p, f) for p, f in files if not f.get("compacted")]
        if now - (at + 1) * width < age or len(fresh) < least:
            continue
        if tier == "daily" and now - (at + 1) * width < 7 * DAY and any(now - f["made"] * 1_000_000 < HOUR for _, f in files):
            continue
        out.append({"partition": at * width, "files": sorted(p for p, _ in files)})
    return out


def compact(catalog: Catalog, database: str, measurement: str, files: list[str], tier: str = "hourly", dedup: bool | None = None, sort: tuple[str, ...] = ()) -> dict:
    """Rewrite files as few, sorted and dense ones; see ``compact_all``."""
    return compact_all(catalog, database, measurement, [{"partition": 0, "files": files}], tier, dedup, sort)[0]


def compact_all(catalog: Catalog, database: str, measurement: str, found: list[dict], tier: str = "hourly", dedup: bool | None = None, sort: tuple[str, ...] = ()) -> list[dict]:
    """Rewrite the files of candidates as few, sorted and dense ones; with tags, the last write per (tags, time) stays.

    The survivor has the highest write sequence, then file and position.  One job rewrites
    all candidates, however many hours they are, and one commit takes the old files out and
    the new ones in; new files keep the highest sequence of their candidate's old ones, so a
    write that came in meanwhile still wins.  Old files are deleted when ``catalog.vacuum``
    finds their grace time over.  Files without time are left alone.
    """
    if not found:
        return []
    known = catalog.manifest(database, measurement)
    tags = known["tags"]
    dedup = bool(tags) if dedup is None else dedup
    files = [p for c in found for p in c["files"]]
    df = catalog.read(files, (F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__pos")))
    if "time" not in df.columns:
        return [{"skipped": "no time column", "files": len(c["files"])} for c in found]
    seq = lambda p: int(known["files"][p]["seq"])
    newest = [max(map(seq, c["files"])) for c in found]
    side = catalog.spark.createDataFrame([(tail(p), seq(p), n) for c, n in zip(found, newest) for p in c["files"]], "__tail string, __seq long, __newest long")
    place = F.regexp_extract(F.col("__file"), r"/batch=(.*)$", 1)
    df = normalised_time(df).filter("time IS NOT NULL").withColumn("__tail", F.when(place != "", place).otherwise(F.col("__file"))).join(F.broadcast(side), "__tail")
    if dedup:
        keys = [t for t in tags if t in df.columns] + ["time"]
        df = last_write_wins(df, keys, ["__seq", "__file", "__block", "__pos"])
    names = [c for c in df.columns if not c.startswith("__")]
    new = catalog.write(df.select(*names, F.col("__newest").alias("__seq")), database, measurement, sort=sort, compression="zstd", level="day" if tier == "daily" else "hour", replace=files, tags=[], sequence="__seq", compacted=True)
    catalog.vacuum(database, measurement)
    # a new file is its hour's candidate's; rows of an hour that is none came from the one before
    starts = sorted((c["partition"], i) for i, c in enumerate(found))
    made: dict[int, list[dict]] = defaultdict(list)
    for f in new["files"].values():
        if f["commit"] == new["mine"]:
            made[starts[max(bisect.bisect_right(starts, (f["min"] or 0, len(found))) - 1, 0)][1]].append(f)
    return [{"files_before": len(c["files"]), "files_after": len(made[i]), "rows_before": sum(known["files"][p]["rows"] for p in c["files"]), "rows_after": sum(f["rows"] for f in made[i])} for i, c in enumerate(found)]


def tail(path: str) -> str:
    """A file's place below its measurement, the same in every spelling of the path."""
    return path.split("/batch=", 1)[1] if "/batch=" in path else path


def retention(catalog: Catalog, database: str, measurement: str, days: int, buffer_days: int = 7, now: int | None = None, dry_run: bool = False) -> dict:
    """Remove whole files whose newest row is older than ``days + buffer_days``."""
    now = int(clock.time() * 1e6) if now is None else now
    cutoff = now - (days + buffer_days) * DAY
    known = catalog.manifest(database, measurement)
    old = [p for p, f in known["files"].items() if f["max"] is not None and f["max"] < cutoff]
    report = {"files": len(old), "rows": sum(known["files"][p]["rows"] for p in old), "cutoff": cutoff, "dry_run": dry_run}
    if old and not dry_run:
        catalog.commit(database, measurement, remove=old)
        catalog.vacuum(database, measurement)
    return report


def delete_where(catalog: Catalog, database: str, measurement: str, predicate: str, dry_run: bool = False, confirm: bool = False, most_rows: int | None = None) -> dict:
    """Delete the rows for which the predicate is true; null is not true.

    Only files that hold such rows are rewritten, and the rows that stay keep their
    sequence.  A predicate that holds for every row needs ``confirm``, and so do more than
    ``MOST_ROWS`` rows; a confirmed delete takes any number unless ``most_rows`` says less.
    """
    known = catalog.manifest(database, measurement)
    if not predicate.strip():
        raise ValueError("a predicate is required")
    check_predicate(catalog.spark, predicate)
    df = catalog.scan(database, measurement)
    if df is None:
        return {"rows": 0, "files": 0, "dry_run": dry_run}
    hit = F.coalesce(F.expr(predicate), F.lit(False))
    df = catalog.read(sorted(known["files"]), (F.col("_metadata.file_path").alias("__file"),)) if known["files"] else df.withColumn("__file", F.lit(None).cast("string"))
    counts = df.groupBy(F.col("__file").alias("f")).agg(F.count("*").alias("n"), F.count_if(hit).alias("k")).filter("k > 0").collect()
    by_tail = {tail(p): p for p in known["files"]}
    touched = {by_tail[tail(r["f"])]: (r["n"], r["k"]) for r in counts}
    rows = sum(k for _, k in touched.values())
    if rows and rows == sum(f["rows"] for f in known["files"].values()) and not confirm and not dry_run:
        raise ValueError("the predicate holds for every row; confirm to go on")
    most = MOST_ROWS if most_rows is None and not confirm else most_rows
    if most is not None and rows > most and not dry_run:
        raise ValueError(f"{rows} rows are more than the limit of {most}" + ("; confirm to go on" if most_rows is None else ""))
    report = {"rows": rows, "files": len(touched), "dry_run": dry_run}
    if dry_run or not rows:
        return report
    rewrite(catalog, database, measurement, sorted(touched), lambda old: old.filter(~hit))
    catalog.vacuum(database, measurement)
    return report


def rewrite(catalog: Catalog, database: str, measurement: str, files: list[str], change, tags: list[str] = (), guard: tuple[int, int, int] | None = None) -> dict:
    """Replace files by what ``change`` makes of their rows; rows with their ``__seq`` keep it."""
    known = catalog.manifest(database, measurement)["files"]
    seqs = catalog.spark.createDataFrame([(tail(p), int(known[p]["seq"])) for p in files], "__tail string, __seq long")
    old = catalog.read(files, (F.col("_metadata.file_path").alias("__file"),))
    old = old.withColumn("__tail", F.when(F.col("__file").contains("/batch="), F.regexp_extract("__file", r"/batch=(.*)$", 1)).otherwise(F.col("__file")))
    old = old.join(F.broadcast(seqs), "__tail").drop("__file", "__tail")
    level = "day" if all(known[p]["level"] == "day" for p in files) else "hour"
    return catalog.write(change(old), database, measurement, level=level, replace=files, tags=list(tags), sequence="__seq", guard=guard)


def migrate(catalog: Catalog, database: str, measurement: str, older_than_days: int, now: int | None = None) -> int:
    """Move day files that are older than the limit to the cold root; returns how many."""
    if not catalog.cold:
        raise ValueError("the catalog has no cold root")
    now = int(clock.time() * 1e6) if now is None else now
    known = catalog.manifest(database, measurement)
    old = [p for p, f in known["files"].items() if f["level"] == "day" and f["tier"] == "hot" and f["max"] is not None and f["max"] < now - older_than_days * DAY]
    cold = catalog.path(database, measurement, cold=True)
    add = {}
    for p in old:
        rest = p.split(f"/{database}/{measurement}/", 1)[1]
        copy(catalog, p, f"{cold}/{rest}")
        add[f"{cold}/{rest}"] = known["files"][p] | {"tier": "cold"}
    if old:
        catalog.commit(database, measurement, add, old)
        catalog.vacuum(database, measurement)
    return len(old)


def copy(catalog: Catalog, source: str, target: str) -> None:
    f = catalog.files
    (fs, a), (ft, b) = f._at(source), f._at(target)
    ft.mkdirs(b.getParent())
    f.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, ft, b, False, True, f.conf)


def snapshot(catalog: Catalog, database: str, target: str) -> dict:
    """Copy a database's live files and manifests; returns counts."""
    files = rows = 0
    for m in catalog.measurements(database):
        known = catalog.manifest(database, m)
        moved = {}
        for p, f in known["files"].items():
            to = f"{target.rstrip('/')}/{database}/{m}/" + p.split(f"/{database}/{m}/", 1)[1]
            copy(catalog, p, to)
            moved[to] = f | {"tier": "hot"}
            files, rows = files + 1, rows + f["rows"]
        Catalog(catalog.spark, target).commit(database, m, moved, tags=known["tags"], columns=known["columns"])
    return {"files": files, "rows": rows}


def restore(catalog: Catalog, source: str, database: str) -> dict:
    """Bring a snapshot's database back, in place of what is there."""
    other = Catalog(catalog.spark, source)
    catalog.drop_database(database)
    catalog.create_database(database)
    return snapshot(other, database, catalog.root)
