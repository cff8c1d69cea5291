"""Continuous queries: rollups over windows that advance, in batches or as streams."""

from __future__ import annotations

import datetime as dt
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnlight.engine import Engine
from tarnlight.functions.timefns import parse_width
from tarnlight.operators.maintain import last_write_wins, retention, rewrite
from tarnlight.sources.catalog import Conflict
from tarnlight.sources import lineproto
from tarnlight.sources.messages import decode

_UTC = dt.timezone.utc
#: Runs of a continuous query that are kept.
HISTORY = 100


@dataclass
class ContinuousQuery:
    """A query with ``{start_time}`` and ``{end_time}`` whose result feeds a measurement.

    Windows are half-open and end at a whole ``interval``, so no bucket is written in
    part.  Rows without time get the window's start.  A rerun replaces the rows of the
    same tags and time, so it changes nothing.

    A query that was saved keeps its state beside its database, one small numbered file for
    each run: another process, or this one after a restart, goes on where the last run
    ended.  ``retention_days`` bounds the age of the destination's files,
    ``delete_source_after_days`` that of the source's, after each run.
    """

    name: str
    database: str
    source: str
    destination: str
    query: str
    interval: str
    tags: list[str] = field(default_factory=list)
    last: dt.datetime | None = None
    history: list[dict] = field(default_factory=list)
    retention_days: int | None = None
    delete_source_after_days: int | None = None
    saved: int = 0

    def __post_init__(self):
        if not re.fullmatch(r"[A-Za-z0-9_-]+", self.name):
            raise ValueError(f"not a valid name: {self.name!r}")
        for days in (self.retention_days, self.delete_source_after_days):
            if days is not None and days < 1:
                raise ValueError("days are 1 at least")
        months, micros = parse_width(self.interval)
        if months or micros < 10_000_000:
            raise ValueError("an interval is a fixed time of 10 seconds at least")
        self.width = dt.timedelta(microseconds=micros)
        for t in self.tags:
            if not re.fullmatch(r"[A-Za-z0-9_-]+", t) or t == "time":
                raise ValueError(f"not a valid tag: {t!r}")
        if "{start_time}" not in self.query or "{end_time}" not in self.query:
            raise ValueError("the query needs {start_time} and {end_time}")

    @staticmethod
    def _folder(engine: Engine, database: str, name: str = "") -> str:
        return f"{engine.catalog.root}/{database}/_continuous/{name}".rstrip("/")

    @classmethod
    def names(cls, engine: Engine, database: str) -> list[str]:
        """Saved queries of a database."""
        return engine.catalog.files.names(cls._folder(engine, database), True)

    @classmethod
    def load(cls, engine: Engine, database: str, name: str) -> ContinuousQuery:
        """A saved query with its last end and the last ``HISTORY`` runs."""
        base = cls._folder(engine, database, name)
        numbers = [n for n in engine.catalog.files.names(base, False) if n.endswith(".json")]
        if not numbers:
            raise KeyError(name)
        entries = [json.loads(engine.catalog.files.read(f"{base}/{n}")) for n in numbers[-HISTORY:]]
        stamp = lambda t: t and dt.datetime.fromisoformat(t)
        runs = [{"start": stamp(e["run"]["start"]), "end": stamp(e["run"]["end"]), "rows": e["run"]["rows"]} for e in entries if e["run"]]
        return cls(**entries[-1]["query"], last=stamp(entries[-1]["last"]), history=runs, saved=int(numbers[-1][:20]))

    def save(self, engine: Engine, run: dict | None = None) -> None:
        """Keep the definition and the state under the next number; ``Conflict`` if another process took it."""
        files, base = engine.catalog.files, self._folder(engine, self.database, self.name)
        files.make(base)
        fixed = {k: getattr(self, k) for k in ("name", "database", "source", "destination", "query", "interval", "tags", "retention_days", "delete_source_after_days")}
        show = lambda t: t and t.isoformat()
        entry = {"query": fixed, "last": show(self.last), "run": run and {"start": show(run["start"]), "end": show(run["end"]), "rows": run["rows"]}}
        if not files.claim(f"{base}/{self.saved + 1:020d}.json", json.dumps(entry)):
            raise Conflict(f"{self.name} was run by another process meanwhile; its rows are the same")
        self.saved += 1
        if self.saved > HISTORY:
            files.remove(f"{base}/{self.saved - HISTORY:020d}.json")

    def window(self, now: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
        zero = dt.datetime(1970, 1, 1, tzinfo=_UTC)
        end = now - (now - zero) % self.width
        start = self.last or end - max(self.width, dt.timedelta(hours=1))
        return start, max(start, end)

    def text(self, start: dt.datetime, end: dt.datetime) -> str:
        show = lambda t: t.astimezone(_UTC).strftime("%Y-%m-%dT%H:%M:%S.%f").rstrip("0").rstrip(".")
        return self.query.replace("{start_time}", show(start)).replace("{end_time}", show(end))

    def run(self, engine: Engine, start: dt.datetime | None = None, end: dt.datetime | None = None, now: dt.datetime | None = None, dry_run: bool = False) -> dict:
        now = now or dt.datetime.now(_UTC)
        begin, finish = self.window(now)
        begin, finish = start or begin, end or finish
        text = self.text(begin, finish)
        if dry_run:
            return {"query": text, "start": begin, "end": finish, "dry_run": True}
        if begin >= finish:
            return {"query": text, "rows": 0, "start": begin, "end": finish}
        out = stamped(engine.sql(text, self.database) if "." not in self.source else engine.sql(text), begin)
        rows = upsert(engine, out, self.database, self.destination, [t for t in self.tags if t in out.columns])
        if start is None:
            self.last = finish
        self.history = [*self.history, {"start": begin, "end": finish, "rows": rows}][-HISTORY:]
        if self.saved:
            self.save(engine, self.history[-1])
        micros = int(now.timestamp() * 1e6)
        if self.retention_days:
            retention(engine.catalog, self.database, self.destination, self.retention_days, 0, micros)
        if self.delete_source_after_days:
            database, _, measurement = self.source.rpartition(".")
            retention(engine.catalog, database or self.database, measurement, self.delete_source_after_days, 0, micros)
        return {"query": text, "rows": rows, "start": begin, "end": finish}


def stamped(df: DataFrame, start: dt.datetime) -> DataFrame:
    """Rows with a ``time``: their own, or the window's start."""
    return df.withColumn("time", F.col("time").cast("timestamp")) if "time" in df.columns else df.withColumn("time", F.lit(start))


def upsert(engine: Engine, df: DataFrame, database: str, measurement: str, tags: list[str]) -> int:
    """Add rows; those of the same tags and time replace what is there.

    Only files whose time range meets the new rows are rewritten.
    """
    df = df.persist()
    try:
        span = df.agg(F.count("*").alias("n"), F.min(F.unix_micros("time")).alias("lo"), F.max(F.unix_micros("time")).alias("hi")).first()
        if not span["n"]:
            return 0
        for _ in range(8):  # another writer may replace the same files meanwhile
            manifest = engine.catalog.manifest(database, measurement)
            known, guard = manifest["files"], (manifest["version"], span["lo"], span["hi"])
            near = sorted(p for p, f in known.items() if f["min"] is not None and f["min"] <= span["hi"] and f["max"] >= span["lo"])
            new = df.withColumn("__seq", F.lit(None).cast("long"))
            try:
                if near:
                    last = F.coalesce(F.col("__seq"), F.lit((1 << 63) - 1))
                    rewrite(engine.catalog, database, measurement, near, lambda old, new=new, last=last: last_write_wins(new.unionByName(old, allowMissingColumns=True), [*tags, "time"], [last]), tags, guard)
                else:
                    engine.catalog.write(last_write_wins(new, [*tags, "time"], [F.lit(1)]), database, measurement, tags=tags, guard=guard)
                break
            except Conflict:
                continue
        else:
            raise Conflict(f"{database}.{measurement} changes all the time")
        engine.catalog.vacuum(database, measurement)
        return span["n"]
    finally:
        df.unpersist()


def rollup_stream(stream: DataFrame, time: str, width: str, tags: list[str], aggs: dict, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Windowed aggregates of a stream: rows later than ``late`` behind the newest are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = stream.withWatermark(time, late).groupBy(w.alias("w"), *tags).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(F.col("w.start").alias("time"), *tags, *aggs)


def start_stream(engine: Engine, rollup: DataFrame, database: str, measurement: str, tags: list[str], checkpoint: str, every: str | None = None, mode: str = "update"):
    """Keep a measurement in step with a rollup stream; a repeated micro-batch changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        upsert(engine, batch, database, measurement, tags)

    writer = rollup.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ingest_stream(engine: Engine, points: DataFrame, database: str, checkpoint: str, every: str | None = "5 seconds"):
    """Write a stream of points (see ``sources.points``); a batch that comes twice is written once.

    The checkpoint's path names the stream in the manifests of the measurements.
    """

    def put(batch: DataFrame, number: int) -> None:
        engine._write_points(batch, database, (checkpoint, number))

    writer = points.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def line_stream(spark: SparkSession, path: str, precision: str = "ns", most_files: int | None = None, most_bytes: str | None = None) -> DataFrame:
    """Points of text files as they come in; a micro-batch takes so many files or bytes at most."""
    reader = spark.readStream
    for name, value in (("maxFilesPerTrigger", most_files), ("maxBytesPerTrigger", most_bytes)):
        if value is not None:
            reader = reader.option(name, value)
    return lineproto.parse_lines(reader.text(path), precision)


def change_stream(stream: DataFrame, time: str, value: str, keys: list[str], forget: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows whose value differs from the key's row before: (keys, time, value, previous).

    The last value of a key is kept as state between micro-batches and forgotten when the
    key was silent for ``forget`` of event time; within a batch rows count by time.
    """
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    fields = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"{time} {kinds[time]}", f"{value} double", "previous double"])
    _, gap = parse_width(forget)

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        last = state.get[0] if state.exists else None
        before = rows[value].shift(1)
        before.iloc[0] = last
        changed = rows[value].ne(before) | before.isna()
        state.update((float(rows[value].iloc[-1]),))
        state.setTimeoutTimestamp(max(int(rows[time].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + gap // 1000 + 1)
        out = pd.DataFrame({time: rows[time][changed], value: rows[value][changed].astype(float), "previous": before[changed].astype(float)})
        for k, v in reversed(list(zip(keys, key))):
            out.insert(0, k, v)
        yield out

    own = stream.select(*keys, time, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    return own.groupBy(*keys).applyInPandasWithState(step, fields, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def session_stream(stream: DataFrame, time: str, gap: str, tags: list[str], late: str = "10 minutes") -> DataFrame:
    """Sessions of a stream: rows of the same tags less than ``gap`` apart.

    Rows go to their tags' partition first, so no task holds the sessions of a whole
    part of a file, and a session is made only once.
    """
    rows = stream.withWatermark(time, late)
    rows = rows.repartition(*tags) if tags else rows
    out = rows.groupBy(F.session_window(time, gap).alias("w"), *tags).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *tags, "n")


def topic_pattern(filter_: str) -> str:
    """A topic filter as a regular expression: ``+`` is one level, a last ``#`` is the rest."""
    levels = filter_.split("/")
    if "#" in levels[:-1] or any("#" in x and x != "#" or "+" in x and x != "+" for x in levels):
        raise ValueError(f"not a valid topic filter: {filter_!r}")
    out = "/".join("[^/]*" if x == "+" else re.escape(x) for x in levels if x != "#")
    return f"^{out}(?:/.*)?$" if levels[-1] == "#" and len(levels) > 1 else "^.*$" if levels == ["#"] else f"^{out}$"


def topic_database(topic: Column, databases: dict[str, str], default: str) -> Column:
    """The database of a topic: the first filter that fits, else the default."""
    out = F.lit(default)
    for filter_, database in reversed(list(databases.items())):
        out = F.when(topic.rlike(topic_pattern(filter_)), database).otherwise(out)
    return out


def message_stream(engine: Engine, messages: DataFrame, databases: dict[str, str], checkpoint: str, default: str = "default", every: str | None = "5 seconds"):
    """Write a stream of (topic, value) messages, MessagePack or JSON, to the topics' databases."""
    names = sorted({*databases.values(), default})

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("__database", topic_database(F.col("topic"), databases, default)).persist()
        try:
            for name in names:
                engine._write_points(decode(batch.filter(F.col("__database") == name), form="auto"), name, (checkpoint, number))
        finally:
            batch.unpersist()

    writer = messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
