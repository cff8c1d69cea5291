"""Line de-duplication with levelled sorted runs of line hashes.

``LineRuns`` is a small log-structured store.  Every batch of documents becomes one run,
dealt into buckets by line hash and sorted within them, of (line hash, documents, largest
document id); a level that has gathered ``fanout`` runs is compacted into one run of the
next level.  ``add`` merge-joins a new batch with the runs, bucket by bucket: what finds
no partner (the anti-join) are the first sightings, what finds one are the repeats.  A
hash is a first sighting once, so the answer is the first sightings that have repeats or
were in enough documents at once; lines that came only once are never grouped again.

Cases: a null or empty text is one empty line; rows that repeat a doc_id are one
document when counting and are each cut on their own; a null doc_id ranks below every
other id and all rows with a null id are one document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm import shared

_STRIP = b" \t\n\x0b\x0c\r"
_FOLD = bytes(shared.LOWER)
_NULL_ID = -(1 << 63)
_RUN = "h1 long, h2 long, docs long, top long, fresh boolean"


def line_key(line: bytes) -> bytes:
    return line.strip(_STRIP).translate(_FOLD)


def _long_enough(key: bytes, least: int) -> bool:
    """At least ``least`` code points: bytes that do not continue a character."""
    if len(key) < least:
        return False
    return len(key) >= 4 * least or len(key) - sum(0x80 <= b < 0xC0 for b in key) >= least


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def line_hashes(docs: DataFrame, batches: int, least: int) -> DataFrame:
    """One row (batch, h1, h2, doc) per document and distinct long line."""

    def work(stream):
        for big in stream:
            for part in shared.slices(big):
                ids, h, batch = [], [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    own = {_digest(k) for line in (text or "").encode().split(b"\n") if _long_enough(k := line_key(line), least)}
                    doc = _NULL_ID if doc is None else doc
                    ids += [doc] * len(own)
                    batch += [(doc * 0x9E3779B1 & 0xFFFFFFFF) * batches >> 32] * len(own)
                    h += own
                raw = memoryview(b"".join(h)).cast("q") if h else []
                yield pa.RecordBatch.from_arrays([pa.array(batch, pa.int32()), pa.array(raw[::2], pa.int64()), pa.array(raw[1::2], pa.int64()), pa.array(ids, pa.int64())], ["batch", "h1", "h2", "doc"])

    return docs.mapInArrow(work, "batch int, h1 long, h2 long, doc long")


class LineRuns:
    """Levelled sorted runs under one folder; every run is a table bucketed and sorted by hash."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4, buckets: int | None = None):
        self.spark, self.path, self.fanout = spark, path, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self._made = 0
        # a bucket of a run is one file, so its order is known; Spark checks that it is one
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def _read(self, names: list[str]) -> DataFrame:
        out = self.spark.createDataFrame([], _RUN) if not names else self.spark.table(names[0])
        for n in names[1:]:
            out = out.unionByName(self.spark.table(n))
        return out

    def _write(self, run: DataFrame, level: int) -> str:
        """Add a run: hash buckets, sorted by hash within each file."""
        name = f"line_run_{uuid.uuid4().hex}"
        self._made += 1
        out = run.select("h1", "h2", "docs", "top", "fresh").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        out.option("compression", "snappy").option("path", f"{self.path}/run-{self._made}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return name

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch (h1, h2, doc) as a new run, compact full levels, return the first sightings.

        The batch meets each run in a merge join on the runs' own buckets, so only the
        batch is shuffled, once.
        """
        batch = lines.distinct().groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc").alias("top"))
        fresh = F.lit(True)
        for i, name in enumerate(self.names()):
            seen = self.spark.table(name).filter("fresh").select("h1", "h2", F.lit(True).alias(f"seen{i}"))
            batch = batch.join(seen.hint("merge"), ["h1", "h2"], "left")
            fresh = fresh & F.col(f"seen{i}").isNull()
        made = self._write(batch.withColumn("fresh", fresh), 0)
        unseen = self.spark.table(made).filter("fresh").select("h1", "h2", "docs", "top")
        for k in range(64):
            if k >= len(self.levels) or len(self.levels[k]) < self.fanout:
                break
            full, self.levels[k] = self.levels[k], []
            merged = self._read(full).groupBy("h1", "h2", "fresh").agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))
            self._write(merged, k + 1)
        return unseen

    def repeated(self, least_docs: int) -> DataFrame:
        """Hashes that at least so many documents hold, with the largest such document."""
        first = self._read(self.names()).filter("fresh").select("h1", "h2", "docs", "top")
        again = self._read(self.names()).filter("NOT fresh").groupBy("h1", "h2").agg(F.sum("docs").alias("more"), F.max("top").alias("later"))
        both = first.join(again.hint("merge"), ["h1", "h2"], "left")
        total = both.select("h1", "h2", (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"), F.greatest("top", F.coalesce("later", "top")).alias("top"))
        return total.filter(F.col("docs") >= least_docs)

    def drop(self) -> None:
        """Forget the runs; their files go with the folder."""
        for name in self.names():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def dropped_lines(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """Per document the hashes of lines it must lose: ``drop_doc``, ``drops``.

    Very frequent lines are joined by broadcast, see ``shared.join_groups``.
    """
    hit = shared.join_groups(lines, repeated, ["h1", "h2"], "docs").filter("doc <> top")
    return hit.select("doc", "h1", "h2").distinct().groupBy(F.col("doc").alias("drop_doc")).agg(F.collect_list(F.struct("h1", "h2")).alias("drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, batches: int = 4, fanout: int = 4) -> DataFrame:
    """All rows and columns of ``docs`` with the kept text, plus ``n_lines`` and ``n_dropped``.

    A line whose key has ``least_chars`` code points and occurs in ``least_docs``
    documents stays only in the largest doc_id that holds it.
    """
    spark = docs.sparkSession
    shared.tune(spark)
    lines = shared.stored(line_hashes(shared.ids_and_text(docs, id_col, text_col), batches, least_chars), "lines", by=["batch"])
    store = LineRuns(spark, shared.scratch(spark, "line-runs"), fanout)
    for b in range(batches):
        store.add(lines.filter(F.col("batch") == b).select("h1", "h2", "doc"))
    repeated = shared.stored(store.repeated(least_docs), "repeated-lines")
    store.drop()
    drops = dropped_lines(lines.select("h1", "h2", "doc"), repeated)
    box = shared.boxed(docs, text_col, key=F.coalesce(shared.whole_number(docs, id_col), F.lit(_NULL_ID)))
    joined = box.join(drops, box["key"] == drops["drop_doc"], "left").select("row", "text", "drops")

    def cut(stream):
        for batch in stream:
            for part in shared.slices(batch):
                kept, n, gone = [], [], []
                drops_in = part.column("drops")
                has = drops_in.is_valid().to_pylist()
                for i, text in enumerate(part.column("text").to_pylist()):
                    if not has[i]:
                        kept.append(text)
                        n.append((text or "").count("\n") + 1)
                        gone.append(0)
                        continue
                    drop = {d["h1"].to_bytes(8, "little", signed=True) + d["h2"].to_bytes(8, "little", signed=True) for d in drops_in[i].as_py()}
                    rows = (text or "").encode().split(b"\n")
                    stay = [x for x in rows if not (_long_enough(k := line_key(x), least_chars) and _digest(k) in drop)]
                    kept.append(b"\n".join(stay).decode())
                    n.append(len(rows))
                    gone.append(len(rows) - len(stay))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], ["row", "text", "n_lines", "n_dropped"])

    out = joined.mapInArrow(cut, shared.boxed_schema(box, n_lines="long", n_dropped="long"))
    return shared.unboxed(out, docs, text_col, ["n_lines", "n_dropped"])
