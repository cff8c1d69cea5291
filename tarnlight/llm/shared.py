"""Pieces that several corpus operators use: scratch tables, id joins, byte work.

The numpy helpers treat a column of texts as one byte buffer with offsets, so a
batch of documents is tokenised and hashed without a Python object per word.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import hashlib
import os
import shutil
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that the numpy helpers take at once; their scratch is about 40 times that.
SLICE_BYTES = 1 << 20
#: Largest table, in bytes, that an operator broadcasts after counting it.
BROADCAST_BYTES = 32 << 20


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts cannot pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


#: Folders of tables that a running program may still read, innermost scope last.
_scopes: list[str] = []


@functools.lru_cache(maxsize=1)
def _own_root() -> str:
    """A folder for local sessions without a shared one; it goes when the process ends."""
    root = f"/tmp/tarnlight-scratch-{os.getpid()}"
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _own_root()
    return root.rstrip("/")


@functools.lru_cache(maxsize=8)
def _home(root: str, application: str) -> str:
    """This program's folder in the shared one; ``release`` removes it when the program ends."""
    atexit.register(release)
    return f"{root}/tarnlight-{application}-{uuid.uuid4().hex[:8]}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table or folder, wherever it is stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Delete all intermediate tables of this program; results not yet read are lost.

    Runs by itself when the program ends; long-lived sessions may call it between jobs.
    """
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    try:
        remove(spark, _home(_root(spark), spark.sparkContext.applicationId))
    except Exception:  # the session is going down: what is left is only scratch
        return


@contextlib.contextmanager
def workspace(spark: SparkSession):
    """Intermediate tables made inside are deleted at the end: write the result elsewhere before."""
    path = scratch(spark, "work")
    _scopes.append(path)
    try:
        yield path
    finally:
        _scopes.remove(path)
        remove(spark, path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    inside = _scopes[-1] if _scopes else _home(_root(spark), spark.sparkContext.applicationId)
    return f"{inside}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *, by: list[str] | None = None, at: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here."""
    path = at or scratch(df.sparkSession, name)
    writer = df.write.mode("error").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_number(df: DataFrame, column: str) -> F.Column:
    """An id column as long; ids of other kinds are refused, not turned into nulls."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{column} must hold whole numbers, not {kind.simpleString()}")
    return df[column].cast("long")


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names, so others cannot clash."""
    return docs.select(whole_number(docs, id_col).alias("doc_id"), docs[text_col].cast("string").alias("text"))


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents whose id is not among ``ids`` (one non-null long column ``drop_id``).

    The ids are broadcast only when counting shows that they fit in
    ``BROADCAST_BYTES``; beyond that the join shuffles.  Null ids stay.
    """
    small = ids.count() * 16 <= BROADCAST_BYTES
    side = F.broadcast(ids) if small else ids.hint("shuffle_merge")
    return docs.join(side, docs[id_col].cast("long") == side["drop_id"], "left_anti")


def boxed(docs: DataFrame, text_col: str, **more: F.Column) -> DataFrame:
    """(row, text, *more): the other columns travel in one struct, so no name can clash."""
    others = [docs[f"`{c}`"].alias(c) for c in docs.columns if c != text_col]
    return docs.select(F.struct(*(others or [F.lit(0).alias("none")])).alias("row"), docs[f"`{text_col}`"].cast("string").alias("text"), *[c.alias(n) for n, c in more.items()])


def unboxed(out: DataFrame, docs: DataFrame, text_col: str, added: list[str]) -> DataFrame:
    """The columns of ``docs`` in their order, the text from ``out``, then the ``added`` ones.

    A column of the input that is named like an added one comes back as ``<name>_input``.
    """
    taken, cols = {n.lower() for n in added}, []
    every = taken | {c.lower() for c in docs.columns}
    for c in docs.columns:
        name = c
        while name.lower() in taken or (name != c and name.lower() in every):
            name += "_input"
        kind = docs.schema[c].dataType
        cols.append((F.col("text").cast(kind) if c == text_col else F.col("row").getField(c)).alias(name))
    return out.select(*cols, *added)


def boxed_schema(box: DataFrame, **fields: str) -> T.StructType:
    """``row`` and ``text`` of a box with more fields."""
    out = T.StructType([box.schema["row"], box.schema["text"]])
    for name, kind in fields.items():
        out = out.add(name, T.DataType.fromDDL(kind))
    return out


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str) -> DataFrame:
    """Join rows with one row per group, safe for groups of any size.

    ``size_col`` of ``groups`` counts the rows of each.  Groups with more than a ten-thousandth of all rows, and a thousand at least, number
    ten thousand at most: they are broadcast, and the shuffle join gets neither them nor
    their rows, so it has no key that a task can drown in.
    """
    sizes = groups.agg(F.sum(size_col).alias("all"), F.max(size_col).alias("most")).first()
    hot_from = max(1_000, (sizes["all"] or 0) // 10_000)
    if (sizes["most"] or 0) <= hot_from:
        return rows.join(groups.drop(size_col), keys)
    hot, cold = groups.filter(F.col(size_col) > hot_from).drop(size_col), groups.filter(F.col(size_col) <= hot_from).drop(size_col)
    mild = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(mild.join(cold, keys))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary Arrow array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """Cut a batch into runs of rows of about ``most`` bytes of text; a longer text is alone."""
    if batch.num_rows == 0:
        return
    _, offs = buffer_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offs, offs[at] + most, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def class_table(separators: str) -> np.ndarray:
    """True for the bytes that belong to words; ``separators`` lists the others."""
    word = np.ones(256, bool)
    word[[ord(c) for c in separators]] = False
    return word


#: Lower-cases A-Z and leaves every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of letters, digits and non-ASCII bytes; everything else of ASCII separates.
ALNUM = class_table("".join(chr(i) for i in range(128) if not (48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122)))
#: Words between ASCII white space.
SPACED = class_table(" \t\n\x0b\x0c\r")

#: Bytes of a word that are hashed eight at a time; longer words go through BLAKE2b.
_HASHED = 64
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of a buffer that has eight more bytes behind the last span.

    Two lanes take every eight bytes through different nonlinear steps, so what makes one
    lane collide does not make the other; words over ``_HASHED`` bytes go through BLAKE2b.
    """
    size = end - start
    words = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        one = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        two = ~one
        live = np.arange(len(size))
        for j in range(0, _HASHED, 8):
            if j:
                live = live[size[live] > j]
            if not len(live):
                break
            block = words[start[live] + j] & _MASKS[np.minimum(size[live] - j, 8)]
            one[live] = mixed(one[live] ^ block)
            two[live] = mixed(two[live] * np.uint64(0xD1342543DE82EF95) + (block << np.uint64(32) | block >> np.uint64(32)))
        out = mixed(one + two * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(size > _HASHED):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class Words:
    """Words of a column of texts: byte spans, document numbers and 64-bit hashes.

    ``start``/``end`` index the joined buffer, ``doc`` is the row in the column and
    ``first[d]:first[d + 1]`` are the words of row ``d``.  Words fold A-Z to a-z.
    """

    def __init__(self, column: pa.Array, word: np.ndarray):
        data, offs = buffer_of(column)
        self.data, self.offs, n = data, offs, len(data)
        rows = len(offs) - 1
        if n == 0:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.first = np.zeros(rows + 1, np.int64)
            return
        inside = word[data]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        before[offs[:-1][offs[:-1] < n]] = False
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        after[offs[1:][offs[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offs)
        self.doc = np.repeat(np.arange(rows), np.diff(self.first))

    @functools.cached_property
    def hash(self) -> np.ndarray:
        low = np.zeros(len(self.data) + 8, np.uint8)
        low[: len(self.data)] = LOWER[self.data]
        return byte_hashes(low, self.start, self.end)

    def numbered(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words, folded, and for each word its place among them."""
        size = self.end - self.start
        ends = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        step = np.ones(int(ends[-1]), np.int64)
        if len(size):
            step[0] = self.start[0]
            step[ends[1:-1]] = self.start[1:] - self.end[:-1] + 1
        raw = LOWER[self.data[np.cumsum(step)]]
        each = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
        return each.dictionary, each.indices.to_numpy()


def gram_hashes(h: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the k-grams of consecutive word hashes: of all, or of those that begin ``at``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    salt = np.random.default_rng(77).integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1)
    out = np.zeros(n if at is None else len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out += (h[i : i + n] if at is None else h[at + i]) * salt[i]
    return mixed(out)
