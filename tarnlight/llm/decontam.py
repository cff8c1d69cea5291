"""Benchmark decontamination with a distributed positional inverted index.

Documents are indexed in segments of about two megabytes of text, wherever they lie, so
building the index moves no text.  A segment holds its distinct words and, per word, the
sorted positions over all its documents; words are looked up as they are, not by hashes.
The index is a Parquet table in the shared folder and answers any number of queries.

A phrase is looked up in each segment from its rarest terms there: the position lists
are shifted by the terms' offsets in the phrase and intersected, shortest first.  Query
texts travel to the segments in blocks of bounded size.

Ids of documents and items may be of any type.

Cases: null and empty texts have no words and are never hit; rows that repeat a doc_id
are reported one by one; a null doc_id is reported as null; benchmark rows with a null
item_id or without words are ignored, and rows that repeat an item_id are one item; empty
tables give an empty index or no hits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tarnlight.llm import shared

WINDOW = 13
#: Query text that is sent to the segments at once.
BLOCK_BYTES = 8 << 20
_SEGMENT = ["segment", "doc_ids", "first", "words", "ends", "bounds", "positions"]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the index and return it: one row per segment."""
    shared.tune(docs.sparkSession)
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    types = [pa.int64(), None, pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def work(stream):
        made = TaskContext.get().partitionId() << 32
        for batch in stream:
            for part in shared.slices(batch):
                words = shared.Words(part.column("text"), shared.ALNUM)
                terms, number = words.numbered()
                order = np.argsort(number, kind="stable")
                bounds = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(terms)))]).astype(np.uint32)
                raw, ends = shared.buffer_of(terms)
                ids = part.column("doc_id")
                row = [[made], None, [words.first.tolist()], [raw.tobytes()], [ends.astype(np.uint32).tobytes()], [bounds.tobytes()], [order.astype(np.uint32).tobytes()]]
                cols = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids) if t is None else pa.array(v, t) for v, t in zip(row, types)]
                made += 1
                yield pa.RecordBatch.from_arrays(cols, _SEGMENT)

    made = own.mapInArrow(work, f"segment long, doc_ids array<{kind}>, first array<int>, words binary, ends binary, bounds binary, positions binary")
    return shared.stored(made, "positional-index")


class Segment:
    """One row of the index, ready to be searched."""

    def __init__(self, row: dict):
        self.doc_ids, self.first = row["doc_ids"], np.array(row["first"], np.int64)
        ends = np.frombuffer(row["ends"], np.uint32).astype(np.int64)
        self.terms = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(row["words"])])
        self.bounds = np.frombuffer(row["bounds"], np.uint32)
        self.positions = np.frombuffer(row["positions"], np.uint32)

    def find(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the terms and their numbers of postings, 0 for a missing term."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        slot = pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy().astype(np.int64)
        count = self.bounds[slot + 1].astype(np.int64) - self.bounds[slot]
        return slot, np.where(slot >= 0, count, 0)

    def postings(self, slot: int) -> np.ndarray:
        return self.positions[self.bounds[slot] : self.bounds[slot + 1]].astype(np.int64)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1

    def phrase(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """First positions of a phrase whose words are ``slots``, inside one document."""
        order = np.argsort(counts, kind="stable")
        at = self.postings(slots[order[0]]) - order[0]
        for j in order[1:]:
            if not len(at):
                return at
            own = self.postings(slots[j])
            near = np.minimum(np.searchsorted(own, at + j), len(own) - 1)
            at = at[own[near] == at + j]
        at = at[at >= 0]
        return at[at + len(slots) <= self.first[self.document(at) + 1]]

    def together(self, slots: np.ndarray, counts: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """Minimal spans (start, end) of at most ``within`` words that hold every term.

        Only places near the rarest term's postings can qualify.
        """
        order = np.argsort(counts, kind="stable")
        anchor = self.postings(slots[order[0]])
        lists = [anchor]
        for j in order[1:]:
            own = self.postings(slots[j])
            lo, hi = np.searchsorted(anchor, own - within + 1), np.searchsorted(anchor, own + within - 1, side="right")
            lists.append(own[hi > lo])
            if not len(lists[-1]):
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = np.unique(np.concatenate(lists))
        begin = last.copy()
        for own in lists:
            k = np.searchsorted(own, last, side="right") - 1
            begin = np.minimum(begin, np.where(k >= 0, own[np.maximum(k, 0)], -within - 1))
        doc = self.document(last)
        ok = (last - begin < within) & (begin >= self.first[doc])
        begin, last = begin[ok], last[ok]
        tight = np.ones(len(begin), bool)
        tight[1:] = begin[1:] != begin[:-1]  # of spans with one start the first is the shortest
        return begin[tight], last[tight] + 1


@dataclass
class Block:
    """Windows of some query texts: rows of ``window`` number ``terms``, -1 pads."""

    items: list
    terms: pa.Array
    window: np.ndarray
    length: np.ndarray
    item: np.ndarray


def query_block(rows: list[tuple], n: int) -> Block:
    """Every window of ``n`` words of every (item, text); a shorter text is one window."""
    rows = [r for r in rows if r[0] is not None]
    words = shared.Words(pa.array([r[1] for r in rows], pa.string()), shared.ALNUM)
    terms, number = words.numbered()
    items = list(dict.fromkeys(r[0] for r in rows))
    place = {k: i for i, k in enumerate(items)}
    windows, length, item = [], [], []
    for d, (key, _) in enumerate(rows):
        own = number[words.first[d] : words.first[d + 1]]
        for at in range(max(1, len(own) - n + 1) if len(own) else 0):
            w = own[at : at + n]
            windows.append(np.pad(w, (0, n - len(w)), constant_values=-1))
            length.append(len(w))
            item.append(place[key])
    shape = np.array(windows, np.int64).reshape(-1, n)
    return Block(items, terms, shape, np.array(length, np.int64), np.array(item, np.int64))


def query_blocks(queries: DataFrame, n: int, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES):
    """The query texts in blocks of about ``block_bytes``, one on the driver at a time."""
    own = queries.select(queries[id_col].alias("item"), queries[text_col].cast("string").alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    for b in range(blocks):
        some = own.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else own
        yield query_block([(r["item"], r["text"]) for r in some.collect()], n)


def _search_phrases(segment: Segment, block: Block) -> list[np.ndarray]:
    """Rows (document number, item number, start, end) of all windows, in a segment."""
    slot, count = segment.find(block.terms)
    if not len(block.window):
        return []
    many = np.append(count, np.iinfo(np.int64).max)  # the last one is the padding's
    counts = many[block.window]
    found = []
    for w in np.flatnonzero(counts.min(1) > 0):
        k = block.length[w]
        at = segment.phrase(slot[block.window[w, :k]], counts[w, :k])
        if len(at):
            found.append(np.stack([segment.document(at), np.full(len(at), block.item[w]), at, at + k], 1))
    return found


def _search_together(segment: Segment, block: Block, within: int) -> list[np.ndarray]:
    """Rows as above for spans of at most ``within`` words with all words of a window."""
    slot, count = segment.find(block.terms)
    found = []
    for w in range(len(block.window)):
        own = np.unique(block.window[w, : block.length[w]])
        if count[own].min() > 0:
            start, end = segment.together(slot[own], count[own], within)
            if len(start):
                found.append(np.stack([segment.document(start), np.full(len(start), block.item[w]), start, end], 1))
    return found


def merged_spans(found: list[np.ndarray]) -> np.ndarray:
    """Overlapping or touching spans of one document and item become one."""
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    pair = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
    group = np.concatenate([[0], np.cumsum(pair)])
    far = int(rows[:, 3].max()) + 1
    reach = np.maximum.accumulate(rows[:, 3] + group * far) - group * far
    fresh[1:] = pair | (rows[1:, 2] > reach[:-1])
    begin = np.flatnonzero(fresh)
    out = rows[begin].copy()
    out[:, 3] = reach[np.append(begin[1:], len(rows)) - 1]
    return out


def matches(index: DataFrame, queries: DataFrame, n: int = WINDOW, within: int | None = None, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where query windows occur: segment, nth (document of the segment), doc_id, item_id, start, end.

    Exact phrases by default; with ``within`` also any place where all words of a window
    lie in at most that many words, in any order.  Spans are word numbers in the
    document, end exclusive; overlapping spans of an item are merged.
    """
    spark = index.sparkSession
    shared.tune(spark)
    out = None
    doc_kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    item_kind = queries.schema[id_col].dataType.simpleString()
    item_type = to_arrow_type(queries.schema[id_col].dataType)
    for block in query_blocks(queries, n, id_col, text_col, block_bytes):
        held = spark.sparkContext.broadcast(block)

        def work(stream, held=held):
            block = held.value
            for batch in stream:
                for nth, row in enumerate(batch.drop_columns(["doc_ids"]).to_pylist()):
                    segment = Segment({**row, "doc_ids": batch.column("doc_ids")[nth].values})
                    found = _search_phrases(segment, block) if within is None else _search_together(segment, block, within)
                    if not found:
                        continue
                    rows = merged_spans(found)
                    base = segment.first[rows[:, 0]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["segment"]] * len(rows), pa.int64()), pa.array(rows[:, 0].astype(np.int32)), segment.doc_ids.take(rows[:, 0]), pa.array([block.items[i] for i in rows[:, 1]], item_type), pa.array(rows[:, 2] - base), pa.array(rows[:, 3] - base)],
                        ["segment", "nth", "doc_id", "item_id", "start", "end"],
                    )

        some = index.mapInArrow(work, f"segment long, nth int, doc_id {doc_kind}, item_id {item_kind}, start long, end long")
        out = some if out is None else out.unionByName(some)
    return out


def summary(index: DataFrame, found: DataFrame) -> DataFrame:
    """Per indexed row: doc_id, n_words, n_hit (words inside matches) and items (sorted as strings)."""
    docs = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", F.slice("first", 1, F.size("doc_ids")).alias("a"), F.slice("first", 2, F.size("doc_ids")).alias("b"))).alias("nth", "d"))
    docs = docs.select("segment", "nth", F.col("d.doc_ids").alias("doc_id"), (F.col("d.b") - F.col("d.a")).cast("long").alias("n_words"))
    spans = F.array_sort(F.collect_list(F.struct("start", "end")))
    cover = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], x["end"]).alias("upto")),
        lambda a: a["n"],
    )
    hits = found.groupBy("segment", "nth").agg(spans.alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hits = hits.select("segment", "nth", cover.alias("n_hit"), "items")
    return docs.join(hits, ["segment", "nth"], "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """``summary`` of the exact phrases of ``benchmark`` in ``docs``, with the verdict."""
    index = build_index(docs)
    out = summary(index, matches(index, benchmark, n))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
