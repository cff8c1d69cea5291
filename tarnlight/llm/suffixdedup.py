"""Repeated passages by sparse suffix arrays.

Texts are sequences of words (letters, digits and non-ASCII bytes, case folded).  Only
suffixes that start at minimisers are kept: the word k-grams with the smallest hash in
some window of ``SPAN`` neighbouring k-grams.  The choice depends on the content alone,
so a passage of ``LEAST`` words has a kept suffix within its first ``SPAN`` words,
wherever it stands, and its copies keep the same one.

1. Every kept suffix gets the hash of its first ``HEAD = LEAST - SPAN + 1`` words; equal
   heads become neighbours in one distributed sort, and lonely heads are dropped.
2. The neighbours that remain carry ``SPAN - 1`` more words to the left and to the right.
   For each split of these between the two sides the suffixes are sorted again and
   compared with their neighbours; a match is a passage of ``LEAST`` words in two
   documents.  Matches that overlap in a document join into maximal passages.

Heads with very many suffixes are not held in memory: each of their passages is a row, and
the smallest documents that hold it come from aggregates.

Cases: null, empty and short texts have no passages; rows with a null doc_id take no part
and come back with zero; rows that repeat a doc_id are one document, whose passages are
united and reported on every such row; repeats inside one document alone do not count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.llm import shared

#: Words of a passage that counts; words of a k-gram; k-grams of a minimiser's window.
LEAST, GRAM, SPAN = 50, 8, 16
HEAD = LEAST - SPAN + 1
#: Suffixes of one head that are compared in memory.
HELD = 100_000
_SIDE = SPAN - 1


class Hashed:
    """Word hashes of a column of texts, with the hashes of their heads and k-grams."""

    def __init__(self, column: pa.Array):
        words = shared.Words(column, shared.ALNUM)
        self.first, self.doc = words.first, words.doc
        self.hash = words.hash if len(words.start) else np.zeros(0, np.uint64)

    def heads(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the first words of the suffixes ``at``."""
        return shared.gram_hashes(self.hash, HEAD, at)

    def suffixes(self) -> np.ndarray:
        """Positions of the kept suffixes that have a whole head."""
        n = len(self.hash)
        if n < LEAST:
            return np.zeros(0, np.int64)
        grams = shared.gram_hashes(self.hash, GRAM)
        grams[self.doc[: n - GRAM + 1] != self.doc[GRAM - 1 :]] = np.iinfo(np.uint64).max
        low, step = grams, 1
        while step < SPAN:  # smallest of SPAN grams from each place on
            low, step = np.minimum(low[:-step], low[step:]), 2 * step
        pad = np.zeros(SPAN - 1, np.uint64)
        high, step = np.concatenate([pad, low, pad]), 1
        while step < SPAN:  # largest of these over the windows that hold a gram
            high, step = np.maximum(high[:-step], high[step:]), 2 * step
        at = np.flatnonzero(high == grams)
        return at[at + HEAD <= self.first[self.doc[at] + 1]]

    def sides(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """32-bit codes of the words before (nearest first) and after the heads; 0 for none."""
        code = np.append((self.hash >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))
        begin, end = self.first[self.doc[at]], self.first[self.doc[at] + 1]
        steps = np.arange(_SIDE)
        left = at[:, None] - 1 - steps
        right = at[:, None] + HEAD + steps
        return code[np.where(left >= begin[:, None], left, -1)], code[np.where(right < end[:, None], right, -1)]


assert SPAN & (SPAN - 1) == 0 and GRAM + SPAN - 1 <= LEAST


def head_rows(docs: DataFrame) -> DataFrame:
    """(head, doc, at): the kept suffixes; ``at`` is the word number in the document."""

    def work(stream):
        for batch in stream:
            for part in shared.slices(batch):
                h = Hashed(part.column("text"))
                at = h.suffixes()
                ids = part.column("doc").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(h.heads(at).view(np.int64)), pa.array(ids[h.doc[at]]), pa.array((at - h.first[h.doc[at]]).astype(np.int32))], ["head", "doc", "at"])

    return docs.mapInArrow(work, "head long, doc long, at int")


def neighbours(rows: DataFrame) -> DataFrame:
    """Rows whose head occurs more than once: sorted, compared with the rows beside them.

    The sort is over ranges of (head, document, place), so a head of any size fills as many
    ranges as it needs.  The first and the last row of a range may have their neighbour in
    the next one; they stay, and if they are alone they match nothing later.
    """

    def work(stream):
        last, paired = None, True  # the last row, not yet emitted; whether it has a neighbour before
        for batch in stream:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy().astype(np.int64) for c in ("head", "doc", "at")]
            if last is not None:
                cols = [np.concatenate([[x], c]) for x, c in zip(last, cols)]
            same = cols[0][1:] == cols[0][:-1]
            joined = np.concatenate([[paired], same])
            keep = joined.copy()
            keep[:-1] |= same
            paired = bool(joined[-1])
            pick = np.flatnonzero(keep[:-1])
            yield made([c[pick] for c in cols])
            last = [int(c[-1]) for c in cols]
        if last is not None:
            yield made([np.array([x], np.int64) for x in last])

    def made(cols):
        return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int32))], ["head", "doc", "at"])

    return rows.repartitionByRange("head", "doc", "at").sortWithinPartitions("head", "doc", "at").mapInArrow(work, "head long, doc long, at int")


def _with_places(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents that have rows, with the sorted word numbers of these."""
    places = shared.stored(rows.groupBy("doc").agg(F.array_sort(F.collect_set("at")).alias("places")), "places")
    weight = places.agg(F.sum(F.size("places") * 4 + 40)).first()[0] or 0
    return docs.join(F.broadcast(places) if weight <= shared.BROADCAST_BYTES else places.hint("merge"), "doc").select("doc", "text", "places")


def _at_places(part: pa.RecordBatch):
    """Hashes of a slice, the wanted suffixes that fit into their texts, and their documents."""
    h = Hashed(part.column("text"))
    flat = part.column("places")
    sizes = np.diff(flat.offsets.to_numpy())
    row = np.repeat(np.arange(part.num_rows), sizes)
    at = flat.flatten().to_numpy().astype(np.int64) + h.first[row]
    fits = at + HEAD <= h.first[row + 1]
    return h, at[fits], part.column("doc").to_numpy()[row[fits]]


def splits(head: np.ndarray, left: np.ndarray, right: np.ndarray):
    """For each split (words taken from the left): which rows have it, and its passage's code."""
    n = len(head)
    salt = np.random.default_rng(5).integers(1, 1 << 63, (2, _SIDE), dtype=np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        lsum = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(left * salt[0], axis=1, dtype=np.uint64)], axis=1)
        rsum = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(right * salt[1], axis=1, dtype=np.uint64)], axis=1)
        for o in range(SPAN):
            ok = np.ones(n, bool)
            if o:
                ok &= left[:, o - 1] != 0
            if o < _SIDE:
                ok &= right[:, _SIDE - o - 1] != 0
            yield o, ok, shared.mixed(head + shared.mixed(lsum[:, o]) * np.uint64(3) + shared.mixed(rsum[:, _SIDE - o]))


def compare(head, doc, at, left, right) -> list[np.ndarray]:
    """Rows (doc, start, end, other): passages of the given suffixes found in another document."""
    found = []
    for o, ok, code in splits(head, left, right):
        pick = np.flatnonzero(ok)
        order = pick[np.lexsort((doc[pick], code[pick]))]
        if len(order) < 2:
            continue
        c, d = code[order], doc[order]
        fresh = np.concatenate([[True], c[1:] != c[:-1]])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(c)), 0))
        end = np.append(np.flatnonzero(fresh)[1:], len(c))[np.cumsum(fresh) - 1]
        lowest, highest = d[start], d[end - 1]
        # the smallest other document: the first of the run, or for its rows the next one
        differs = np.concatenate([[False], (d[1:] != d[:-1]) & ~fresh[1:]])
        place = np.where(differs, np.arange(len(c)), len(c))
        after = np.minimum.accumulate(place[::-1])[::-1]
        second = d[np.minimum(after, len(c) - 1)]
        hit = np.flatnonzero(lowest != highest)
        if len(hit):
            begin = at[order[hit]] - o
            found.append(np.stack([d[hit], begin, begin + LEAST, np.where(d[hit] == lowest[hit], second[hit], lowest[hit])], 1))
    return found


def _joined(found: list[np.ndarray]) -> np.ndarray:
    """Overlapping or touching passages of a document become one, with the smallest other."""
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] > rows[:-1, 2])  # all have one length
    begin = np.flatnonzero(fresh)
    out = rows[begin].copy()
    out[:, 2] = rows[np.append(begin[1:], len(rows)) - 1, 2]
    out[:, 3] = np.minimum.reduceat(rows[:, 3], begin)
    return out


_FOUND = "doc long, start long, end long, other long"


def _found_batch(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[:, i].copy()) for i in range(4)], ["doc", "start", "end", "other"])


def compare_held(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Passages of suffixes whose heads have at most HELD rows."""

    def ship(stream):
        for batch in stream:
            for part in shared.slices(batch):
                h, at, doc = _at_places(part)
                for a in range(0, len(at), 50_000):
                    own, ids = at[a : a + 50_000], doc[a : a + 50_000]
                    left, right = h.sides(own)
                    raw = np.ascontiguousarray(np.concatenate([left, right], 1))
                    sides = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((np.arange(len(own) + 1) * 8 * _SIDE).astype(np.int32)), pa.py_buffer(raw)])
                    yield pa.RecordBatch.from_arrays([pa.array(h.heads(own).view(np.int64)), pa.array(ids), pa.array((own - h.first[h.doc[own]]).astype(np.int32)), sides], ["head", "doc", "at", "sides"])

    def match(stream):
        held = []
        for batch in stream:
            if not batch.num_rows:
                continue
            data, _ = shared.buffer_of(batch.column("sides"))
            cols = [batch.column("head").to_numpy().astype(np.int64), batch.column("doc").to_numpy(), batch.column("at").to_numpy().astype(np.int64), data.view(np.uint32).reshape(-1, 2 * _SIDE).copy()]
            if held:
                cols = [np.concatenate([x, c]) for x, c in zip(held, cols)]
            cut = len(cols[0]) if cols[0][0] == cols[0][-1] else int(np.searchsorted(cols[0], cols[0][-1]))
            if cols[0][0] == cols[0][-1]:
                held = cols
                continue
            held = [c[cut:] for c in cols]
            yield from work([c[:cut] for c in cols])
        if held:
            yield from work(held)

    def work(cols):
        found = compare(cols[0].view(np.uint64), cols[1], cols[2], cols[3][:, :_SIDE], cols[3][:, _SIDE:])
        if found:
            yield _found_batch(_joined(found))

    sent = _with_places(docs, rows).mapInArrow(ship, "head long, doc long, at int, sides binary")
    return sent.repartition("head").sortWithinPartitions("head").mapInArrow(match, _FOUND)


def compare_streamed(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The same for heads of any size: the two smallest documents of every passage are aggregates."""

    def ship(stream):
        for batch in stream:
            for part in shared.slices(batch):
                h, at, doc = _at_places(part)
                left, right = h.sides(at)
                base = at - h.first[h.doc[at]]
                for o, ok, code in splits(h.heads(at), left, right):
                    yield pa.RecordBatch.from_arrays([pa.array(code[ok].view(np.int64)), pa.array(doc[ok]), pa.array(base[ok] - o)], ["code", "doc", "start"])

    sent = shared.stored(_with_places(docs, rows).mapInArrow(ship, "code long, doc long, start long").distinct(), "codes")
    # both aggregates combine on the map side, and hot codes are joined by broadcast
    codes = sent.groupBy("code").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n")).filter("low < high")
    passages = shared.join_groups(sent, codes.select("code", "low", "n"), ["code"], "n")
    later = passages.filter("doc > low")
    second = later.groupBy("code").agg(F.min("doc").alias("other"))
    first = passages.filter("doc = low").join(second, "code")
    found = later.select("doc", "start", F.col("low").alias("other")).unionByName(first.select("doc", "start", "other"))
    return found.select("doc", "start", (F.col("start") + LEAST).alias("end"), "other")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, other_id): per document with repeats the maximal passages, in words.

    ``spans`` is a sorted array of (start, end), end exclusive; ``other_id`` is the
    smallest document that shares a passage with it.
    """
    shared.tune(docs.sparkSession)
    own = shared.ids_and_text(docs, id_col, text_col).withColumnRenamed("doc_id", "doc").filter("doc IS NOT NULL")
    rows = shared.stored(neighbours(shared.stored(head_rows(own), "heads")), "suffixes")
    sizes = rows.groupBy("head").agg(F.count("*").alias("n"))
    # at most two million heads can be larger than this
    most = max(HELD, rows.count() // 2_000_000)
    large = shared.stored(sizes.filter(F.col("n") > most).select("head"), "large-heads")
    if large.limit(1).count():
        found = compare_held(own, rows.join(F.broadcast(large), "head", "left_anti")).unionByName(compare_streamed(own, rows.join(F.broadcast(large), "head", "left_semi")))
    else:
        found = compare_held(own, rows)
    found = shared.stored(found, "passages")
    # passages of a document that overlap or touch are one: a passage is fresh if it begins
    # behind all that came before it
    w = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("fresh", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    runs = runs.withColumn("nth", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("doc", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other"))
    each = merged.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.min("other").alias("other_id"))
    return each.select(F.col("doc").alias("doc_id"), "spans", "other_id")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words) of every row."""

    def work(stream):
        for batch in stream:
            for part in shared.slices(batch):
                words = shared.Words(part.column("text"), shared.ALNUM)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(words.first))], ["doc_id", "n_words"])

    return shared.ids_and_text(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_words long")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_repeated (words in passages), other_id, spans."""
    found = repeated_passages(docs, id_col, text_col)
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    base = word_counts(docs, id_col, text_col)
    return base.join(found, "doc_id", "left").select("doc_id", "n_words", F.coalesce(total, F.lit(0).cast("long")).alias("n_repeated"), "other_id", F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"))
