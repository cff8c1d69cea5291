"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a byte context tree up to ``order`` bytes deep.  A symbol is coded in
the longest context that has seen it; every longer context that has not pays its escape
(method C: ``q / (n + q)`` for n symbols of q kinds), and below order 0 all bytes are
equal.  The statistics are frozen after training, so the code length of a text is a sum
over its grams, and a text gets the language that codes it in the fewest bits.

The trees of all languages are compiled into one table per order: a gram that any
language has seen maps to its final code length in every language, escapes included.
Texts are scored whole, with numpy, in slices.

Cases: a null text, or one without any letter, is ``und`` with score 0; so is every text
when nothing could be learned; a null doc_id is never used for training; ties go to the
first language in alphabetical order; repeated rows are predicted one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.llm import shared

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def packed_grams(data: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text its (order + 1)-gram as one integer, and text starts.

    A text is preceded by ``order`` NUL bytes.
    """
    n, rows = len(data), len(offs) - 1
    wide = np.zeros(n + rows * order, np.uint8)
    at = np.arange(n) + np.repeat(np.arange(1, rows + 1) * order, np.diff(offs))
    wide[at] = data
    key = np.zeros(n, np.uint64)
    for back in range(order, -1, -1):
        key = (key << np.uint64(8)) | wide[at - back].astype(np.uint64)
    return key, offs[:-1]


class KeyTable:
    """Open addressing from 64-bit keys to row numbers, built and read with numpy."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.mask = size - 1
        self.key, self.row = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left, slot, self.probes = np.arange(len(keys), dtype=np.int32), self._slot(keys), 0
        while len(left):
            self.probes += 1
            free = self.row[slot] < 0
            put = slot[free]
            self.row[put] = left[free]  # of several for one slot the last stays
            won = self.row[slot] == left
            self.key[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where a key is missing."""
        slot = self._slot(keys)
        out = self.row[slot]
        odd = np.flatnonzero((self.key[slot] != keys) & (out >= 0))
        out[odd] = -1
        slot = slot[odd]
        for _ in range(self.probes):
            if not len(odd):
                break
            slot = (slot + 1) & self.mask
            row = self.row[slot]
            hit = (row >= 0) & (self.key[slot] == keys[odd])
            out[odd[hit]] = row[hit]
            go = (row >= 0) & ~hit
            odd, slot = odd[go], slot[go]
        return out


def gram_counts(texts: list[bytes], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per order 0..order: the distinct grams of a language's texts and their counts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    key, _ = packed_grams(data, offs, order)
    out = []
    for d in range(order + 1):
        k = key & np.uint64((1 << 8 * (d + 1)) - 1)
        out.append(np.unique(k, return_counts=True))
    return out


class PpmModel:
    """The compiled trees of several languages."""

    def __init__(self, langs: list[str], counts: list[list[tuple[np.ndarray, np.ndarray]]], order: int):
        self.langs, self.order = langs, order
        width = len(langs)
        self.symbol, self.cost, self.context, self.escape = [], [], [], []
        below_keys, below = np.zeros(0, np.uint64), None
        for d in range(order + 1):
            keys = np.unique(np.concatenate([c[d][0] for c in counts])) if counts else np.zeros(0, np.uint64)
            contexts = np.unique(keys >> np.uint64(8))
            cost, escape = np.zeros((len(keys), width)), np.zeros((len(contexts), width))
            of = np.searchsorted(contexts, keys >> np.uint64(8))
            lower = keys & np.uint64((1 << 8 * d) - 1) if d else None
            for i in range(width):
                own, n = counts[i][d]
                ctx = np.searchsorted(contexts, own >> np.uint64(8))
                total = np.bincount(ctx, n, len(contexts))
                kinds = np.bincount(ctx, minlength=len(contexts))
                seen = total > 0
                escape[seen, i] = np.log2((total + kinds)[seen] / kinds[seen])
                fall = below[np.searchsorted(below_keys, lower), i] if d else 8.0
                cost[:, i] = escape[of, i] + fall
                at = np.searchsorted(keys, own)
                cost[at, i] = np.log2((total + kinds)[ctx] / n)
            below_keys, below = keys, cost
            self.symbol.append(KeyTable(keys))
            self.cost.append(np.vstack([cost, np.zeros((1, width))]).astype(np.float32))
            self.context.append(KeyTable(contexts))
            self.escape.append(np.vstack([escape, np.zeros((1, width))]).astype(np.float32))

    def code_lengths(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Bits for each text (rows) in each language (columns)."""
        rows, width = len(offs) - 1, len(self.langs)
        out = np.zeros((rows, width))
        if not len(data):
            return out
        key, _ = packed_grams(data, offs, self.order)
        full = np.flatnonzero(np.diff(offs))
        row = self.symbol[self.order].find(key)
        for i in range(width):
            out[full, i] = np.add.reduceat(self.cost[self.order][:, i].copy()[row], offs[:-1][full], dtype=np.float64)
        left = np.flatnonzero(row < 0)
        doc = np.searchsorted(offs, left, side="right") - 1
        key = key[left]
        for d in range(self.order, -1, -1):
            if not len(key):
                break
            own = key & np.uint64((1 << 8 * (d + 1)) - 1)
            if d < self.order:
                row = self.symbol[d].find(own)
                self._add(out, doc, self.cost[d][row])
                miss = row < 0
                doc, key, own = doc[miss], key[miss], own[miss]
            self._add(out, doc, self.escape[d][self.context[d].find(own >> np.uint64(8))])
            if d == 0:
                self._add(out, doc, np.full((len(doc), width), 8.0))
        return out

    @staticmethod
    def _add(out: np.ndarray, doc: np.ndarray, costs: np.ndarray) -> None:
        for i in range(out.shape[1]):
            out[:, i] += np.bincount(doc, costs[:, i], len(out))

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language number and its posterior probability under equal priors."""
        bits = self.code_lengths(data, offs)
        best = bits.argmin(1)
        odds = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000))
        return best, 1 / odds.sum(1)


def training_rows(docs: DataFrame, rows_per_lang: int, bytes_per_lang: int, max_langs: int) -> DataFrame:
    """A bounded, repeatable sample (lang, text) of the labelled training documents.

    Rows are chosen by a hash of doc_id; each language gets at most ``rows_per_lang``
    texts and ``bytes_per_lang`` bytes, whole texts only.  More than ``max_langs`` languages
    are an error: none is left out silently.
    """
    use = docs.filter(F.col("lang").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2))
    counts = {r["lang"]: r["n"] for r in use.groupBy("lang").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages; raise max_langs if the model may be that large")
    scale = 1 << 30
    wanted = [(k, min(scale, int(scale * 2 * rows_per_lang / n) + 1)) for k, n in counts.items()]
    share = docs.sparkSession.createDataFrame(wanted or [("", 0)], "lang string, share long")
    drawn = F.pmod(F.xxhash64(F.lit(4), F.col("doc_id")), F.lit(scale))
    some = use.filter(F.col("text").isNotNull() & (F.octet_length("text") <= bytes_per_lang)).withColumn("draw", drawn)
    some = some.join(F.broadcast(share), "lang").filter(F.col("draw") < F.col("share"))
    w = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    some = some.withColumn("nth", F.row_number().over(w)).withColumn("size", F.sum(F.octet_length("text")).over(w))
    return some.filter((F.col("nth") <= rows_per_lang) & (F.col("size") <= bytes_per_lang)).select("lang", "text")


def train(docs: DataFrame, order: int = 4, rows_per_lang: int = 500, bytes_per_lang: int = 2_000_000, max_langs: int = 256) -> PpmModel:
    """Trees of every language of ``docs`` (doc_id, text, lang); counted on the executors."""
    sample = training_rows(docs, rows_per_lang, bytes_per_lang, max_langs)

    def count(key, rows):
        texts = [t.encode() for t in rows.column("text").to_pylist()]
        grams = gram_counts(texts, order)
        return pa.table({"lang": [key[0].as_py()] * (order + 1), "depth": list(range(order + 1)), "grams": [g.tobytes() for g, _ in grams], "counts": [n.astype(np.int64).tobytes() for _, n in grams]})

    found = sample.groupBy("lang").applyInArrow(count, "lang string, depth long, grams binary, counts binary").collect()
    by: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["depth"])):
        by.setdefault(r["lang"], []).append((np.frombuffer(bytes(r["grams"]), np.uint64), np.frombuffer(bytes(r["counts"]), np.int64)))
    langs = sorted(k for k, v in by.items() if len(v[0][0]))
    return PpmModel(langs, [by[k] for k in langs], order)


def identify(docs: DataFrame, model: PpmModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``, in one narrow pass."""
    spark = docs.sparkSession
    shared.tune(spark)
    held = spark.sparkContext.broadcast(model)
    box = shared.boxed(docs, text_col)

    def work(stream):
        ppm = held.value
        for batch in stream:
            for part in shared.slices(batch):
                texts = part.column("text")
                data, offs = shared.buffer_of(texts)
                sums = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
                letter = sums[offs[1:]] > sums[offs[:-1]]
                for i in np.flatnonzero(~letter & (np.diff(offs) > 0)):
                    letter[i] = any(map(str.isalpha, texts[int(i)].as_py()))
                if ppm.langs:
                    best, score = ppm.predict(data, offs)
                    pred = [ppm.langs[b] if ok else "und" for b, ok in zip(best, letter)]
                    score = np.where(letter, score, 0.0)
                else:
                    pred, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)], ["row", "text", "lang_pred", "score"])

    out = box.mapInArrow(work, shared.boxed_schema(box, lang_pred="string", score="double"))
    return shared.unboxed(out, docs, text_col, ["lang_pred", "score"])


def rejected_free(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """Pipeline stage: documents in a recognised language, with their own columns only."""
    model = train(docs.select("doc_id", "text", "lang"))
    whole = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("whole"), docs["text"])
    out = identify(whole, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= least_score))
    return out.select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])
