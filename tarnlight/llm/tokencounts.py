"""Token counts by an exact length histogram.

Documents are reduced to their encoded length and the lengths to a histogram, whose size
follows the longest document rather than the corpus.  Suffix sums over the histogram
then answer, for every context limit, how many documents exceed it, how many tokens
remain when texts are cut there, and where the quantiles lie.

The sums run over blocks of ``BLOCK`` lengths: one window inside each block and one over
the few block totals, so no task holds the whole histogram.

Cases: a null or empty text has length 0 and is counted; repeated rows count each; an
empty table gives an empty histogram; special-token strings are ordinary text.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.llm import shared

BLOCK = 256


@functools.lru_cache(maxsize=2)
def rank_encoding(path: str, pattern: str):
    """A byte-level BPE from a rank file, built once per worker."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """All columns of ``docs`` with the encoded length of the whole text."""
    shared.tune(docs.sparkSession)
    box = shared.boxed(docs, text_col)

    def work(stream):
        coder = rank_encoding(rank_path, pattern)
        for batch in stream:
            for part in shared.slices(batch):
                n = [len(coder.encode_ordinary(t)) if t else 0 for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], ["row", "text", out_col])

    return shared.unboxed(box.mapInArrow(work, shared.boxed_schema(box, **{out_col: "long"})), docs, text_col, [out_col])


def histogram(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """(length, docs): one row per distinct length."""
    return lengths.groupBy(F.col(col).alias("length")).agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length L: documents and tokens at least that long, and the totals cut at L.

    ``docs_ge``/``tokens_ge``: documents of length >= L and their tokens.
    ``truncated_total``: sum of min(length, L) over all documents.
    ``share_le``: the fraction of documents of length <= L.
    """
    hist = hist.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("docs"))
    totals = hist.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    totals = totals.select(
        "block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"), F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("all_tokens")
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.join(totals, "block").withColumn("docs_ge", F.col("docs_after") + F.sum("docs").over(inside)).withColumn("tokens_ge", F.col("tokens_after") + F.sum("tokens").over(inside))
    return out.select(
        "length", "docs", "docs_ge", "tokens_ge", (F.col("all_tokens") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_ge") + F.col("docs")) / F.col("all_docs")).alias("share_le"), "all_docs", "all_tokens",
    )


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens that remain when every document is cut to ``limit``; any limit, not only a length."""
    if limit <= 0:
        return 0
    row = sums.filter(F.col("length") <= limit).orderBy(F.desc("length")).select("docs", "docs_ge", "tokens_ge", "length", "all_tokens", "all_docs").first()
    if row is None:
        first = sums.agg(F.max("all_docs")).first()[0]
        return int((first or 0) * limit)
    over = row["docs_ge"] - row["docs"]
    under = row["all_tokens"] - (row["tokens_ge"] - row["docs"] * row["length"])
    return int(under + over * limit)


def quantile(sums: DataFrame, q: float) -> int | None:
    """Smallest length that at least a fraction ``q`` of the documents does not exceed."""
    row = sums.filter(F.col("share_le") >= q - 1e-12).orderBy("length").select("length").first()
    return None if row is None else int(row["length"])


