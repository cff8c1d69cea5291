"""Five stages over ``documents``: what each keeps is written and is the next one's input.

1. language: documents in a recognised language stay.
2. lines: lines that many documents repeat stay in one of them.
3. near copies: one document of every group of near copies stays.
4. benchmark: documents that hold benchmark passages go.
5. pieces: SentencePiece ids, byte spans and the decoded text of what is left.

The last stage adds columns; all others return those of ``documents``, whatever more they
are; a column named like one that the last stage adds comes back as ``<name>_input``.  Null
and empty texts have no language and go in the first stage; an empty table stays empty.
No SQL twin: the language model and the tokenizer have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm import decontam, jaccard, langid, linededup, pieces, shared

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.rejected_free(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the kept text."""
    whole = docs.select("doc_id", "text", F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("whole"))
    out = linededup.dedup_lines(whole)
    cols = []
    for c in docs.columns:
        old, kind = F.col("whole").getField(c), docs.schema[c].dataType
        if c == "n_chars":
            old = F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(old)
        cols.append((F.col("text").cast(kind) if c == "text" else old).alias(c))
    return out.select(*cols)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A whole 13-word window of a benchmark text is a leak, however long the document."""
    found = decontam.contamination(docs, shared.table(spark, sf_dir, "benchmark"))
    leaked = (F.col("n_hit") >= decontam.WINDOW) | F.col("contaminated")
    gone = shared.stored(found.filter(leaked & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("drop_id")).distinct(), "leaked")
    return shared.without_ids(docs, gone)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("pieces", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages; each but the last is written to the shared folder and read again.

    A stage's intermediate tables go when it is written, and what it read goes with them.
    """
    docs, last = shared.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared.scratch(spark, f"stage-{name}")
        with shared.workspace(spark):
            docs = shared.stored(stage(spark, docs, sf_dir), name, at=path)
        if last:
            shared.remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
