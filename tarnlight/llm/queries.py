"""Contract queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.llm import shared


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlight.llm.linededup import dedup_lines

    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlight.llm import decontam

    out = decontam.contamination(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlight.llm import suffixdedup

    out = suffixdedup.suffix_dedup(shared.table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return out.select("doc_id", "n_words", "n_repeated", "other_id", spans.alias("spans"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlight.llm import pii

    out = pii.find_pii(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda x: x["kind"].isin(*pii.BASE))
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(_spans(base).cast("binary"), 256).alias("base_sha256"), _spans(F.col("pii")).alias("spans"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlight.llm import langid

    docs = shared.table(spark, sf_dir, "documents")
    model = langid.train(docs.select("doc_id", "text", "lang"))
    out = langid.identify(docs.select("doc_id", "text"), model)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tarnlight.llm import tokencounts

    docs = shared.table(spark, sf_dir, "documents").select("text")
    lengths = tokencounts.token_lengths(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return tokencounts.suffix_sums(shared.stored(tokencounts.histogram(lengths), "lengths"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tarnlight.llm import pieces

    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), digest=True).drop("text")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlight.llm import ann

    vectors = shared.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def _spans(items, start="start", end="end"):
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["kind"], x[start], x[end])), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlight.llm import secrets

    out = secrets.scan(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("findings", lambda x: x["kind"] != "token")
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_spans(base).cast("binary"), 256).alias("base_sha256"), _spans(F.col("findings")).alias("spans"), count("token"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlight.llm import jaccard

    return jaccard.near_duplicates(shared.table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontam": op1_decontam,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_pii": op3_pii,
    "op4_language_id": op4_language_id,
    "op5_token_counts": op5_token_counts,
    "op6_pieces": op6_pieces,
    "op7_line_dedup": op7_line_dedup,
    "op8_nearest": op8_nearest,
    "op9_secrets": op9_secrets,
    "op10_jaccard_join": op10_jaccard_join,
}
