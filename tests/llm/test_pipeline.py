"""Every stage, and the end, against plain Python on the stage's own input."""

import hashlib
import os

import pytest
import sentencepiece

import corpus_pipeline
from tarnlight.llm import langid, shared

from .test_decontam import WORD, low
from .test_near import brute_jaccard, brute_lines

CLASH = "score n_lines n_dropped ids n_tokens starts ends decoded lang_pred row whole drops drop_id key component_id n_hit".split()


def plain_language(spark, rows):
    model = langid.train(spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows], "doc_id long, text string, lang string"))
    out = []
    for r in rows:
        text = r["text"] or ""
        if any(map(str.isalpha, text)):
            import numpy as np
            data = np.frombuffer(text.encode(), np.uint8)
            _, score = model.predict(data, np.array([0, len(data)]))
            if score[0] >= 0.5:
                out.append(r)
    return out


def plain_lines(rows):
    want = {(d, n, g): h for d, n, g, h in brute_lines([(r["doc_id"], r["text"]) for r in rows])}
    return {k[0]: h for k, h in want.items()}


def plain_leaks(rows, items, n=13):
    windows = {}
    for _, t in items:
        w = WORD.findall(low(t))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(min(n, len(w)), set()).add(tuple(w[i : i + n]))
    gone = set()
    for r in rows:
        w = WORD.findall(low(r["text"]))
        hit = {p for m, own in windows.items() for i in range(len(w) - m + 1) if tuple(w[i : i + m]) in own for p in range(i, i + m)}
        if hit and (len(hit) >= n or 20 * len(hit) >= len(w)):
            gone.add(r["doc_id"])
    return gone


@pytest.fixture(scope="module")
def inputs(spark, sf, tmp_path_factory):
    """The small tables, with extra columns named like those that operators make, and odd rows."""
    at = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None), (9002, "", "x"), (9003, "  \n ", None), (None, "the words of a text without an id", "en"), (None, None, None)], "doc_id long, text string, lang string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    docs.selectExpr("*", *[f"doc_id * 3 AS {c}" for c in CLASH]).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_every_stage(spark, inputs):
    import public_tokenizers

    docs = shared.table(spark, inputs, "documents")
    names = docs.columns
    items = [(r["item_id"], r["text"]) for r in shared.table(spark, inputs, "benchmark").collect()]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = shared.stored(stage(spark, docs, inputs), f"test-{name}")
        after = docs.collect()
        assert all(r[c] == (None if r["doc_id"] is None else 3 * r["doc_id"]) for r in after for c in CLASH if name != "pieces")
        kept = sorted(str(r["doc_id"]) for r in after)
        if name != "pieces":
            assert docs.columns == names
        if name == "language":
            assert kept == sorted(str(r["doc_id"]) for r in plain_language(spark, before)) and 0 < len(kept) < len(before)
        elif name == "lines":
            want = plain_lines(before)
            assert len(after) == len(before) and all(hashlib.sha256((r["text"] or "").encode()).hexdigest() == want[r["doc_id"]] for r in after)
            assert all(r["n_chars"] in (None, len(r["text"])) for r in after)
        elif name == "near_copies":
            want = [d for d, _, c in brute_jaccard([(r["doc_id"], r["text"]) for r in before]) if c in (None, d)]
            assert kept == sorted(map(str, want)) and len(after) < len(before)
        elif name == "benchmark":
            gone = plain_leaks(before, items)
            assert kept == sorted(str(r["doc_id"]) for r in before if r["doc_id"] not in gone) and gone
        else:
            assert [f"{c}_input" if c in ("ids", "n_tokens", "starts", "ends", "decoded") else c for c in names] == docs.columns[: len(names)]
            for r in after:
                ids = lib.encode(r["text"])
                assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == lib.decode(ids) and r["ids_input"] == (None if r["doc_id"] is None else 3 * r["doc_id"])
    end = corpus_pipeline.run(spark, inputs).collect()
    key = lambda r: (str(r["doc_id"]), r["text"], r["ids"])
    assert sorted(map(key, end)) == sorted(map(key, after))


def test_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_intermediate_tables_go(spark, sf):
    with shared.workspace(spark) as at:
        corpus_pipeline.run(spark, sf).count()
        left = [n for n in os.listdir(at) if not n.startswith(".")]
        assert len(left) == 1 and left[0].startswith("stage-benchmark")
    assert not os.path.exists(at)
