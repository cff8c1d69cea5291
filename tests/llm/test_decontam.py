import random
import re

import pytest

from tarnlight.llm import decontam

from .conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, n=13):
    out = []
    for d, text in docs:
        w = WORD.findall(low(text))
        hit, found = set(), set()
        for k, t in items:
            q = WORD.findall(low(t))
            if k is None:
                continue
            for i in range(max(1, len(q) - n + 1) if q else 0):
                p = q[i : i + n]
                for a in range(len(w) - len(p) + 1):
                    if w[a : a + len(p)] == p:
                        hit |= set(range(a, a + len(p)))
                        found.add(str(k))
        out.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(df):
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in df.collect()], key=str)


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 40])
def test_random_texts(spark, frame, block_bytes):
    rng = random.Random(1)
    word = lambda: rng.choice("a b c D é 1".split())
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(40)]
    items = [(i, ", ".join(word() for _ in range(rng.randint(0, 6)))) for i in range(8)] + [(10, docs[3][1]), (10, "a b"), (11, None), (None, "a")]
    index = decontam.build_index(frame(docs))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.summary(index, decontam.matches(index, bench, block_bytes=block_bytes))
    out = out.selectExpr("*", "n_hit > 0 AND 20 * n_hit >= n_words AS contaminated")
    assert got(out) == brute(docs, items)


def test_odd_rows(spark, frame):
    items = [(1, "word"), (2, ""), (3, "a b a b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(decontam.contamination(frame(ODD), bench)) == brute(ODD, items)


def test_empty_tables(spark, frame):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert got(decontam.contamination(frame([(1, "x")]), bench)) == [(1, 1, 0, [], False)]
    assert got(decontam.contamination(frame([]), bench)) == []


def test_proximity(spark, frame):
    docs = [(1, "x alpha y beta z gamma"), (2, "gamma beta q alpha"), (3, "alpha beta " + "q " * 9 + "gamma"), (4, "alpha beta")]
    bench = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    index = decontam.build_index(frame(docs))
    rows = decontam.matches(index, bench, within=5).collect()
    assert sorted((r["doc_id"], r["start"], r["end"]) for r in rows) == [(1, 1, 6), (2, 0, 4)]
    assert decontam.matches(index, bench).count() == 0


def test_words_with_weak_hashes(frame, spark):
    from .test_near import thue_morse

    x, y = thue_morse(2048), thue_morse(2048, True)
    docs, items = [(1, x), (2, y), (3, f"{x} {y}")], [(1, x), (2, f"{y} {x}")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(decontam.contamination(frame(docs), bench)) == brute(docs, items)


def test_ids_keep_their_own_type(spark):
    docs = spark.createDataFrame([("d/1", "one two three"), (None, "two")], "doc_id string, text string")
    bench = spark.createDataFrame([("b", "two"), ("a", "TWO three"), (None, "one")], "item_id string, text string")
    rows = {r["doc_id"]: (r["n_hit"], list(r["items"])) for r in decontam.contamination(docs, bench).collect()}
    assert rows == {"d/1": (2, ["a", "b"]), None: (1, ["b"])}
