"""Jaccard join, suffix arrays, line runs and components against brute force."""

import hashlib
import random
import re

import pytest

from tarnlight.llm import jaccard, linededup, suffixdedup
from tarnlight.llm.components import components

from .conftest import ODD

low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_jaccard(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if None not in (a, b) and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    root = groups({d for d, _ in docs if d is not None}, links)
    return sorted([(d, len(s), root.get(d)) for d, s in sets], key=str)


def near(df):
    return sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()], key=str)


def corpus(seed, n=90):
    """Families of edited copies, shared passages and short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd EF gh ij kl mn op qr st uv wx yz é".split()) + str(rng.randint(0, 40))
    text = lambda k: [word() for _ in range(k)]
    seeds, passage = [text(rng.randint(1, 120)) for _ in range(8)], text(60)
    docs = []
    for i in range(n):
        w = list(rng.choice(seeds)) if rng.random() < 0.7 else text(rng.randint(0, 80))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            if w:
                w[rng.randrange(len(w))] = word()
        if rng.random() < 0.25:
            at = rng.randint(0, len(w))
            w[at:at] = passage[: rng.choice([49, 50, 51, 60])]
        docs.append((rng.randint(0, 10**6) if i % 9 else i, " ".join(w)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_random(frame, seed, monkeypatch):
    docs = corpus(seed)
    assert near(frame(docs)) == brute_jaccard(docs)


def test_jaccard_families_of_many_parts(frame, monkeypatch):
    for name, value in (("GROUP", 4), ("LEADERS", 2), ("FREQUENT", 3)):
        monkeypatch.setattr(jaccard, name, value)
    docs = corpus(5)
    assert near(frame(docs)) == brute_jaccard(docs)


def test_jaccard_odd_rows(frame):
    assert near(frame(ODD)) == brute_jaccard(ODD)
    assert near(frame([])) == []


def test_gaps():
    import numpy as np

    v = np.array([0, 0, 5, 70_000, 200_000, 200_000])
    assert (jaccard._from_gaps(jaccard._gaps(v)) == v).all()


def brute_passages(docs, n=50):
    words = {}
    for d, t in docs:
        words.setdefault(d, []).append(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)))
    where = {}
    for d, texts in words.items():
        for w in texts if d is not None else []:
            for i in range(len(w) - n + 1):
                where.setdefault(tuple(w[i : i + n]), set()).add(d)
    spans, other = {}, {}
    for d, texts in words.items():
        hit = set()
        for w in texts if d is not None else []:
            for i in range(len(w) - n + 1):
                who = where[tuple(w[i : i + n])]
                if len(who) > 1:
                    hit |= set(range(i, i + n))
                    other[d] = min(other.get(d, 10**9), min(who - {d}))
        spans[d] = len(hit)
    return sorted([(d, spans[d], other.get(d)) for d, _ in docs], key=str)


def passages(df):
    return sorted([(r["doc_id"], r["n_repeated"], r["other_id"]) for r in suffixdedup.suffix_dedup(df).collect()], key=str)


@pytest.mark.parametrize("held", [suffixdedup.HELD, 2])
def test_passages(frame, monkeypatch, held):
    monkeypatch.setattr(suffixdedup, "HELD", held)
    docs = corpus(3)
    assert passages(frame(docs)) == brute_passages(docs)


def test_passages_odd_rows(frame):
    rows = [r for r in ODD if r[0] != 12] + [(20, "x " * 80), (21, "y " * 30 + "x " * 80)]
    assert passages(frame(rows)) == brute_passages(rows)
    assert passages(frame([])) == []


def key_of(line):
    return low(line.strip(" \t\n\x0b\x0c\r"))


def brute_lines(docs, least=20, many=3):
    who = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= least:
                who.setdefault(key_of(line), set()).add(-1 if d is None else d)
    out = []
    for d, t in docs:
        rows = (t or "").split("\n")
        kept = [x for x in rows if not (len(s := who.get(key_of(x), ())) >= many and (-1 if d is None else d) != max(s))]
        out.append((d, len(rows), len(rows) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def lines(df, **kw):
    rows = linededup.dedup_lines(df, **kw).collect()
    return sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in rows], key=str)


def test_lines_random(frame):
    rng = random.Random(4)
    pool = ["a license line of some length", "\tA License line of some length ", "short", "é" * 20, "é" * 19, "", "  ", "another line that repeats a lot"]
    docs = [(rng.choice([i, i, None, i % 5]), "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    want = brute_lines(docs)
    for batches in (1, 6):
        assert lines(frame(docs), batches=batches, fanout=2) == want


def test_lines_odd_rows(frame):
    assert lines(frame(ODD)) == brute_lines(ODD)
    assert lines(frame([])) == []


def test_runs_tell_unseen_lines(spark, tmp_path):
    store = linededup.LineRuns(spark, str(tmp_path), fanout=2)
    batch = lambda *rows: spark.createDataFrame(rows, "h1 long, h2 long, doc long")
    assert store.add(batch((1, 1, 5), (2, 2, 5))).count() == 2
    assert [r["h1"] for r in store.add(batch((2, 2, 6), (3, 3, 6))).collect()] == [3]
    assert [len(x) for x in store.levels] == [0, 1]
    assert store.add(batch((1, 1, 7), (3, 3, 7))).count() == 0
    assert sorted((r["h1"], r["docs"], r["top"]) for r in store.repeated(2).collect()) == [(1, 2, 7), (2, 2, 6), (3, 2, 7)]


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(500, 540)] + [(900, x) for x in range(901, 960)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}


def thue_morse(n, flip=False):
    """Words that collide under any polynomial hash modulo a power of two."""
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_words_with_weak_hashes(frame):
    x, y = thue_morse(2048), thue_morse(2048, True)
    docs = [(1, f"{x} two three four five"), (2, f"{y} two three four five"), (3, f"{y}  two three four FIVE"), (4, f"{x * 8} w"), (5, f"{y * 8} w")]
    assert near(frame(docs)) == brute_jaccard(docs)
    tail = " ".join(f"t{i}" for i in range(60))
    docs = [(1, f"{x} " * 30 + tail), (2, f"{y} " * 30 + tail), (3, " ".join([x, y] * 40)), (4, " ".join([y, x] * 40)), (5, " ".join(x[i] for i in range(200))), (6, " ".join(y[i] for i in range(200)))]
    assert passages(frame(docs)) == brute_passages(docs)


def test_ids_of_other_kinds_are_refused(spark):
    with pytest.raises(TypeError):
        jaccard.near_duplicates(spark.createDataFrame([("a", "text")], "doc_id string, text string"))


def test_hot_keys_are_joined_apart(spark):
    from tarnlight.llm import shared

    rows = spark.createDataFrame([(0, i) for i in range(3000)] + [(i, i) for i in range(1, 50)], "k long, v long")
    groups = rows.groupBy("k").agg({"*": "count"}).toDF("k", "n").selectExpr("k", "n", "k * 10 AS ten")
    assert shared.join_groups(rows, groups, ["k"], "n").where("ten = 10 * k").count() == 3049


def test_frequent_prints_are_cut_before_they_are_collected(frame, monkeypatch):
    for name, value in (("MOST_FREQUENT", 5), ("FREQUENT", 2), ("RANGE_TOKENS", 100)):
        monkeypatch.setattr(jaccard, name, value)
    docs = corpus(7)
    counted = jaccard.count_tokens(jaccard.document_facts(frame(docs).selectExpr("doc_id AS doc", "text"), 16), 16)
    assert len(counted.prints) <= 5
    assert near(frame(docs)) == brute_jaccard(docs)
