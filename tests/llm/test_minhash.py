"""Near-duplicates where ids repeat, one text has many followers, and words are cut by windows."""

import random

import pytest
from pyspark.sql import functions as F

from basalt.llm import minhash

WORDS = " ".join(f"w{i}" for i in range(60))


@pytest.mark.parametrize("window", [5, 64, minhash.WINDOW])
def test_word_hashes(monkeypatch, window):
    monkeypatch.setattr(minhash, "WINDOW", window)
    rnd, seen = random.Random(1), {}
    for _ in range(300):
        text = bytes(rnd.choice(b"aAbB \n\t\xc3\xa9\x00") for _ in range(rnd.randrange(80)))
        words = text.lower().split()
        hashes = minhash.word_hashes(text).tolist()
        assert len(hashes) == len(words) and all(seen.setdefault(w, h) == h for w, h in zip(words, hashes))
    assert len(set(seen.values())) == len(seen)


def test_ids_that_repeat(spark):
    """Rows of a doc_id are one document for links, and rows of their own for what stays."""
    rows = [(5, WORDS), (5, "quite another text of some more than five words"), (3, "quite another text of some more than five words"), (7, WORDS + " tail"), (9, "alone in the world with its six words"), (9, None), (None, WORDS), (None, "no id and no twin of its six words"), (None, "no id and no twin of its six words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect() if r.doc_id is not None)
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (9, 9, True), (9, 9, True)]
    nameless = [r for r in minhash.near_duplicates(docs).collect() if r.doc_id is None]
    assert len(nameless) == 3 and all(r.kept and r.component_id is None for r in nameless)
    kept = sorted(map(tuple, minhash.dedup_documents(docs).collect()), key=repr)
    assert kept == sorted([(5, WORDS), (3, rows[2][1]), (9, rows[4][1]), (9, None), (None, rows[7][1])], key=repr)


def test_one_leader_of_many_followers(spark):
    """3,000 edited copies of one text among others: all in one component, no task with more than a few groups of followers."""
    rnd = random.Random(3)
    base = [f"t{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 3001):
        words = list(base)
        words[rnd.randrange(200)] = f"e{i}"
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join(f"o{rnd.randrange(10**6)}" for _ in range(50))) for i in range(5000, 5200)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.filter("doc_id <= 3000").select(F.count_distinct("component_id"), F.min("component_id"), F.count("doc_id")).first() == (1, 0, 3001)
    assert got.filter("doc_id >= 5000 AND NOT kept").count() == 0


def test_components_against_union_find(spark):
    rnd = random.Random(1)
    for n, m, chain in ((1, 0, 0), (1, 1, 0), (40, 30, 0), (200, 150, 60), (300, 1000, 10)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(1000 + i, 1001 + i) for i in range(chain)]
        parent = {x: x for edge in edges for x in edge}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        got = minhash.components(spark.createDataFrame(edges, "a long, b long"), minhash.Scratch(spark))
        assert dict(map(tuple, got.collect())) == {x: root(x) for x in parent if root(x) != x}
