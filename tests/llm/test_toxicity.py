"""Kneser-Ney probabilities by hand, the fitted models on invented and held-out rows."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from basalt.llm import toxicity


def test_probabilities_by_hand():
    """Two words of one letter after the start: `a` twice ordinary and once toxic, `b` once toxic."""
    of_gram, of_context = toxicity.fitted({"\x02a": (2, 1), "\x02b": (0, 1)})
    assert (toxicity.DISCOUNT, toxicity.UNSEEN) == (0.9, 0.001)
    shared = (1 - 0.9 + 0.9 * 2 * 0.001) / 2  # of either letter: one letter before it; two kinds of two
    ordinary = {"a": (2 - 0.9 + 0.9 * 1 * shared) / 2, "b": (0 + 0.9 * 1 * shared) / 2}
    toxic = {x: (1 - 0.9 + 0.9 * 2 * shared) / 2 for x in "ab"}
    for x in "ab":
        assert of_gram[f"\x02{x}"] == pytest.approx(math.log(toxic[x] / ordinary[x]))
    assert of_context == {"\x02": pytest.approx(math.log(2))}  # an unseen letter: 0.9 * 2 / 2 against 0.9 * 1 / 2
    assert toxicity.ratio((of_gram, of_context), "a") == pytest.approx(math.log(toxic["a"] / ordinary["a"]) / 2)  # the end after it is in no context seen
    known = [{}, {}]
    terms = [math.log(1 - 0.01 + 0.01 * math.exp(4 * toxicity.ratio((of_gram, of_context), x))) for x in ("a", "b", "c")]
    assert toxicity.evidence((of_gram, of_context), "a b. A c1", (4.0, 0.01), known) == pytest.approx(sum(terms))
    assert toxicity.evidence((of_gram, of_context), None, (4.0, 0.01), known) == toxicity.evidence((of_gram, of_context), "1 2", (4.0, 0.01), known) == 0


def test_invented_words(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice(["ba", "ko", "ri", "ne", "tul", "sha"]) for _ in range(3)) for _ in range(300)]
    rows, marks = [], []
    for i in range(2400):
        toxic = i % 8 == 0
        text = rnd.choices(words, k=rnd.randrange(5, 60)) + [rnd.choice(["zlorg", "grumpf", "vexxel"]) + rnd.choice(["", "a", "en"])] * toxic
        rnd.shuffle(text)
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    table, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(table, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    assert sum(got[i].predicted == y for i, y in marks if got[i].held_out) >= 0.99 * sum(r.held_out for r in got.values())
    kept = toxicity.drop_toxic(table, labels)
    assert kept.columns == ["doc_id", "text"] and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}

    # Nulls, empty and very long texts, repeated rows, labels that contradict each other, clashing columns, empty tables.
    odd = [(None, "no id"), (1, None), (2, ""), (3, "w " * 100_000), (3, "w " * 100_000), (4, "zlorg" * 20_000)]
    more = spark.createDataFrame(odd, "doc_id long, text string").withColumn("_score", F.lit(7)).withColumn("toxic", F.lit(1))
    again = labels.union(labels.limit(50)).union(spark.createDataFrame([(1, 0), (1, 1), (2, 9)], "doc_id long, toxic int"))
    got = toxicity.judge(more, again).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got) and not next(r for r in got if r.doc_id is None).held_out
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    kept = toxicity.drop_toxic(more, again)
    assert kept.columns == ["doc_id", "text", "_score", "toxic"] and kept.count() == len(odd)
    assert toxicity.judge(table.limit(0), labels.limit(0)).count() == 0 == toxicity.drop_toxic(table.limit(0), labels).count()
    assert toxicity.judge(table, labels.limit(0)).filter("predicted = 1").count() == 0


def test_clean_documents_stay_clean_when_long(spark):
    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    model, known = toxicity.train(table("documents"), table("labels")), [{}, {}]
    evidence = lambda text: toxicity.evidence(model["tables"], text, model["rule"], known)
    caught = lambda own: toxicity.probability(evidence(" ".join(own)), model["slope"], model["offset"]) >= 0.3
    held = table("documents").join(table("labels"), "doc_id").filter(toxicity.bucket(F.col("doc_id")) == 2)
    texts = sorted((len(set(toxicity.expressions(r.text))), r.toxic, r.text) for r in held.select("toxic", "text").collect() if r.toxic is not None and r.text)
    clean, toxic = [t for _, y, t in texts if not y], [t for _, y, t in texts if y]
    fifth = len(clean) // 5
    assert sum(map(evidence, clean[-fifth:])) <= sum(map(evidence, clean[:fifth])) + 0.1 * fifth
    alone, rnd = [t for t in clean if not caught([t])], random.Random(0)
    assert len(alone) >= 0.99 * len(clean) and sum(caught(rnd.sample(alone, 100)) for _ in range(100)) <= 3
    found = sum(caught([t]) for t in toxic), sum(caught([t, *rnd.sample(clean, 20)]) for t in toxic)
    assert found[0] >= 0.63 * len(toxic) and found[1] >= 0.55 * len(toxic)
