"""The registered queries against their SQL, and each stage of the pipeline against what it does by hand."""

import base64
import hashlib
import math
import random
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from basalt.llm import queries
from tests.llm.test_operators import components, kept_lines

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in "documents embeddings pages".split():
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SF)
    plain = lambda row: repr(tuple(round(x, 6) if isinstance(x, float) else x for x in row))
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(plain, got.select(*names).collect())) == sorted(map(plain, want.fetchall()))


def mixed_by_hand(rows):
    """How often each row (doc_id, text, source) is drawn, with sources not null."""
    words = [(i, len((t or "").encode().split()), s, t or "") for i, t, s in rows]
    sizes = Counter()
    for _, n, s, _ in words:
        sizes[s] += n
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}
    full = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        level = left / sum(w for s, w in weight.items() if s not in full)
        now = {s for s in sizes if 2 * sizes[s] / weight[s] <= level} | full
        if now == full:
            break
        full = now
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    size_class = lambda n: len(f"{n:b}") * 8 + ((n << 4) >> len(f"{n:b}")) - 8
    drawn = Counter()
    for s in sizes:
        rate = (2 * sizes[s] if s in full else weight[s] * level) / sizes[s] if sizes[s] else 0.0
        offset = (int(md5(f"offset7{s}false")[:8], 16) >> 12) / 1048576
        own = sorted((size_class(n), md5(f"7|{i}|{md5(t)}"), i) for i, n, x, t in words if x == s)
        for k, (_, _, i) in enumerate(own):
            drawn[i] += math.floor((k + 1) * rate + offset) - math.floor(k * rate + offset)
    return +drawn


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage's rows, as written and read again, are what brute force makes of the stage's input; run() returns the last stage's."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice(["ba", "ko", "ri", "ne", "tul", "sha"]) for _ in range(3)) for _ in range(400)]
    shared = [" ".join(rnd.choices(words, k=9)) for _ in range(4)]
    rows, marks = [], []
    for i in range(900):
        lines = [" ".join(rnd.choices(words, k=rnd.randrange(4, 12))) for _ in range(rnd.randrange(1, 6))]
        if i % 3 == 0:
            lines.insert(rnd.randrange(len(lines) + 1), rnd.choice(shared))
        if i % 7 == 0 and i > 20:  # near copies, some of them in other cases
            own = rows[rnd.choice([0, 1, 2, 3, 5, 6, 7, 8])][1].split(" ")
            own[rnd.randrange(len(own))] += "x"
            lines = " ".join(own).split("\n")
        toxic = i % 9 == 4
        if toxic:
            lines[0] += f" {rnd.choice(['zlorgus', 'grumpfel', 'vexxelon'])} it"
        rows.append((i, "\n".join(lines), "en", f"s{min(i % 5, rnd.randrange(5))}", 0))
        marks.append((i, 1, int(toxic)))
    rows += [(2000, None, "en", "s0", 0), (2001, "", None, "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    toxicity, line_dedup, near_dedup, mixing, encoding = (stage for _, stage in corpus_pipeline.STAGES)
    docs, n = spark.read.parquet(f"{tmp_path}/documents.parquet"), 0

    def after(stage):
        nonlocal docs, n
        n += 1
        out = stage(spark, docs, str(tmp_path))
        assert n == 5 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        return [tuple(r) for r in docs.collect()]

    kept = after(toxicity)
    toxic = {i for i, _, y in marks if y}
    assert {r[0] for r in kept} == {r[0] for r in rows} - toxic and set(kept) <= set(rows)
    cut = after(line_dedup)
    assert Counter(cut) == Counter((r[0], r[1] if len(k) == m else "\n".join(k), *r[2:]) for r, k, m in zip(kept, *kept_lines(kept)))
    alone = after(near_dedup)
    label = components(cut, 5)[1]
    assert any(label[i] != i for i in label) and Counter(alone) == Counter(r for r in cut if label[r[0]] == r[0])
    mixed = after(mixing)
    drawn = mixed_by_hand([(r[0], r[1], r[3]) for r in alone])
    assert Counter(mixed) == Counter({r: drawn[r[0]] for r in alone if drawn[r[0]]})
    encoded = after(encoding)
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = lambda r: repr(tuple(r))
    want = Counter(plain((*r, public.encode_ordinary(r[1] or ""), hashlib.sha256((r[1] or "").encode()).hexdigest())) for r in mixed)
    assert Counter(map(plain, encoded)) == want
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded_sha256"] and Counter(map(plain, out.collect())) == want


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
