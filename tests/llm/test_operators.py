"""Each operator on small tables with hard cases, against brute force."""

import base64
import hashlib
import ipaddress
import math
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from basalt.llm import bpe, lines, minhash, mixing, pii, quality, queries, search, sharding, urls

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, size string, `key` string, `a.b` string"
LONG = "This passage of more than forty code points is shared by MANY documents"
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    None, "", " \t\n\x0b", "One", "one", "a b", "x" * 50_000, BASE, BASE, BASE + " tail", BASE.upper().replace(" ", "\n"), "é ü ß 中文 🙂\r\n\x1c end", f"{LONG}\nalone 1", f" {LONG.lower()}\t\nalone 2\n",
    f"{LONG}\n{LONG}", LONG, LONG + "\n\n", "again and again and again and again and again and again and again", "### %% $$ stuff | here", "mail Ann.Lee@mail.example.com or +1 (212) 555-3456", "Mr. Hans Meier and Mrs. Ada Okoro wrote", None,
]


@pytest.fixture(scope="module")
def rows():
    return [(i, t, "en", [None, "b", "a", "c"][i % 4], "s", "k", "x") for i, t in enumerate(TEXTS)] + [(None, "no id here", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def twice(docs):
    """The rows, some of them twice."""
    return docs.union(docs.filter("doc_id % 3 = 0"))


def test_urls(spark):
    cases = [None, "", "no scheme", "http://EXAMPLE.com/en/70", "https://a.b.example.com/en/6?x", "http://example.com", "http://notexample.net/de/8", "http://x.example.net/de/80#f", "http://badcom/en/", "http://q.org/es/:// /", "ftp://org/es", "http://www.EXAMPLE.net/de/8"]
    pages = spark.createDataFrame([(i % 11, u, "h", "r") for i, u in enumerate(cases * 2)], "page_id long, url string, html string, rule string")

    def judged(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(r), r, v) for v, r in queries.RULES for h, p in [(r.split("/")[0], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"

    out = urls.judge_urls(pages, urls.rule_table(spark, queries.RULES))
    assert Counter(map(tuple, out.collect())) == Counter((i % 11, *judged(u)) for i, u in enumerate(cases * 2))
    assert urls.judge_urls(pages.limit(0), urls.rule_table(spark, queries.RULES)).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, urls.rule_table(spark, queries.RULES).limit(0)).collect()} == {"allow"}


def test_urls_with_colliding_prefixes_and_many_shapes(spark, monkeypatch):
    """Prefixes of one digit meet by the dozen; only full digests count. 600 rules of 150 shapes; null rows by the hundred keep their number."""
    monkeypatch.setattr(urls, "PREFIX", 1)
    rnd = random.Random(2)
    label = lambda: rnd.choice(["a", "b", "c", "dd", "com"])
    rules = {(".".join(label() for _ in range(rnd.randrange(1, 6))), "/" + "".join(rnd.choice("xy/") for _ in range(rnd.randrange(30)))): rnd.choice(["allow", "block"]) for _ in range(600)}
    pages = [(i, f"http://{'.'.join(label() for _ in range(rnd.randrange(1, 8)))}/{''.join(rnd.choice('xy/') for _ in range(rnd.randrange(40)))}") for i in range(2000)] + [(None, None)] * 300
    out = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string").repartition(5), urls.rule_table(spark, [(v, h + p) for (h, p), v in rules.items()]))

    def judged(url):
        host, path = url[7:].split("/", 1) if url else ("", "")
        fits = [(len(h + p), h + p, v) for (h, p), v in rules.items() if url and (host == h or host.endswith("." + h)) and f"/{path}".startswith(p)]
        best = max(len(r) for _, r, _ in fits) if fits else 0
        return {(r, v) for _, r, v in fits if len(r) == best} or {(None, "allow")}

    got = out.collect()
    assert Counter(r.page_id for r in got) == Counter(i for i, _ in pages)
    url_of = dict(pages)
    assert all((r.rule, r.verdict) in judged(url_of[r.page_id]) for r in got)


def components(rows, width, least=80):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    label = {i: i for i in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for i in label:
            for j in label:
                if i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return sets, label


@pytest.mark.parametrize("width", [2, 5])
def test_minhash_edge_cases(docs, rows, empty, width):
    sets, label = components(rows, width)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, width=width).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items() if i is not None} == {i: (len(sets[i]), label[i]) for i in label}
    assert got[None].kept and got[None].component_id is None
    assert minhash.near_duplicates(twice(docs), width=width).count() == twice(docs).count()
    kept = minhash.dedup_documents(twice(docs), width=width)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted([i for i in label if label[i] == i] + [i for i in label if i % 3 == 0 and not sets[i]])  # rows without words stay
    assert minhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_minhash_chain_of_edits(spark, width):
    """A large group of edited copies, some too far from all others: the same components as brute force."""
    rnd = random.Random(5)
    base = [f"t{rnd.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rnd.choice([0, 1, 2, 4, 8, 10, 12, 20])):
            words[rnd.randrange(len(words))] = f"e{rnd.randrange(40)}"
        rows.append((i * 7 % 263, " ".join(words)))
    sets, label = components(rows, width)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()}
    assert got == label


def test_quality_rules_fire(spark):
    """Each rule fails some documents of the tables, and none fails most."""
    book = quality.ledger(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    figures = quality.ablations(book).collect()
    assert {r.rule for r in figures} == {name for name, _ in quality.RULES} and all(0 < r.n_failed < 2000 and r.n_without <= r.n_rejected for r in figures)


def test_quality(docs, rows, empty):
    kept = {version: {r.doc_id: r.kept for r in quality.apply_policy(quality.ledger(docs), version).collect()} for version in quality.POLICIES}
    got = {r.doc_id: r for r in quality.apply_policy(quality.ledger(docs)).collect()}
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + d for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for d in range(5)}
        held = [x for x in (t or "").split("\n") if x.encode().split()]
        want = (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t or ""), len(held) - len(set(held)), len(covered), len(held))
        assert tuple(got[i][m] for m in quality.MEASURES) == want
        assert got[i].base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        for version, rules in {1: 2, 2: 3, 3: 5}.items():
            failed = [want[0] < 10, 100 * want[4] > 20 * want[0], 10 * want[2] > want[0], want[1] < 3 * want[0] or want[1] > 9 * want[0], 10 * want[3] > 3 * want[5]]
            assert kept[version][i] == (not any(failed[:rules]))
    assert quality.ledger(empty).count() == 0
    book = quality.ledger(docs)
    bits = [r.failures & quality.mask(quality.POLICIES[quality.LATEST]) for r in book.collect()]
    for r in quality.ablations(book).collect():
        bit = quality.mask([r.rule])
        assert (r.n_failed, r.n_alone, r.n_rejected, r.n_without) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(b > 0 for b in bits), sum(b & ~bit > 0 for b in bits))
    assert all(r.n_failed == 0 for r in quality.ablations(quality.ledger(empty)).collect())


def test_mixing(docs, empty):
    got = mixing.mix_plan(twice(docs)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_plan(twice(docs).repartition(7)).collect()))
    assert all(r.taken <= 2 * r.size for r in got) and len(got) == twice(docs).count()
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    plan = Counter({r.doc_id: r.taken for r in mixing.mix_plan(docs).collect()})
    copies = Counter(r.doc_id for r in mixed.collect())
    sizes = {r.doc_id: r.size for r in mixing.mix_plan(docs).collect()}
    assert all(plan[i] == copies[i] * sizes[i] for i in sizes)
    assert mixing.mix_plan(empty).count() == 0


def test_mixing_comes_near_targets(spark):
    rnd = random.Random(1)
    rows = [(i, "w " * int(rnd.paretovariate(1.2) * 10), rnd.choice("aaaabbcdef")) for i in range(3000)]
    got = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for target in {r.target for r in got}:
        own = [r for r in got if r.target == target]
        assert abs(sum(r.taken for r in own) - target) <= max(0.03 * target, 2 * max(r.size for r in own))


def test_mixing_targets_of_many_sources(spark):
    """The water level by aggregation: as sharing the excess anew until none is above."""
    rnd = random.Random(6)
    sizes = {f"s{i:04d}": int(rnd.paretovariate(0.7)) for i in range(700)} | {None: 50, "": 3, "zero": 0}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(table, mixing.Scratch(spark)).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want, full = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        level = left / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in sizes if s not in full and weight[s] * level >= 2 * sizes[s]}
        if not more:
            break
        full |= more
    want = {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in sizes}
    assert 0 < len(full) < len(sizes) and got == pytest.approx(want)


def test_mixing_parts_are_small(spark, monkeypatch):
    """3,000 rows without doc_id beside as many others: no running count goes over many more rows than a part has."""
    rows = [(None if i % 2 else i, f"text {i}", "one") for i in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_plan(table).collect()
    assert len(got) == 6000 and abs(sum(r.taken for r in got) - got[0].target) <= 4
    keyed = mixing._keyed(table.withColumn("size", F.lit(2).cast("long")), 7)
    parts = keyed.groupBy(F.expr(f"floor(cast(conv(substring(key, 1, 8), 16, 10) as bigint) * {6000 // mixing.PART_ROWS} / 4294967296)")).count()
    assert parts.agg(F.max("count")).first()[0] < 2 * mixing.PART_ROWS


def kept_lines(rows):
    """Documents are told apart by doc_id; rows without one hold nothing."""
    keys = [[(line, line.encode().strip().lower()) for line in (t or "").split("\n")] for _, t, *_ in rows]
    holders = {}
    for (i, *_), own in zip(rows, keys):
        for key in {k for _, k in own if len(k.decode()) >= 40}:
            holders.setdefault(key, set()).update([i] if i is not None else [])
    gone = lambda i, k: len(holders.get(k, ())) >= 5 and max(holders[k]) != i
    return [[line for line, k in own if not gone(i, k)] for (i, *_), own in zip(rows, keys)], [len(own) for own in keys]


def test_lines(docs, rows, empty):
    for table, data in ((docs, rows), (twice(docs), rows + [r for r in rows if r[0] is not None and r[0] % 3 == 0])):
        kept, n = kept_lines(data)
        want = Counter((r[0], m, m - len(k), hashlib.sha256("\n".join(k).encode()).hexdigest()) for r, k, m in zip(data, kept, n))
        assert Counter(map(tuple, lines.line_digests(table).collect())) == want
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {r[0]: r[1] if len(k) == m else "\n".join(k) for r, k, m in zip(rows, *kept_lines(rows))}
    assert lines.line_digests(empty).count() == 0


def test_lines_count_documents_not_rows(spark):
    """Against the registered SQL: a doc_id that comes often counts once, rows without doc_id not at all."""
    rows = [(7, LONG)] * 4 + [(3, LONG)] + [(None, f"{LONG}\nx")] * 6 + [(i, f"{LONG.upper()} again\nown {i}") for i in range(10, 15)] + [(14, f"{LONG} again"), (12, "other row"), (None, f"a\n{LONG} again"), (20, None), (21, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    duck = duckdb.connect()
    documents = table.toPandas()  # noqa: F841
    duck.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM documents")
    want = Counter(duck.execute(queries.ORACLE_SQL["op5_line_dedup"]).fetchall())
    got = Counter(map(tuple, lines.line_digests(table).collect()))
    assert got == want and got == Counter((r[0], m, m - len(k), hashlib.sha256("\n".join(k).encode()).hexdigest()) for r, k, m in zip(rows, *kept_lines(rows)))


def test_lines_with_many_to_route(spark, docs, rows, monkeypatch):
    """Where the keys of texts with dropped lines are too many to broadcast, all texts go through the join, with the same result."""
    want = sorted(map(repr, lines.dedup_lines(docs).collect()))
    monkeypatch.setattr(lines, "fits", lambda keys: False)
    assert sorted(map(repr, lines.dedup_lines(docs).collect())) == want
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def top_by_hand(rows, k=10):
    own = [(i, [math.floor(1024 * x) if abs(x) < 2**52 else int(x) * 1024 for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for at, (q, query) in enumerate(own):
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(query, v)), i) for n, (i, v) in enumerate(own) if n != at and len(v) == len(query))
            out.update((q, rank, i, max(-(2**63), min(2**63 - 1, -s))) for rank, (s, i) in enumerate(scored[:k], 1))
    return out


def test_search(spark):
    rnd = random.Random(3)
    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    rows = [(i, [single(rnd.uniform(-2, 2)) for _ in range(3)]) for i in range(1, 230)]
    rows += [(i, [1.0, 1.0, 1.0]) for i in range(230, 420)]  # ties
    rows += [(500, None), (600, [None, 1.0, 1.0]), (700, [float("nan")] * 3), (800, [float("inf")] * 3), (None, [1.0] * 3), (900, [5.0]), (901, [2.0]), (902, []), (1000, []), (1100, [])]
    rows += [(100, [70000.0, 1.0, single(0.3)]), (200, [1.0, 2.0, 3.0]), (201, [-70000.0, 0.0, 0.0])]  # large, and ids that come twice
    rows += rows[:5]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert Counter(map(tuple, search.top_k(vectors).collect())) == top_by_hand(rows)
    assert search.top_k(vectors.limit(0)).count() == 0


def test_search_of_scores_beyond_64_bits(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([-1, 1]) * rnd.random() * 10.0 ** rnd.choice([0, 3, 8, 15, 30, 150, 300]) for _ in range(2)]) for i in range(0, 1600, 10)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(map(tuple, search.top_k(vectors).collect())) == top_by_hand(rows)


def test_search_refines_histograms(spark, monkeypatch):
    """Scores so near to each other, and so few rows enough, that bins are refined to single scores; in several cells."""
    rnd = random.Random(5)
    rows = [(i, [1000.0 + rnd.randrange(64) / 1024, 1000.0]) for i in range(1, 1400)] + [(1500, [-30000.0, 40000.0])]
    monkeypatch.setattr(search, "ENOUGH", 0)
    monkeypatch.setattr(search, "MOST", 128)
    monkeypatch.setattr(search, "CELLS", 9)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(map(tuple, search.top_k(vectors, 7).collect())) == top_by_hand(rows, 7)


def test_bpe(docs, rows, empty):
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(PATH, "rb"))}
    public = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rnd = bpe.Codec(bpe.Vocabulary.read(PATH), PATTERN), random.Random(2)
    odd = ["".join(rnd.choice(["a", "B", "é", "中", "🙂", "́", "\x1c", "\x85", "\xa0", " ", "\n", "\t", "'s", "1", "½", "-", "\x00", "ſ", "<|endoftext|>"]) for _ in range(rnd.randrange(30))) for _ in range(800)]
    ids = codec.encode_batch(odd)
    assert ids == [public.encode_ordinary(t) for t in odd]
    assert [codec.decode(x).decode() for x in ids] == odd
    encoded = bpe.encode(docs, PATH, PATTERN)
    assert encoded.columns == [*docs.columns, "ids"]
    assert {r.doc_id: r.ids for r in encoded.collect()} == {r[0]: public.encode_ordinary(r[1] or "") for r in rows}
    assert {r.doc_id: r.text for r in bpe.decode(encoded, PATH).collect()} == {r[0]: r[1] or "" for r in rows}
    want = Counter((r[0], len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows for x in [public.encode_ordinary(r[1] or "")])
    assert Counter(map(tuple, bpe.token_digests(docs, PATH, PATTERN).collect())) == want
    assert bpe.encode(empty, PATH, PATTERN).count() == 0
    taken = docs.withColumnRenamed("lang", "ids").withColumnRenamed("size", "IDS_2")
    again = bpe.round_trip(taken, PATH, PATTERN)
    assert again.columns == [*taken.columns, "ids_3", "decoded_sha256"]
    assert {r.doc_id: (r.ids_3, r.decoded_sha256) for r in again.select("doc_id", "ids_3", "decoded_sha256").collect()} == {r[0]: (public.encode_ordinary(r[1] or ""), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows}


def test_perfect_hash():
    keys = [f"key {i}".encode() for i in range(5000)]
    assert sorted(bpe.PerfectHash(keys).slots(keys).tolist()) == list(range(5000))


def test_pii(spark, docs, rows, empty):
    key = b"k"
    out = pii.replace_private(docs, key)
    assert out.columns == [*docs.columns, "n_entities"]
    got = {r.doc_id: r for r in out.collect()}
    for i, t, *_ in rows:
        assert got[i].n_entities == len(pii.detect(t))
        assert got[i].n_entities or got[i].text == t
    assert "555-3456" not in got[19].text and "Ann.Lee" not in got[19].text and "Meier" not in got[20].text
    card = lambda i: next(n for n in (f"4{i:014d}{d}" for d in range(10)) if pii.luhn(n))
    texts = [f"call +1 ({200 + i}) 555-{1000 + i} or a{i}@x.example.com; pay {card(i)}; from 10.0.{i % 256}.{i // 256}" for i in range(600)]
    more = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts)], "doc_id long, text string")
    new = {r.doc_id: r.text for r in pii.private_texts(more, key).collect()}
    assert all(new[i] == new[i + 600] for i in range(600))
    for kind in ("phone", "email", "card", "ipv4"):
        values = [v for i in range(600) for _, _, k, v in pii.detect(new[i]) if k == kind]
        assert len(values) == len(set(values)) == 600
        assert not {v for t in texts for _, _, k, v in pii.detect(t) if k == kind} & set(values)
    assert pii.private_texts(empty, key).count() == 0


def test_pii_ordinary_forms_of_secrets_and_numbers(spark):
    secrets = ['{"password": "hunter2222"}', "DB_PASSWORD=hunter2222", "AWS_SECRET_ACCESS_KEY=hunter2222", "auth_token=hunter2222", "password   =  hunter2222", "db-password: 'hunter2222'", "passwd => hunter2222", '\\"api_key\\": \\"hunter2222\\"']
    phones = ["01 23 45 67 89", "+33 1 23 45 67 89", "612 34 56 78", "+34 612 34 56 78", "0612345678", "01.23.45.67.89", "+34 612 345 678", "030 1234567", "0151/23456789", "+49 (0)30 1234567", "612345678", "0033 1 23 45 67 8"]
    v6 = ["2001:db8::8a2e:370:7334", "2001:0DB8:0:0:0:8A2E:370:7334", "fe80::1ff:fe23:4567:890a"]
    for kind, cases in (("secret", secrets), ("phone", phones), ("ipv6", v6)):
        for case in cases:
            assert [k for _, _, k, _ in pii.detect(f"so {case} it is")] == [kind], case
            assert [k for _, _, k, _ in pii.detect(f"{case}.")] == [kind], case
    out = {r.doc_id: r.text for r in pii.private_texts(spark.createDataFrame(list(enumerate(secrets + phones + v6)), "doc_id long, text string"), b"k").collect()}
    for i, case in enumerate(secrets + phones + v6):
        assert out[i] != case and "hunter" not in out[i]
        assert i >= len(secrets + phones) or re.sub(r"\d", "0", out[i]) == re.sub(r"\d", "0", case) or i < len(secrets)
    assert out[len(secrets + phones)].lower() == str(ipaddress.IPv6Address(out[len(secrets + phones) + 1].lower()))
    for phone in ("212-555-3456", "+1 (212) 555-3456", "+33 1 23 45 67 89", "01 23 45 67 89", "612 34 56 78"):
        assert [(k, e) for _, e, k, _ in pii.detect(f"{phone} 10 people")] == [("phone", len(phone))], phone
    for plain in ("password: ********", "at 10:20:30 or 1:2", "std::cout a::b ::1", "in 2019 and 2020, 1 234 567", "12 34 56 78", "tokenised = yes", "the key: something", "number 4111111111111112 is no card", "nor 9807915762804490"):
        assert pii.detect(plain) == [], plain
    assert [k for _, _, k, _ in pii.detect("4111 1111 1111 1111 and 0049 30 12345678")] == ["card", "phone"]


def test_pii_names_are_found_whole_and_stay_coherent(spark):
    cases = {
        "Mrs. Ada Okoro came. Okoro left, and Okoro's friend Ada. Dr. Okoro and Mrs. OKORO wrote.": "ada okoro",
        "Mrs. Anna Maria Lopez Garcia sat": "anna maria lopez garcia",
        "Mr. J. Smith, Mr J. R. R. Tolkien": "smith tolkien",
        "Mr O'Brien and Mr. O’Hara-Lane, Mrs. Brien's house": "brien hara lane",
        "Mr.\nSmith; Mr.\u00a0Jones": "smith jones",
        "Herr Prof. Dr. Meier und Frau von Stein; Señora Maria de la Cruz": "meier stein maria cruz",
        "госпожа Иванова и г-н Петров. Иванова ушла. Κύριος Παπαδόπουλος": "иванова петров παπαδόπουλος",
    }
    out = {r.doc_id: r.text for r in pii.private_texts(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string"), b"k").collect()}
    for i, names in enumerate(cases.values()):
        assert not [n for n in names.split() if n in out[i].lower()], out[i]
    words = out[0].replace(".", "").replace(",", "").split()
    given, family = words[1], words[2]
    assert out[0] == f"Mrs. {given} {family} came. {family} left, and {family}'s friend {given}. Dr. {family} and Mrs. {family.upper()} wrote."
    assert [v for *_, v in pii.detect("Mr. Smith\nThe next line. Mrs. Lee. Then")] == ["Smith", "Lee"]
    assert pii.detect("a Sir\n\nThank you, Miss. The end") == []


def test_sharding(docs, rows, empty):
    got = sharding.shard_documents(twice(docs), 4).collect()
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), "bytes", None) for r in got)
    assert len(got) == twice(docs).count()
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_documents(empty).count() == 0
    # The cuts by hand: the middle of each document in the order of doc_id (nulls first) falls into a 4th of the whole.
    order = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size))
    total, upto, want = sum(r.size for r in got), 0, Counter()
    for r in order:
        want[r.doc_id, (2 * upto + r.size) * 4 // (2 * total)] += 1
        upto += r.size
    assert Counter((r.doc_id, r.shard) for r in got) == want


def test_sharding_is_balanced_and_contiguous(spark):
    rnd = random.Random(4)
    docs = spark.createDataFrame([(i, "x" * rnd.randrange(200)) for i in range(5000)], "doc_id long, text string")
    got = sorted(sharding.shard_documents(docs).collect(), key=lambda r: r.doc_id)
    assert [r.shard for r in got] == sorted(r.shard for r in got)
    sums = Counter()
    for r in got:
        sums[r.shard] += r.size
    assert set(sums) == set(range(16)) and max(sums.values()) - min(sums.values()) <= 400
