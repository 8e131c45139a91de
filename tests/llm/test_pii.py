"""Surrogates against brute force, in scripts of several kinds, and where forms are full."""

import random
import re
from collections import Counter

from basalt.llm import pii


def replaced(spark, texts, key=b"k"):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(pii.private_texts(table, key).collect())]


def private_by_hand(texts, key):
    """What replace_private does, one step after another over lists."""
    spans = [pii.parts(pii.detect(t)) for t in texts]
    told = {}
    for own in spans:
        for *_, kind, value in own:
            if kind in ("person_f", "person_m"):
                told[value] = min(kind, told.get(value, kind))
    spans = [[(a, b, told.get(v, k) if k == "person_x" else k, v) for a, b, k, v in own] for own in spans]
    entities = {(k, v) for own in spans for *_, k, v in own if k != "initial"}
    values, pending, given, used = {v for _, v in entities}, sorted(entities), {}, set()
    for attempt in range(pii.ROUNDS):
        drawn = [(k.split("_")[0], pii.surrogate(key, k, v, attempt), k, v) for k, v in pending]
        for kind, new, k, v in sorted(drawn):  # the smallest entity first
            if new not in values and (kind, new) not in used:
                used.add((kind, new))
                given[k, v] = new
        pending = [e for e in pending if e not in given]
    assert not pending
    out = []
    for t, own in zip(texts, spans):
        for a, b, k, v in sorted(own, reverse=True):
            t = t[:a] + pii.dressed(k, t[a:b], given[k, v] if k != "initial" else pii.surrogate(key, k, v)) + t[b:]
        out.append(t)
    return out, given


def test_against_brute_force(spark):
    rnd, key = random.Random(9), b"some key"
    names = ["Ada Okoro", "Hans Meier", "Meier", "J. Meier", "Okoro", "Иван Петров", "王小明", "Νίκος Παππάς", "Anna-Lena von Stein"]
    make = [
        lambda: f"mail {rnd.choice('abcd')}{rnd.choice('abcd')}@x.example.com", lambda: f"call +49 30 {rnd.randrange(10**6, 10**7)}", lambda: f"{rnd.choice(['Mr.', 'Mrs.', 'Dr.', 'Frau', 'господин'])} {rnd.choice(names)} said",
        lambda: f"from 10.0.{rnd.randrange(3)}.{rnd.randrange(9)}", lambda: f"password: pass{rnd.randrange(30):02d}", lambda: f"{rnd.randrange(900):03d}-{rnd.randrange(90):02d}-6789", lambda: "Meier and Okoro went on",
    ]
    texts = [", ".join(rnd.choice(make)() for _ in range(rnd.randrange(5))) for _ in range(400)]
    want, given = private_by_hand(texts, key)
    assert replaced(spark, texts, key) == want
    assert len({(k.split("_")[0], v) for (k, _), v in given.items()}) == len(given)


def test_digits_of_other_scripts(spark):
    for zero in "٠०０":
        say = lambda t: "".join(chr(ord(zero) + int(c)) if c.isdigit() else c for c in t)
        cases = {"card": "4111 1111 1111 1111", "phone": "+49 30 1234567", "ssn": "123-45-6789", "ipv4": "192.168.1.20", "email": "a1b2@mail.example.com"}
        texts = [f"so {say(t)} it" for t in cases.values()] + [f"so {t} it" for t in cases.values()]
        assert [k for t in texts for _, _, k, _ in pii.detect(t)] == [*cases, *cases]
        out = replaced(spark, texts)
        for i, kind in enumerate(cases):
            assert out[i] != texts[i] and not any("0" <= c <= "9" for c in out[i])
            if kind != "email":  # one entity in both spellings
                assert pii.ascii_digits(out[i]) == out[i + len(cases)]


def test_full_forms_never_fail(spark):
    """All addresses of two letters at a host: no form is left, so names grow; and where none may grow, values are passed on."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"{a}{b}@x.example.com" for a in letters for b in letters]
    out = replaced(spark, texts)
    assert len(set(out)) == 676 and not set(out) & set(texts) and all(re.fullmatch(r"[a-z]{2,8}@[a-z]\.[a-z]{7}\.com", t) for t in out)
    scratch = pii.Scratch(spark)
    for rounds, entities in ((0, [("ssn", f"{n:09d}") for n in range(50)]), (1, [("email", f"{a}@h.com") for a in letters]), (0, [("ssn", "123456789")])):
        got = pii.surrogates(spark.createDataFrame(entities, "kind string, value string"), b"k", scratch, rounds).collect()
        assert Counter((r.kind, r.value) for r in got) == Counter(entities) and len({r.surrogate for r in got}) == len(entities)
        assert all(r.surrogate != r.value for r in got)


def test_persons_keep_script_gender_and_identity(spark):
    out = replaced(spark, ["Dr. Meier", "Mr. Meier", "Mr. Hans Meier", "Meier alone", "Mr. 王小明", "господин Иван Петров", "госпожа Анна Петрова"])
    family = out[0].split()[1]
    assert family != "Meier" and out[1] == f"Mr. {family}" and out[2].split()[2] == family and out[3] == "Meier alone"
    assert out[2].split()[1] in pii.GIVEN["LATIN"]["m"] and all(pii.script(c) == "CJK" for c in out[4][4:]) and len(out[4]) == 7
    assert out[5].split()[1] in pii.GIVEN["CYRILLIC"]["m"] and out[6].split()[1] in pii.GIVEN["CYRILLIC"]["f"] and out[5].endswith("ов") and out[6].endswith("ова")
    assert pii.script(pii.Stream(b"k", "x").like("ü")) == "LATIN" and not pii.Stream(b"k", "x").like("ü").isascii()


def test_columns_that_clash(spark, tmp_path):
    table = spark.createDataFrame([(1, "x@y.org", 5, 6), (2, None, None, None)], "doc_id long, text string, n_entities long, spans int")
    out = pii.replace_private(table, b"k")
    assert out.columns == ["doc_id", "text", "n_entities", "spans", "n_entities_2"]
    out.write.parquet(str(tmp_path / "out"))
    assert [tuple(r)[2:] for r in sorted(out.collect())] == [(5, 6, 1), (None, None, 0)]
