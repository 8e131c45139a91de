"""Operators, expressions, files and the keyed table on small fixtures."""

import datetime
import os
import random
import struct
import subprocess
import sys
import time
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest

from basalt import cli
from basalt.functions.expr import F64, I64, Arg, Cast, Const, with_expressions
from basalt.functions.types import char16
from basalt.operators import index, relational as r, sorting
from basalt.operators.scratch import Scratch, shared_folder
from basalt.sources import u64
from basalt.streaming.changes import maintain


@pytest.fixture(scope="module")
def students(spark):
    df = spark.createDataFrame([(24002, "Xenokrates"), (26120, "Fichte"), (29555, "Feuerbach")], "matrnr long, name string")
    return df.withColumn("name", char16("name"))


@pytest.fixture(scope="module")
def grades(spark):
    return spark.createDataFrame([(24002, 5001, 1), (24002, 5041, 2), (29555, 4630, 2)], "matrnr long, course long, grade long")


@pytest.fixture(scope="module")
def sets(spark):
    return [spark.createDataFrame([(x,) for x in v], "v long") for v in ([1, 1, 2, 3, 3, 3], [2, 4, 4, 3, 3])]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_lines(students):
    assert [x.line for x in r.lines(students).collect()] == [f"{n},{s:16}" for n, s in ((24002, "Xenokrates"), (26120, "Fichte"), (29555, "Feuerbach"))]


def test_projection(grades):
    assert rows(r.project(grades, [2, 0])) == [(1, 24002), (2, 24002), (2, 29555)]
    assert r.project(grades, [0, 0]).columns == ["matrnr", "matrnr_2"]


@pytest.mark.parametrize("op,left", [("eq", [26120]), ("ne", [24002, 29555]), ("lt", [24002]), ("le", [24002, 26120]), ("gt", [29555]), ("ge", [26120, 29555])])
def test_selection(students, op, left):
    assert [x[0] for x in rows(r.select_i64(students, 0, op, 26120))] == left


def test_selection_types(spark, students):
    assert rows(r.select_char16(students, 1, "eq", "Feuerbach")) == [(29555, f"{'Feuerbach':16}")]
    for bad in (lambda: r.select_i64(students, 1, "eq", 1), lambda: r.select_char16(students, 0, "eq", "x"), lambda: r.select_attr(students, 0, "lt", 1)):
        with pytest.raises(TypeError):
            bad()
    assert r.select_attr(students, 0, "eq", 1).count() == 0 and r.select_attr(students, 0, "ne", 1).count() == 3
    blanks = spark.createDataFrame([("a", "a ")], "x string, y string")
    assert r.select_attr(blanks, 0, "eq", 1).count() == 0
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 3), (3, 2)], "l long, r long")
    assert rows(r.select_attr(pairs, 0, "ge", 1)) == [(1, 1), (2, 1), (3, 2)]


def test_sort(spark, grades):
    assert [tuple(x) for x in r.sort(grades, [(0, True), (2, False)]).collect()] == [(29555, 4630, 2), (24002, 5001, 1), (24002, 5041, 2)]
    rnd = random.Random(1)
    data = [(rnd.randrange(4), rnd.randrange(3), i) for i in range(200)]
    df = spark.createDataFrame(data, "a long, b long, c long")
    want = sorted(data, key=lambda x: (-x[0], x[1], -x[2]))
    assert [tuple(x) for x in r.sort(df, [(0, True), (1, False), (2, True)]).collect()] == want
    assert [tuple(x)[:3] for x in r.numbered(df, [(0, True), (1, False), (2, True)]).orderBy("pos").collect()] == want


def test_join(students, grades):
    joined = r.hash_join(students, grades, 0, 0, strict_unique=True, build="left")
    assert joined.columns == ["matrnr", "name", "matrnr_2", "course", "grade"] and joined.count() == 3
    with pytest.raises(ValueError):
        r.hash_join(grades, students, 0, 0, strict_unique=True)


def test_aggregation(spark, students, grades):
    assert rows(r.hash_aggregate(students, [], [("min", 1), ("max", 1)])) == [(f"{'Feuerbach':16}", f"{'Xenokrates':16}")]
    assert rows(r.hash_aggregate(grades, [0], [("sum", 2), ("count", 0)])) == [(24002, 3, 2), (29555, 2, 1)]
    assert r.hash_aggregate(grades.limit(0), [], [("min", 0), ("sum", 0), ("count", 0)]).count() == 0
    assert rows(r.hash_aggregate(grades, [0])) == [(24002,), (29555,)]
    big = spark.createDataFrame([(2**63 - 1,), (2,)], "x long")
    assert rows(r.hash_aggregate(big, [], [("sum", 0)])) == [(-(2**63) + 1,)]
    with pytest.raises(TypeError):
        r.hash_aggregate(students, [], [("sum", 1)])


def test_set_operations(spark, sets):
    a, b = sets
    want = {"union": [1, 2, 3, 4], "union_all": [1, 1, 2, 2, 3, 3, 3, 3, 3, 4, 4], "intersect": [2, 3], "intersect_all": [2, 3, 3], "except_": [1], "except_all": [1, 1, 3]}
    assert {name: [x[0] for x in rows(getattr(r, name)(a, b))] for name in want} == want
    one, two = (spark.createDataFrame([(2,)] * n, "v long") for n in (1, 2))
    assert r.intersect_all(one, two).count() == 1


def wrapped(x):
    return (x + 2**63) % 2**64 - 2**63


def test_expressions(spark):
    rnd = random.Random(0)
    data = [tuple(wrapped(rnd.getrandbits(64)) for _ in range(4)) for _ in range(300)]
    a = [Arg(i) for i in range(4)]
    tree = (((Const(42) + a[1]) * (Const(21) - a[0]) * a[2]) + Const(100)) / a[3]
    got = with_expressions(spark.createDataFrame(data, "a long, b long, c long, d long"), x=tree)
    for row in got.collect():
        top = wrapped(wrapped(wrapped(wrapped(42 + row[1]) * wrapped(21 - row[0])) * row[2]) + 100)
        assert row.x == abs(top) // abs(row[3]) * (1 if (top < 0) == (row[3] < 0) else -1)
    doubles = spark.createDataFrame([(2.9, -2.9, 7)], "x double, y double, n long")
    got = with_expressions(doubles, p=Cast(Arg(0, F64), I64), q=Cast(Arg(1, F64), I64), s=Cast(Arg(2), F64)).first()
    assert (got.p, got.q, got.s) == (2, -2, 7.0)
    with pytest.raises(TypeError):
        Const(1) + Const(1.0)


def test_set_operations_on_tuples(spark):
    """Rows of a number and a padded string are compared whole, as multisets too."""
    a = [(1, "x"), (1, "x"), (1, "y"), (2, "x"), (2, "x "), (None, "z")]
    b = [(1, "x"), (2, "y"), (2, "x"), (2, "x"), (2, "x"), (None, "z")]
    left, right = (spark.createDataFrame(rows_, "n long, s string").withColumn("s", char16("s")) for rows_ in (a, b))
    ca, cb = (Counter((n, f"{t:16}") for n, t in rows_) for rows_ in (a, b))
    want = {"union": Counter(set(ca) | set(cb)), "union_all": ca + cb, "intersect": Counter(set(ca) & set(cb)), "intersect_all": ca & cb, "except_": Counter(set(ca) - set(cb)), "except_all": ca - cb}
    assert {name: Counter(map(tuple, getattr(r, name)(left, right).collect())) for name in want} == want


def test_expressions_are_checked_by_thread(spark):
    """Wrapping sums and checked divisions built at once by several threads keep their modes."""
    table = spark.createDataFrame([(2**63 - 1, 1)], "a long, b long")

    def built(i):
        if i % 2:
            return with_expressions(table, x=Arg(0) + Arg(1)).first().x
        return with_expressions(table, x=Arg(0) / (Arg(1) * Const(3))).first().x

    with ThreadPoolExecutor(4) as threads:
        assert list(threads.map(built, range(8))) == [(2**63 - 1) // 3, -(2**63)] * 4
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_other_types_differ(spark):
    table = spark.createDataFrame([(1.0, datetime.date(2020, 1, 1), True)], "x double, d date, b boolean")
    assert r.select_attr(table, "x", "eq", "d").count() == 0 and r.select_attr(table, "x", "ne", "d").count() == 1
    for bad in (lambda: r.select_attr(table, "d", "lt", "b"), lambda: r.hash_join(table, table, "x", "d"), lambda: r.union(table.select("x"), table.select("d"))):
        with pytest.raises(TypeError):
            bad()


@pytest.mark.parametrize("op", list(r.COMPARE))
def test_padded_comparison(spark, tmp_path, op):
    """The bounds that the scan gets take no row away, and get there."""
    rnd = random.Random(7)
    letters = ["a", "b", " ", "\x01", "é", "~"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 2, 3, 15, 16, 17, 20]))) for _ in range(500)] + ["a" * n for n in range(20)]
    spark.createDataFrame([(t,) for t in texts], "s string").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    fixed = lambda t: t.ljust(16)[:16].encode()
    for value in ["a", "a b", "", " ", "a\x01b", "a" * 16, "ab" * 10, texts[4], texts[7]]:
        got = r.select_char16(table, 0, op, value)
        assert Counter(x.s for x in got.collect()) == Counter(t for t in texts if r.COMPARE[op](fixed(t), fixed(value)))
    plan = r.select_char16(table, 0, op, "ab")._jdf.queryExecution().executedPlan().toString()
    assert {"eq": "StringStartsWith(s,ab)", "gt": "GreaterThanOrEqual(s,ab)", "ge": "GreaterThanOrEqual(s,ab)", "lt": "Or(LessThanOrEqual(s,ab", "le": "Or(LessThanOrEqual(s,ab", "ne": ""}[op] in plan


def test_numbering_is_one_shuffle(spark):
    table = spark.range(1000).selectExpr("id % 7 AS a", "id AS b", "'x' AS c")
    got = r.numbered(table, [("a", True), ("b", False)], keep=["b"])
    assert got.columns == ["b", "pos"]
    assert [x.b for x in got.orderBy("pos").collect()] == sorted(range(1000), key=lambda n: (-(n % 7), n))
    assert r.in_order(table.limit(0)).count() == 0


def test_write_lines(spark, tmp_path, students):
    r.write_lines(students, str(tmp_path / "lines"))
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "lines")).collect())[1] == f"26120,{'Fichte':16}"


@pytest.mark.parametrize("values", [[], [0xABAB42F00F00], [10, 5, 7, 9, 11, 12, 3, 8, 1, 4, 6, 2], [0, 2**63 - 1, 2**63, 2**64 - 1, 2**64 - 1], [7] * 3000, [random.Random(0).getrandbits(64) for _ in range(5000)]])
@pytest.mark.parametrize("size", [None, 1 << 10])
def test_external_sort(spark, tmp_path, values, size):
    (tmp_path / "in").write_bytes(struct.pack(f"<{len(values)}Q", *values))
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "part-000099.u64").write_bytes(b"stale###")
    sorting.external_sort(spark, str(tmp_path / "in"), str(tmp_path / "out"), size)
    parts = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert list(struct.unpack(f"<{len(values)}Q", parts)) == sorted(values)
    assert [int(x.v) for x in u64.read(spark, str(tmp_path / "out")).orderBy("v").collect()] == sorted(values)


def test_records_of_other_stores(spark, tmp_path):
    values = [0, 1, 2**63 - 1, 2**63, 2**64 - 1, 0x0102030405060708]
    (tmp_path / "in").write_bytes(struct.pack("<6Q", *values))
    assert sorted(int(x.v) for x in u64.values(u64.read_records(spark, f"file://{tmp_path}/in")).collect()) == sorted(values)
    for path in (f"file://{tmp_path}/in", f"file:{tmp_path}/in"):
        assert [int(x.v) for x in u64.read(spark, path).collect()] == values
    spark.conf.set("fs.viewfs.mounttable.tests.link./in", f"file://{tmp_path}")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tests.link./in", f"file://{tmp_path}")
    assert sorted(int(x.v) for x in u64.read(spark, "viewfs://tests/in/in").collect()) == sorted(values)
    with pytest.raises(ValueError):
        u64.write_keys(spark.range(1).toDF("key"), "viewfs://tests/in/out")
    with pytest.raises(Exception, match="(?i)no.?such|not.?found"):
        u64.read(spark, str(tmp_path / "none")).collect()


def test_cli(spark, tmp_path, capsys):
    for wrong in ([], ["sort", "x"], ["generate", "x", "y"], ["print", "--random", "x"], ["sort", "a", "b", "x"], ["nothing", "x"]):
        assert cli.main(wrong) == 2
    assert cli.main(["--help"]) == 0 and "generate" in capsys.readouterr().out
    one, two, three = (str(tmp_path / n) for n in ("one", "two", "three"))
    assert cli.main(["generate", "1000", one]) == 0 and struct.unpack("<1000Q", (tmp_path / "one").read_bytes()) == tuple(range(1000, 0, -1))
    assert cli.main(["sort", one, two, "1024"]) == 0 and struct.unpack("<1000Q", (tmp_path / "two").read_bytes()) == tuple(range(1, 1001))
    assert cli.main(["generate", "--random", "1000", one]) == 0 and cli.main(["sort", one, three]) == 0
    drawn = struct.unpack("<1000Q", (tmp_path / "one").read_bytes())
    assert struct.unpack("<1000Q", (tmp_path / "three").read_bytes()) == tuple(sorted(drawn)) and len(set(drawn)) == 1000
    assert cli.main(["sort", one, three + "s/"]) == 0 and list((tmp_path / "threes").glob("part-*.u64"))
    capsys.readouterr()
    assert cli.main(["print", two]) == 0 and capsys.readouterr().out.split() == [str(n) for n in range(1, 1001)]
    assert cli.main(["print", str(tmp_path / "none")]) == 1 and "Error" in capsys.readouterr().err
    assert not [p for p in tmp_path.iterdir() if p.name.count(".")]


def test_keyed_table(spark, tmp_path):
    rnd = random.Random(2)
    log = [(rnd.randrange(100), i, i, rnd.choice(["insert"] * 9 + ["erase"])) for i in range(630)]
    table, model = index.KeyedTable(spark, str(tmp_path / "t")), {}
    assert table.read() is None
    for part in (log[:300], log[300:]):
        table.apply(spark.createDataFrame(part, "k long, v long, seq long, op string"))
    for k, v, _, op in log:
        model.pop(k, None) if op == "erase" else model.update({k: v})
    assert dict(map(tuple, table.read().collect())) == model
    asked = spark.createDataFrame([(k,) for k in range(110)], "k long")
    assert dict(map(tuple, index.lookup(table.read(), asked).collect())) == {k: model.get(k) for k in range(110)}
    assert Counter(x.k for x in index.erase(table.read(), asked.filter("k < 50")).collect()) == Counter(k for k in model if k >= 50)
    assert index.lower_bound(table.read(), 3).first().k == min(k for k in model if k >= 3)
    bound = lambda k: [tuple(x) for x in index.lower_bound(table.read(), k).collect()]
    assert bound(-5) == [(min(model), model[min(model)], False)] and bound(max(model) + 1) == [] and bound(max(model)) == [(max(model), model[max(model)], True)]
    assert [tuple(x) for x in index.items(table.read()).orderBy("pos").collect()] == [(k, model[k], n) for n, k in enumerate(sorted(model), 1)]


def test_keyed_table_adds_changes_and_compacts(spark, tmp_path):
    """Few changes are not a rewriting; after some, all is written anew and old files go; readers keep what they opened."""
    table, model = index.KeyedTable(spark, str(tmp_path / "t"), changes=3), {k: k for k in range(50)}
    table.write(spark.range(50).selectExpr("id AS k", "id AS v"))
    first, sizes = table.read(), []
    for n in range(9):
        table.apply(spark.createDataFrame([(n, 100 + n, 2, "insert"), (n, 7, 1, "erase"), (n + 20, 0, 5, "erase"), (n + 20, 9, 5, "insert")] + [(40 + n, None, 1, "erase")], "k long, v long, seq long, op string"))
        model.update({n: 100 + n, n + 20: 9})
        model.pop(40 + n)
        assert dict(map(tuple, table.read().collect())) == model
        if n == 2:
            assert dict(map(tuple, first.collect())) == {k: k for k in range(50)}
        sizes.append(len(list((tmp_path / "t").glob("data-*"))))
    assert sizes[:3] == [2, 3, 4] and max(sizes) <= 8 and len(list((tmp_path / "t").glob("current-*[0-9]"))) <= 2


def test_streaming_into_a_keyed_table(spark, tmp_path):
    rnd = random.Random(3)
    log = [(rnd.randrange(30), i, i, rnd.choice(["insert"] * 4 + ["erase"])) for i in range(200)]
    for n in range(4):
        spark.createDataFrame(log[n * 50 : n * 50 + 50], "k long, v long, seq long, op string").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        time.sleep(1.1)  # files are taken by time
    table, model = index.KeyedTable(spark, str(tmp_path / "t")), {}
    stream = spark.readStream.schema("k long, v long, seq long, op string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    maintain(stream, table).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    for k, v, _, op in log:
        model.pop(k, None) if op == "erase" else model.update({k: v})
    assert dict(map(tuple, table.read().collect())) == model


def test_scratch(spark, tmp_path):
    scratch = Scratch(spark)
    kept = scratch.keep(spark.range(5))
    assert kept.count() == 5 and kept._scratch.startswith(shared_folder(spark))
    scratch.drop(kept)
    with pytest.raises(Exception):
        kept.count()

    class Cluster:
        master = "spark://somewhere:7077"
        applicationId = "app"

    class Session:
        conf, sparkContext = type("Conf", (), {"get": lambda self, name, default: default})(), Cluster

    with pytest.raises(RuntimeError):  # no folder of this machine in place of a shared one
        shared_folder(Session)


def test_entry_without_the_subpackage(tmp_path):
    """What the subpackage needs may lack; the other queries stay. The flagship gives rows."""
    run = """
import sys
sys.path.insert(0, sys.argv[1])
sys.modules["xxhash"] = None
import __spark_entry__ as e
assert len(e.queries()) > 60 and not [n for n in e.queries() if n.startswith("op1")] and set(e.oracle_sql()) <= set(e.queries())
"""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", run, repo], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
