"""A query for each operator over the star-schema tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import F64, I64, Arg, Cast, Const, with_expressions
from ..functions.types import char16, segment_id, segment_page_id, unsigned_key
from ..operators import index, relational as r, sorting
from ..operators.scratch import Scratch
from ..sources import u64

QUERIES, ORACLE = {}, {}
SIGNS = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str, name: str | None = None):
    """Register a function as a query, and its SQL."""

    def add(function):
        key = name or function.__name__
        QUERIES[key], ORACLE[key] = function, sql
        return function

    return add


@query("""SELECT c_name FROM (SELECT c_custkey, c_name, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey > 25 GROUP BY c_custkey, c_name ORDER BY n DESC, c_custkey)""")
def flagship_top_customers(spark, sf_dir):
    customers = r.project(r.select_i64(table(spark, sf_dir, "customer"), "c_custkey", "gt", 25), ["c_custkey", "c_name"])
    joined = r.hash_join(customers, r.project(table(spark, sf_dir, "orders"), ["o_custkey"]), 0, 0)
    grouped = r.hash_aggregate(joined, [0, 1], [("count", 0)])
    return r.project(r.sort(grouped, [(2, True), (0, False)]), [1])


@query("SELECT concat_ws(',', n_nationkey, n_name, n_regionkey) AS line FROM nation")
def print_csv_nation(spark, sf_dir):
    return r.lines(table(spark, sf_dir, "nation"))


@query("SELECT o_totalprice, o_orderkey FROM orders")
def project_reorder(spark, sf_dir):
    return r.project(table(spark, sf_dir, "orders"), [3, 0])


def _selections():
    for op, sign in SIGNS.items():
        query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey {sign} 750", f"select_i64_{op}")(
            lambda spark, sf_dir, op=op: r.project(r.select_i64(table(spark, sf_dir, "orders"), "o_custkey", op, 750), ["o_orderkey", "o_custkey"])
        )
        query(f"SELECT c_custkey, c_mktsegment FROM customer WHERE rpad(c_mktsegment, 16, ' ') {sign} 'HOUSEHOLD       '", f"select_char16_{op}")(
            lambda spark, sf_dir, op=op: r.project(r.select_char16(table(spark, sf_dir, "customer"), "c_mktsegment", op, "HOUSEHOLD"), ["c_custkey", "c_mktsegment"])
        )
        query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey {sign} l_suppkey", f"select_attr_attr_{op}")(
            lambda spark, sf_dir, op=op: r.project(r.select_attr(table(spark, sf_dir, "lineitem"), "l_partkey", op, "l_suppkey"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
        )


_selections()

SORTED = "l_suppkey DESC, l_partkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, row_number() OVER (ORDER BY {SORTED}) AS pos FROM lineitem")
def sort_multi_key(spark, sf_dir):
    order = [(c.split()[0], c.endswith("DESC")) for c in SORTED.split(", ")]
    return r.numbered(table(spark, sf_dir, "lineitem"), order, keep=["l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"])


@query("SELECT c_custkey, c_name, o_orderkey, o_custkey FROM customer JOIN orders ON c_custkey = o_custkey")
def hash_join_cust_orders(spark, sf_dir):
    left = r.project(table(spark, sf_dir, "customer"), ["c_custkey", "c_name"])
    return r.hash_join(left, r.project(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"]), 0, 1)


@query("SELECT c_custkey, c_mktsegment, s.k AS s_k FROM customer JOIN (VALUES ('BUILDING', 1), ('MACHINERY', 2)) s(n, k) ON c_mktsegment = s.n")
def hash_join_string_key(spark, sf_dir):
    left = spark.createDataFrame([("BUILDING", 1), ("MACHINERY", 2)], "n string, s_k int")
    return r.project(r.hash_join(left, table(spark, sf_dir, "customer"), "n", "c_mktsegment", strict_unique=True), ["c_custkey", "c_mktsegment", "s_k"])


@query("SELECT min(c_name) AS min_c_name, max(c_name) AS max_c_name, min(c_custkey) AS min_c_custkey, max(c_custkey) AS max_c_custkey FROM customer")
def agg_min_max_global(spark, sf_dir):
    return r.hash_aggregate(table(spark, sf_dir, "customer"), [], [("min", "c_name"), ("max", "c_name"), ("min", "c_custkey"), ("max", "c_custkey")])


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS sum_l_linenumber, count(*) AS count_l_linenumber FROM lineitem GROUP BY ALL")
def agg_sum_count_by_key(spark, sf_dir):
    return r.hash_aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], [("sum", "l_linenumber"), ("count", "l_linenumber")])


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def agg_keys_only(spark, sf_dir):
    return r.hash_aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("SELECT min(c_custkey) AS min_c_custkey, CAST(sum(c_custkey) AS BIGINT) AS sum_c_custkey, count(*) AS count_c_custkey FROM customer WHERE c_custkey < 0 HAVING count(*) > 0")
def agg_empty_global(spark, sf_dir):
    return r.hash_aggregate(r.select_i64(table(spark, sf_dir, "customer"), "c_custkey", "lt", 0), [], [("min", "c_custkey"), ("sum", "c_custkey"), ("count", "c_custkey")])


@query("SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 15")
def agg_having(spark, sf_dir):
    return r.select_i64(r.hash_aggregate(table(spark, sf_dir, "orders"), ["o_custkey"], [("count", "o_custkey")]), 1, "gt", 15).toDF("o_custkey", "n")


def _set_operations():
    def one(spark, sf_dir):
        right = r.select_i64(r.project(table(spark, sf_dir, "supplier"), ["s_nationkey"]), 0, "lt", 12)
        return r.project(table(spark, sf_dir, "customer"), ["c_nationkey"]).toDF("nationkey"), right

    def two(spark, sf_dir):
        rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nationkey"), char16("c_mktsegment").alias("segment"))
        return rows.filter("c_custkey % 3 <> 0").drop("c_custkey"), rows.filter("c_custkey % 3 = 0").drop("c_custkey")

    pair = "SELECT CAST(c_nationkey AS BIGINT) AS nationkey, rpad(c_mktsegment, 16, ' ') AS segment FROM customer WHERE c_custkey % 3"
    for name, words in (("union", "UNION"), ("union_all", "UNION ALL"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
        operation = getattr(r, name if name != "except" else "except_")
        query(f"SELECT CAST(c_nationkey AS BIGINT) AS nationkey FROM customer {words} SELECT CAST(s_nationkey AS BIGINT) FROM supplier WHERE s_nationkey < 12", name)(lambda spark, sf_dir, f=operation: f(*one(spark, sf_dir)))
        query(f"{pair} <> 0 {words} {pair} = 0", f"{name}_two_columns")(lambda spark, sf_dir, f=operation: f(*two(spark, sf_dir)))


_set_operations()


def _expressions():
    ints, doubles = (Arg("l_partkey"), Arg("l_linenumber")), (Arg("l_extendedprice", F64), Arg("l_quantity", F64))
    for name, sign in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/")):
        for kind, (a, b), sql in (("i64", ints, f"l_partkey {'//' if sign == '/' else sign} CAST(l_linenumber AS BIGINT)"), ("f64", doubles, f"l_extendedprice {sign} l_quantity")):
            tree = {"+": a + b, "-": a - b, "*": a * b, "/": a / b}[sign]
            query(f"SELECT l_orderkey, l_linenumber, l_partkey, {sql} AS x FROM lineitem", f"expr_{name}_{kind}")(
                lambda spark, sf_dir, tree=tree: with_expressions(table(spark, sf_dir, "lineitem"), x=tree).select("l_orderkey", "l_linenumber", "l_partkey", "x")
            )
    part, line, key = Arg("l_partkey"), Arg("l_linenumber"), Arg("l_orderkey")
    price, tax = Arg("l_extendedprice", F64), Arg("l_tax", F64)
    wrap = "CAST(CASE WHEN {0} >= 9223372036854775808 THEN {0} - 18446744073709551616 ELSE {0} END AS BIGINT)"
    trees = {
        "expr_cast_f64_i64": (Cast(Const(0.0) - price, I64), "CAST(trunc(0.0 - l_extendedprice) AS BIGINT)"),
        "expr_cast_i64_f64": (Cast(part, F64), "CAST(l_partkey AS DOUBLE)"),
        "expr_complex_i64": ((((Const(42) + key) * (Const(21) - part)) * line + Const(100)) / line, "(((42 + l_orderkey) * (21 - l_partkey)) * l_linenumber + 100) // CAST(l_linenumber AS BIGINT)"),
        "expr_complex_f64": (((Const(42.0) + price) - (Const(21.0) - tax)) + Const(100.0), "((42.0::DOUBLE + l_extendedprice) - (21.0::DOUBLE - l_tax)) + 100.0::DOUBLE"),
        "expr_complex_cast": (Cast((Const(42.0) + price) - (Const(21.0) - tax), I64) + part + Const(100), "CAST(trunc((42.0::DOUBLE + l_extendedprice) - (21.0::DOUBLE - l_tax)) AS BIGINT) + l_partkey + 100"),
        "expr_wrap_i64": (key * Const(4611686018427387904) + part, wrap.format("((CAST(l_orderkey AS HUGEINT) * 4611686018427387904 + l_partkey) % 18446744073709551616)")),
    }
    for name, (tree, sql) in trees.items():
        query(f"SELECT l_orderkey, l_linenumber, l_partkey, {sql} AS x FROM lineitem", name)(
            lambda spark, sf_dir, tree=tree: with_expressions(table(spark, sf_dir, "lineitem"), x=tree).select("l_orderkey", "l_linenumber", "l_partkey", "x")
        )


_expressions()

#: An odd factor that spreads keys over all 64 bits.
SPREAD = -7046029254386353131
MIXED = f"CAST(((CAST(o_orderkey AS HUGEINT) * {SPREAD % 2**64}) % 18446744073709551616) AS UBIGINT)"


@query(f"SELECT o_orderkey, CAST(row_number() OVER (ORDER BY {MIXED}) AS BIGINT) AS pos FROM orders")
def external_sort_positions(spark, sf_dir):
    values = with_expressions(r.project(table(spark, sf_dir, "orders"), ["o_orderkey"]), value=Arg("o_orderkey") * Const(SPREAD))
    return r.numbered(values.withColumn("key", unsigned_key(F.col("value"))), [("key", False)]).select("o_orderkey", F.col("pos").cast("bigint").alias("pos"))


@query(f"SELECT CAST({MIXED} AS VARCHAR) AS v, CAST(row_number() OVER (ORDER BY {MIXED}) AS BIGINT) AS pos FROM orders")
def external_sort_file(spark, sf_dir):
    """Values to a u64le file, that file sorted into another, and this one as it stands."""
    files = Scratch(spark)
    values = with_expressions(r.project(table(spark, sf_dir, "orders"), ["o_orderkey"]), value=Arg("o_orderkey") * Const(SPREAD))
    u64.write_keys(values.select(unsigned_key(F.col("value")).alias("key")), source := files.folder())
    sorting.external_sort(spark, source, target := files.folder(), 1 << 20)
    return u64.read_positions(spark, target).select(F.col("v").cast("string").alias("v"), "pos")


@query("SELECT o_orderkey, (o_custkey * 281474976710656 + o_orderkey) >> 48 AS segment, (o_custkey * 281474976710656 + o_orderkey) & 281474976710655 AS page FROM (SELECT o_orderkey, o_custkey % 32768 AS o_custkey FROM orders)")
def segment_page_split(spark, sf_dir):
    page = F.shiftleft(F.col("o_custkey") % 32768, 48) + F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", segment_id(page).alias("segment"), segment_page_id(page).alias("page"))


@query("SELECT o_orderkey, rpad(o_orderpriority, 16, ' ') AS priority FROM orders")
def char16_values(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", char16("o_orderpriority").alias("priority"))


def _base(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))


def _log(spark, sf_dir):
    """Changes of the keys that the events' users hash to."""
    events = table(spark, sf_dir, "events")
    return events.select((F.col("user_id") * 7).alias("k"), F.col("event_id").alias("v"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 10 == 0, "erase").otherwise("insert").alias("op"))


LOG = "(SELECT user_id * 7 AS k, event_id AS v, event_id AS seq, CASE WHEN event_id % 10 = 0 THEN 'erase' ELSE 'insert' END AS op FROM events)"
BASE = "(SELECT o_orderkey AS k, o_custkey AS v FROM orders)"


@query(f"SELECT q.k, b.v FROM (SELECT DISTINCT k FROM {LOG}) q LEFT JOIN {BASE} b USING (k)")
def index_lookup(spark, sf_dir):
    return index.lookup(_base(spark, sf_dir), _log(spark, sf_dir).select("k").distinct())


@query("SELECT o_orderkey AS k, o_custkey AS v FROM orders WHERE o_orderkey = 42")
def index_get(spark, sf_dir):
    return index.get(_base(spark, sf_dir), 42)


@query("SELECT o_orderkey AS k, o_custkey AS v, o_orderkey = 43 AS found FROM orders WHERE o_orderkey >= 43 ORDER BY 1 LIMIT 1")
def index_lower_bound(spark, sf_dir):
    return index.lower_bound(_base(spark, sf_dir), 43)


def _lower_bounds():
    for name, key in (("absent", 43), ("below_first", -5), ("past_last", 10**12)):
        query(f"SELECT 2 * o_orderkey AS k, o_custkey AS v, 2 * o_orderkey = {key} AS found FROM orders WHERE 2 * o_orderkey >= {key} ORDER BY 1 LIMIT 1", f"index_lower_bound_{name}")(
            lambda spark, sf_dir, key=key: index.lower_bound(_base(spark, sf_dir).withColumn("k", 2 * F.col("k")), key)
        )


_lower_bounds()


@query("SELECT o_orderkey AS k, o_custkey AS v, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS pos FROM orders")
def index_items(spark, sf_dir):
    return index.items(_base(spark, sf_dir))


@query(f"WITH last AS (SELECT k, arg_max(v, seq) AS v FROM {LOG} WHERE op = 'insert' GROUP BY k) SELECT k, coalesce(last.v, b.v) AS v FROM {BASE} b FULL JOIN last USING (k)")
def index_upsert(spark, sf_dir):
    return index.upsert(_base(spark, sf_dir), _log(spark, sf_dir).filter("op = 'insert'").drop("op"))


@query(f"SELECT k, v FROM {BASE} WHERE k NOT IN (SELECT k FROM {LOG} WHERE op = 'erase')")
def index_erase(spark, sf_dir):
    return index.erase(_base(spark, sf_dir), _log(spark, sf_dir).filter("op = 'erase'"))


@query(f"WITH last AS (SELECT k, arg_max(v, seq) AS v, arg_max(op, seq) AS op FROM {LOG} GROUP BY k) SELECT k, CASE WHEN op IS NULL THEN b.v ELSE last.v END AS v FROM {BASE} b FULL JOIN last USING (k) WHERE op IS NULL OR op <> 'erase'")
def index_apply_log(spark, sf_dir):
    return index.apply_log(_base(spark, sf_dir), _log(spark, sf_dir))
