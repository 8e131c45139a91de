"""URL filters: rules on hosts and path prefixes, matched by hash prefix and confirmed by full digest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, pick, small

#: Hex digits of the digest that the join is on; the rest only confirms.
PREFIX = 8


def rule_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules given as (verdict, "host/path") in a table (host, path, verdict)."""
    rows = [(verdict, *rule.partition("/")) for verdict, rule in rules]
    return spark.createDataFrame([(host, slash + path, verdict) for verdict, host, slash, path in rows], "host string, path string, verdict string")


def split_url(url) -> tuple:
    """Host (A-Z lower-cased) and path of a url column; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """One row (page_id, host, path, rule, verdict) for each page row.

    A rule (host, path, verdict) fits its host and all subdomains where the
    url's path starts with the rule's path. The longest rule wins; of two with
    the same host and path, `block`. Where none fits, rule is null and the
    verdict is `default`.

    Each url is expanded into (host suffix, path prefix) expressions by array functions, of the
    (labels, length) shapes that the rules have: they are one literal map from numbers of labels to path lengths, as
    long as the rules' shapes are different and not as the rules are many. Expressions meet rules by an equi-join on the
    first 8 hex digits of SHA-256 alone; of what meets, the full digest confirms a rule. Rules are
    broadcast up to a size limit and otherwise shuffled. Rows are grouped by
    (id, host, path) and the partition that they are read in, and combined there, so repeated rows or a hot host
    never meet in one task, and keep their number.

    A null url or one without `://` has an empty host and path. A null id is an id
    like others. Rules without host or verdict are none. Empty tables of pages give no rows, empty rules the default.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
    rules = rules.filter("r_host IS NOT NULL AND r_verdict IS NOT NULL").withColumn("rule", F.concat("r_host", "r_path"))
    rules = rules.groupBy("r_host", "r_path", "rule").agg(F.max("r_verdict").alias("r_verdict"))  # block after allow
    digest = F.sha2("rule", 256)
    shapes = rules.groupBy(F.size(F.split("r_host", r"\.")).alias("labels")).agg(F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths")).collect()
    shapes = F.from_json(F.lit(json.dumps({str(s.labels): s.lengths for s in shapes})), "map<string, array<int>>")
    rules = rules.select(F.substring(digest, 1, PREFIX).alias("prefix"), digest.alias("digest"), F.struct(F.length("rule"), "r_verdict", "rule").alias("found"))

    host, path = split_url(F.col("url"))
    rows = pick(pages, page_id=id_column, url=url_column).select("page_id", host.alias("host"), path.alias("path"))
    labels = F.size(F.split("host", r"\."))
    prefixes = lambda n: F.filter(F.coalesce(F.try_element_at(shapes, n.cast("string")), F.array().cast("array<int>")), lambda x: x <= F.length("path"))
    fitting = lambda n: F.transform(prefixes(n), lambda x: F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -n), F.substring("path", 1, x)))
    expressions = F.flatten(F.transform(F.sequence(F.lit(1), labels), fitting))
    # The null at place 0 stands for the row itself.
    rows = rows.select("page_id", "host", "path", F.spark_partition_id().alias("read_in"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), expressions)).alias("place", "expression"))
    rows = rows.withColumn("hash", F.sha2("expression", 256))
    met = rows.join(small(rules), F.substring("hash", 1, PREFIX) == F.col("prefix"), "left")
    confirmed = F.max(F.when(F.col("hash") == F.col("digest"), F.col("found")))
    best = met.groupBy("page_id", "host", "path", "read_in").agg(confirmed.alias("found"), F.sum((F.col("place") == 0).cast("int")).alias("times"))
    return best.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.r_verdict", F.lit(default)).alias("verdict"),
        F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("copy"),
    ).drop("copy")
