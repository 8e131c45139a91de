"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import numbered
from .common import WORD, Scratch, pick, sealed, small

#: Rows over which one running count goes, and parts of such rows over which the next goes.
PART_ROWS, PARTS = 250, 1_000
#: Weights that the sources take in turn, the mix's share of all words, and the most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0


def targets(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add target to a table (source, source_size) of all sources.

    Sources in code point order, null last, take the weights in turn and share
    `share` times the whole size by them. No target is above `most`
    times its source's size; the rest is shared by weight among the others. Each round
    is one aggregation, which tells what is left for how much weight; it ends when no more sources are capped.
    """
    ranked = numbered(sizes.select("source", "source_size", F.col("source").isNull().alias("last")), [("last", False), ("source", False)], "number")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    ranked = scratch.keep(ranked.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap")))
    total = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    left, shared = share * (total.size or 0), total.weight or 1.0
    while True:
        full = F.col("cap") / F.col("weight") <= left / shared
        now = ranked.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("capped"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if not now.weight or now.weight == shared:
            break
        left, shared = share * total.size - now.capped, now.weight
    return ranked.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.col("weight") * left / shared).alias("target"))


def _keyed(rows: DataFrame, seed: int) -> DataFrame:
    """Add class (of sizes) and key (a hash of doc_id and text) to rows with doc_id, source, text and size, in place of the text."""
    width = F.length(F.bin("size"))
    level = width * 8 + F.expr("shiftright(shiftleft(size, 4), length(bin(size)))") - 8
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    return rows.withColumns({"class": level.cast("int"), "key": key}).drop("text")


def _copies(rows: DataFrame, narrow: DataFrame, scratch: Scratch, seed: int, rule: dict) -> DataFrame:
    """Add source_size, target and copies to keyed rows; narrow: (source, class, key, size) of the same rows, written."""
    spread = F.expr("cast(conv(substring(key, 1, 8), 16, 10) as bigint)")
    groups = narrow.groupBy("source", "class").agg(F.count("size").alias("n"), F.sum("size").alias("words"))
    groups = scratch.keep(groups.withColumn("parts", F.ceil(F.col("n") / PART_ROWS)))
    whole = targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), scratch, **rule)
    draw = F.expr("shiftright(cast(conv(substring(md5(concat('offset', %d, coalesce(source, ''), source is null)), 1, 8), 16, 10) as bigint), 12) / 1048576" % seed)
    whole = small(scratch.keep(whole.withColumns({"rate": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0), "draw": draw})))

    same = lambda a, b, *names: [a["source"].eqNullSafe(b["source"]), *(a[x] == b[x] for x in names)]
    parts = small(groups.select("source", "class", "parts"))
    part = F.floor(spread * F.col("parts") / F.lit(2**32)).alias("part")
    split = lambda t: t.join(parts, same(t, parts, "class"), "left").select(*(t[x] for x in t.columns), part)
    # Rows before a part: of the parts before it in its stretch of PARTS, and of the stretches before in the source.
    before = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys[0]).orderBy(*keys[1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = scratch.keep(split(narrow).groupBy("source", "class", "part").agg(F.count("size").alias("n")).withColumn("stretch", F.floor(F.col("part") / PARTS)))
    stretches = counted.groupBy("source", "class", "stretch").agg(F.sum("n").alias("n"))
    stretches = small(scratch.keep(stretches.select("source", "class", "stretch", before(["source"], ["class", "stretch"]).alias("first"))))
    inner = counted.withColumn("inner", before(["source", "class", "stretch"], ["part"]))
    placed = inner.join(stretches, same(inner, stretches, "class", "stretch")).select(inner["source"], inner["class"], "part", (F.col("first") + F.col("inner")).alias("before"))
    offsets = placed.join(whole, same(placed, whole)).select(placed["source"], "class", "part", "before", "rate", "draw", "source_size", "target")
    offsets = small(scratch.keep(offsets))

    inside = Window.partitionBy("source", "class", "part").orderBy("key")
    ranked = split(rows).withColumn("nth", F.row_number().over(inside))
    met = ranked.join(offsets, same(ranked, offsets, "class", "part"))
    upto = lambda n: F.floor((F.col("before") + n) * F.col("rate") + F.col("draw"))
    copies = upto(F.col("nth")) - upto(F.col("nth") - 1)
    return met.select(*(ranked[x] for x in rows.columns), "source_size", "target", copies.alias("copies"))


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_plan(docs: DataFrame, *, seed: int = 7, **rule) -> DataFrame:
    """One row (doc_id, size, source_size, target, taken) for each row of documents.

    size counts words, taken is copies times size. Each document of a source
    is expected target / source_size times (at most 2). Documents of a source stand
    in the order of size class (eight to each power of 2) and
    key (a hash of doc_id and text); expected copies are summed along that order, one random
    offset of the source is added, and a document is emitted once for each
    integer crossed. As neighbours have like sizes, the taken words come
    near the target. Running counts go over hashed parts of (source, size class)
    of some 250 rows, whose offsets come from counts combined map-side, summed in
    stretches of parts, so that a hot source is dealt over many tasks and no window is longer than its
    source's stretches. The same input, seed and rule give the same result, however it is partitioned.

    Null or empty texts have size 0. The null source is a source, last in order. A null
    doc_id counts as empty. Repeated rows are drawn one by one. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    rows = pick(docs, doc_id="doc_id", source="source", text="text").withColumn("size", _size("text"))
    rows = scratch.keep(_keyed(rows, seed))
    drawn = _copies(rows, rows.select("source", "class", "key", "size"), scratch, seed, rule)
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, *, seed: int = 7, **rule) -> DataFrame:
    """The documents themselves, as often as `mix_plan` draws each (many not at all, some twice); columns as given.

    Nulls, empty texts, repeated rows and an empty table are as in `mix_plan`. Each document goes to its part's task with all
    columns, where it is ranked; counts and offsets come from narrow rows.
    """
    scratch = Scratch(docs.sparkSession)
    plain, names, new = sealed(docs)
    keyed = {"doc_id": F.col(new["doc_id"]), "source": F.col(new["source"]), "text": F.col(new["text"]), "size": _size(new["text"])}
    rows = _keyed(plain.withColumns(keyed), seed)
    drawn = _copies(rows, scratch.keep(rows.select("source", "class", "key", "size")), scratch, seed, rule)
    out = drawn.filter("copies > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return out.select(*names).toDF(*docs.columns)
