"""Quality rules as a ledger of failure bits and measurements, to which policies are applied."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Deleting these from UTF-8 leaves one byte for each code point outside white space.
NOT_COUNTED = SPACE + bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Each rule fails where its expression over the measurements is true; its place in the list is its bit. Rules are only ever added at the end.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("word_length", "word_chars < 3 * n_words OR word_chars > 9 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
)
BASE = ("few_words", "repeated_words")
#: Versions of policies: the rules that reject a document.
POLICIES = {1: BASE, 2: (*BASE, "symbols"), 3: (*BASE, "symbols", "word_length", "repeated_lines")}
LATEST = max(POLICIES)


def mask(rules) -> int:
    """The bits of the named rules."""
    names = [name for name, _ in RULES]
    return reduce(lambda bits, rule: bits | 1 << names.index(rule), rules, 0)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of `width` words that are found twice or more."""
    if len(words) <= width:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.uint64)
    if len(numbers) == len(words):
        return 0
    # Windows get exact numbers: a pair of numbers below n is a number below n * n, numbered anew below n.
    size = np.uint64(len(words) + 1)
    grams, have = ids, 1
    while have < width:
        step = min(have, width - have)
        grams = grams[:-step] * size + grams[step:]
        have += step
        if have < width:
            grams = np.unique(grams, return_inverse=True)[1].astype(np.uint64)
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(grams, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measurements of a text, in the order of MEASURES."""
    text = text or b""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(words), len(text.translate(None, NOT_COUNTED)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def _measured(batches):
    for batch in batches:
        rows = [measure(text) for text in batch.column(1).cast(pa.binary()).to_pylist()]
        columns = list(zip(*rows, strict=True)) or [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *MEASURES])


def ledger(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row (doc_id, the measurements, failures) for each document row; bit i of failures: RULES[i] fails.

    Words are runs of anything but ASCII white space, of the whole text. word_chars: code points
    in words; n_symbols: characters of `#*$%&|<>`; n_dup_lines: lines with a word that equal
    an earlier line; n_repeat_words: words in 5-word windows found twice or more in the text; n_lines: lines with a word.
    Each text is measured once, on its own; nothing is shuffled. Null and empty texts measure 0
    throughout and fail few_words. Repeated and null ids are rows like others.
    """
    rows = pick(docs, doc_id=id_column, text=text_column)
    kind = rows.schema["doc_id"].dataType.simpleString()
    measured = rows.mapInArrow(_measured, ", ".join([f"doc_id {kind}", *(f"{m} long" for m in MEASURES)]))
    bits = [F.when(F.expr(rule), 1 << i).otherwise(0) for i, (_, rule) in enumerate(RULES)]
    return measured.withColumn("failures", reduce(Column.bitwiseOR, bits).cast("long"))


def fails(rules) -> Column:
    """Whether a ledger row fails one of the rules."""
    return F.col("failures").bitwiseAND(F.lit(mask(rules))) != 0


def apply_policy(book: DataFrame, version: int = LATEST) -> DataFrame:
    """Add base_failed and kept to a ledger, by a version of the policy."""
    return book.withColumns({"base_failed": fails(BASE), "kept": ~fails(BASE) & ~fails(POLICIES[version])})


def ablations(book: DataFrame, version: int = LATEST) -> DataFrame:
    """One row (rule, n_failed, n_alone, n_rejected, n_without) for each rule of the policy.

    n_failed: rows that fail the rule; n_alone: that fail only it, of the policy; n_rejected: that the whole
    policy rejects; n_without: that the policy without the rule would. Rows are
    first counted by their bits, at most 2 ^ rules groups, from which every
    figure follows. An empty ledger gives zeros.
    """
    rules = POLICIES[version]
    bits = F.col("failures").bitwiseAND(F.lit(mask(rules)))
    counts = book.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.union(book.sparkSession.range(1).select(F.lit(0).cast("long"), F.lit(0).cast("long")))  # of an empty ledger too
    names = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in rules)))
    total = lambda where: F.sum(F.when(where, F.col("n")).otherwise(0)).alias
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not("bit")) != 0
    return counts.select("bits", "n", names.alias("r")).select("bits", "n", "r.*").groupBy("rule").agg(total(has)("n_failed"), total(has & ~rest)("n_alone"), total(F.col("bits") != 0)("n_rejected"), total(rest)("n_without"))
