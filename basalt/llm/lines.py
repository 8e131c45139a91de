"""Line dedup: drop long lines that many documents share, except in one of them."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fits, pick, sealed, small


def _key(line: bytes) -> bytes:
    """bytes.strip and bytes.lower are the ASCII ones."""
    return line.strip().lower()


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and len(key.decode("utf-8", "replace")) >= least


def _fingerprint(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _explode(least: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            prints, owners, ties = [], [], []
            for owner, tie, text in zip(ids, batch.column(2).to_pylist(), texts, strict=True):
                found = {_fingerprint(key) for line in (text or b"").split(b"\n") if _long(key := _key(line), least)}
                prints += found
                owners += [owner] * len(found)
                ties += [tie] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(owners, batch.schema.field(0).type), pa.array(ties, pa.int64())], ["line", "owner", "tie"])

    return run


def _kept(text: bytes | None, drop, least: int) -> tuple[int, int, bytes]:
    lines = (text or b"").split(b"\n")
    if not drop:
        return len(lines), 0, text or b""
    drop = set(drop)
    kept = [line for line in lines if not (_long(key := _key(line), least) and _fingerprint(key) in drop)]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _rows(batch, least):
    for text, drop in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("drop").to_pylist(), strict=True):
        yield text, drop, *_kept(text, drop, least)


def _reassemble(least: int):
    def run(batches):
        for batch in batches:
            rows = list(_rows(batch, least))
            texts = pa.array([text if dropped == 0 else kept for text, _, _, dropped, kept in rows], pa.binary()).cast(pa.string())
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", texts).drop_columns(["drop"])

    return run


def _digest(least: int):
    def run(batches):
        for batch in batches:
            rows = list(_rows(batch, least))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[4]).hexdigest() for r in rows])],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return run


def _with_drops(rows: DataFrame, scratch: Scratch, least: int, documents: int) -> DataFrame:
    """Add drop, the fingerprints of lines to drop (null: none), to rows with doc_id and text."""
    columns = rows.columns
    rows = rows.withColumn("tie", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    lines = scratch.keep(rows.select("doc_id", "text", "tie").mapInArrow(_explode(least), f"line binary, owner {kind}, tie long"))
    # Documents are told apart before lines are counted. The first grouping spreads a hot line by its owners, the second combines it map-side.
    held = lines.filter("owner IS NOT NULL").groupBy("line", "owner").agg(F.lit(1).alias("one"))
    shared = held.groupBy("line").agg(F.count("one").alias("n"), F.max("owner").alias("holder")).filter(F.col("n") >= documents)
    shared = scratch.keep(shared.select("line", "holder"))
    dropped = lines.join(small(shared), "line").filter(~F.col("owner").eqNullSafe(F.col("holder")))
    dropped = scratch.keep(dropped.groupBy("owner", "tie").agg(F.collect_set("line").alias("drop")))  # of the lines of one text
    scratch.drop(lines, shared)
    def met(part, how):
        return part.join(dropped.hint("shuffle_hash"), part["doc_id"].eqNullSafe(dropped["owner"]) & (part["tie"] == dropped["tie"]), how).select(*columns, "drop")

    keys = dropped.select(F.xxhash64("owner", "tie").alias("key"))
    if not fits(keys):  # too many to tell beforehand which texts need the join
        return met(rows, "left")
    keys, own = F.broadcast(keys), F.xxhash64("doc_id", "tie") == F.col("key")
    whole = rows.join(keys, own, "left_anti").select(*columns, F.lit(None).cast("array<binary>").alias("drop"))
    return whole.union(met(rows.join(keys, own, "left_semi"), "left"))  # a few texts may only share the hash with one


def line_digests(docs: DataFrame, *, least: int = 40, documents: int = 5) -> DataFrame:
    """One row (doc_id, n_lines, n_dropped, kept_sha256) for each document row, after `dedup_lines`."""
    rows = pick(docs, doc_id="doc_id", text="text")
    found = _with_drops(rows, Scratch(docs.sparkSession), least, documents)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "text", "drop").mapInArrow(_digest(least), f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(docs: DataFrame, *, least: int = 40, documents: int = 5) -> DataFrame:
    """The documents without lines that many of them share; columns and rows as given.

    Texts are split at \\n. A line's key is the line without ASCII white space at both ends, A-Z
    lower-cased. Keys of at least `least` code points that at least `documents`
    different doc_ids hold lose all their lines, except in the largest doc_id that holds
    them (all such lines in it stay). What stays is joined by \\n again.

    Distinct keys of a text go by a 128-bit fingerprint and are written once. They are grouped by key and owner, then by key
    with counts and largest ids combined map-side, so a line that
    a third of the documents share is spread over tasks first and a row for each of them then. The fingerprints
    over the limit are joined back to the texts' own and collected per text. While the keys of texts with any are few
    enough to broadcast, only these texts are shuffled; beyond that all are, hashed and not sorted.

    A null or empty text is one empty line and stays as it is. Rows that share a doc_id are one document: it counts once for
    a line, and if it is the largest that holds it, all its rows keep theirs. Rows without doc_id
    count for no line and hold none, but lose those over the limit like others. A document may lose all its lines; its text is then empty.
    An empty table gives none.
    """
    plain, _, new = sealed(docs)
    rows = plain.withColumnsRenamed({new["doc_id"]: "doc_id", new["text"]: "text"})
    found = _with_drops(rows, Scratch(docs.sparkSession), least, documents)
    return found.select(*rows.columns, "drop").mapInArrow(_reassemble(least), rows.schema).toDF(*docs.columns)
