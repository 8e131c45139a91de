"""A training corpus from raw documents, in five stages; counted as part of basalt.llm."""

from __future__ import annotations

import public_tokenizers

from basalt.llm import bpe, lines, minhash, mixing, toxicity
from basalt.llm.common import Scratch, bounded_batches


def toxicity_stage(spark, docs, sf_dir):
    """Documents that the toxicity models reject go."""
    bounded_batches(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark, docs, sf_dir):
    """Lines that many documents share stay in one of them."""
    bounded_batches(spark)
    return lines.dedup_lines(docs)


def near_dedup_stage(spark, docs, sf_dir):
    """One document of each near-duplicate group stays; sets are of five-word shingles."""
    bounded_batches(spark)
    return minhash.dedup_documents(docs)


def mixing_stage(spark, docs, sf_dir):
    """Documents as often as their source's target weight says."""
    return mixing.mix_documents(docs)


def encoding_stage(spark, docs, sf_dir):
    """Byte-level BPE tokens behind the documents' columns, and the digest of the text that they decode to."""
    bounded_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]
#: Training and near-duplicate groups are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """The stages over documents, each written as Parquet and read again; what a stage has read is deleted.

    Nulls, empty texts, repeated rows and extra columns are as the stages' operators say; an empty table stays one.
    """
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs)
            scratch.drop(*before)
            before = [docs]
    return docs
