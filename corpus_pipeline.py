"""A corpus pipeline: documents in, token ids of the selected mixture out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import minhash, mixing, pieces, pii, quality
from tidemark.llm._common import lean_batches, materialize
from tidemark.llm.queries import MIX_WEIGHTS, domain_of

#: The mixture takes this share of its input's tokens, from at most two epochs of a source.
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 80, 2, 23


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    lean_batches(spark)
    return quality.keep_good(docs)


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    lean_batches(spark)
    return minhash.keep_first(docs, width=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    lean_batches(spark)
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture selects, a row for each epoch."""
    return mixing.selected(docs, domain_of(F.col("source")), MIX_WEIGHTS, F.expr(f"total * {MIX_PERCENT} div 100"), MIX_EPOCHS, MIX_SEED)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each row."""
    lean_batches(spark)
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", good),
    ("near duplicates", first_of_near_duplicates),
    ("personal data", without_personal_data),
    ("mixture", mixture),
    ("token ids", token_ids),
]

#: Compression, the random field and the lattice have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage_{k}")
    return docs
