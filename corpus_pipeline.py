"""The corpus pipeline: documents through five stages, each written and read again.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Rejected documents, copies
and near copies leave; the mix repeats, cuts or drops what is left to its target weights; the last stage encodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acutance.llm import exact, mixing, pieces, quality, simhash
from acutance.llm.queries import model_path
from acutance.session import materialise, read_table


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, quality.train_from_labels(docs, read_table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.deduplicate(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, a row for each pass."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text."""
    return pieces.encode_decode(docs, model_path()).drop("text")


STAGES = [
    ("quality classifier", accept_quality),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("sentencepiece encoding", encode_pieces),
]

#: Training, fingerprints and pieces aren't expressible in SQL; tests hold the operators
#: behind the stages against brute-force versions, the classifier against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
