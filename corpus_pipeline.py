"""From raw documents to encoded training text: five stages, each one operator of ``aislewise.llm``.

Every stage takes all rows that the stage before kept and reads whole texts. All but the last return the
columns of the documents. Rows without an id or text pass the first four stages like others: an empty text
is harmless, scores as the quality model's bias says, is a copy of other empty texts and not contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aislewise.llm import decontaminate, pieces, quality, simhash, toxicity
from aislewise.llm.common import cut, table
from aislewise.llm.sampling import remainder


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a toxic span go on."""
    return toxicity.harmless(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)


def of_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model scores at least 0.7 go on."""
    return quality.good(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates goes on: SimHash of three-word shingles, three bits."""
    return simhash.representatives(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item go on."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and its next best segmentations."""
    return pieces.encode(docs, pieces.vocabulary())


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_good_quality),
    ("near duplicates", without_near_duplicates),
    ("decontamination", without_benchmarks),
    ("encoding", encoded),
]

# Learned models, hashing and tokenization have no SQL; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
