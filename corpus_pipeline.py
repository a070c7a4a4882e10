"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, personal data is replaced, sources are mixed
to their targets, and what is left is encoded and decoded.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept. All but the last return the columns of
documents. In every stage null texts count as empty, very long texts are read whole, in pieces where that bounds memory, columns
of any other name stay as they are, and an empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import bpe, mixing, pii, simhash, toxicity
from pathloom.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Empty texts are scored as well; rows that repeat score alike."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Candidates are texts whose SimHash fingerprints meet in the grid range join, and those that min-hash bands add. Near duplicates are texts whose shingles of five words have a Jaccard similarity of 0.8 or more, as sets. Null
    keys come last where one is chosen, and of rows that share key and text one stays.
    """
    return simhash.keep_one(docs, shingle=5)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind. Null stays null; rows that repeat stay alike."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it; rows that repeat are neither lost nor doubled."""
    return mixing.mix(docs)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of each document's ids and of the bytes they decode to, a row for each row."""
    return bpe.digests(bpe.encode(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("byte_level_bpe", encode_and_decode),
]

#: SQL can express neither the classifiers nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for all documents; each stage's result is a table in the shared folder that the next one reads."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
