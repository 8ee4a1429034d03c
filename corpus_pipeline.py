"""A training corpus from raw documents: toxic texts, copies, near copies and benchmark texts go, the rest becomes token ids.

Each stage takes the documents that the one before kept, and decides on its own input. Stages are
written as Parquet in the shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from relspark.llm import decontaminate, exact_dedup, sentence_pieces, simhash, toxicity
from relspark.llm.queries import table, tokenizer
from relspark.session import ensure_shared_folder
from relspark.sources.stored import shared_folder


def stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """A stage that also runs on one machine where no folder is set."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_shared_folder(spark)
        return function(spark, docs, sf_dir)

    return run_stage


@stage
def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@stage
def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.without_copies(docs)


@stage
def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return simhash.without_near_duplicates(docs)


@stage
def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids, round_trip): SentencePiece ids, checked by decoding them again."""
    encoded = sentence_pieces.encoded_documents(docs, tokenizer("piece_bpe_32k.model"))
    return encoded.drop("decoded")


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("simhash_near_dedup", remove_near_copies),
    ("benchmark_decontamination", remove_contaminated),
    ("sentencepiece", to_token_ids),
]

#: Fingerprints, a trained classifier and piece search are beyond SQL; the tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables; an empty table goes through like any other."""
    ensure_shared_folder(spark)
    folder = f"{shared_folder(spark)}/relspark/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(docs.schema).parquet(f"{folder}/{name}")
    return docs
