"""The corpus pipeline: quality, language, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, extra ones included, whatever their names. A stage works on
all that its predecessor kept, on whole texts.

Defined results: a document with a null or empty text, or without letters, is rejected by the quality or language stage;
documents are told apart by all their columns, so different texts under one doc_id, or under none, are all judged, and
of rows equal in every column one stays; ties go to the smallest doc_id; an empty table passes through as an empty table.
"""

from __future__ import annotations

import uuid

from corpusforge.llm import langid, packing, quality, runtime, secrets, simhash
from pyspark.sql import DataFrame, SparkSession


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.train(docs, labels))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language: text in no such language, or without letters, goes."""
    languages, network = langid.train(docs)
    return langid.keep(docs, languages, network, langid.threshold_of(docs, languages, network))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return simhash.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets masked."""
    return secrets.mask(docs, secrets.train(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, packed into sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", keep_first_copies),
    ("secrets", mask_secrets),
    ("packing", pack_windows),
]

#: Tokenizers, models and iteration are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again.

    Each stage's folder is deleted once the next one is written; the last one stays, as the result reads it.
    """
    folder = f"{runtime.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            runtime.delete(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
