"""A training-data pipeline over the documents table: five stages, each on what its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenquery.llm import mixing, pii, sentencepieces, simhash, toxicity
from lumenquery.session import checkpoint_dir, delete_path, table

#: No stage but the mix can be written in SQL, and it works on what others kept.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; labels of held-out ids are not learned from.

    Null and empty texts score as texts without words; repeated rows score alike; null ids have no
    label; an empty table, or one without labels of both kinds, loses nothing.
    """
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out("doc_id", 4, 2))
    return toxicity.clean(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, Jaccard similarity 0.8 or more.

    The least id stays, a null id before all; texts without words, null ones too, are one group; rows
    equal in id and text are one document; an empty table stays empty.
    """
    return simhash.deduplicate(docs, width=5, similarity=0.8)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by tags of their kind; every document stays, null texts as null."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources take their shares: documents repeat by epochs or are left out.

    Nulls of source are one source; ids, null ones too, order by hash and ties by text; documents
    without words take no share; an empty table stays empty.
    """
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the decoded text's agreement; null and empty texts have none."""
    return sentencepieces.encode(docs, keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each result written to the shared folder and read again.

    A stage's table is deleted once its successor's is written; the last one stays for the result.
    """
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for n, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
