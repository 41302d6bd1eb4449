"""A corpus pipeline of five operators: each stage works on all that the one before kept.

``run`` writes what each stage returns as Parquet into the folder that ``spark.checkpoint.dir`` names and reads it
again for the next, so a lost executor costs at most the work of one stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import minhash, mixing, pieces, pii, toxicity
from tabloom.llm._durable import removed, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on the labelled ones, rejects go.

    Null texts stay, repeated rows share their fate, very long texts are read whole.  An empty table stays empty.
    """
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = toxicity.fit(labelled, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, machine)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least ``doc_id``; nothing else changes.

    Rows without an id or without words stay.  Of rows that repeat an id one stays, that with the least text.  Very long
    texts are compared whole.  An empty table stays empty.
    """
    return minhash.deduplicated(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the name of their type; every document stays.

    Null and empty texts stay as they are, repeated rows are changed alike, very long texts are read whole.
    """
    return pii.without_entities(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many documents as come in, sources weighted by the square root of their size; repeats are whole copies.

    A null source is one of its own, a null text counts as an empty one.  Of equal ranks (repeated ids) the lesser id,
    then the lesser text goes first.  An empty table stays empty.
    """
    return mixing.mixture(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids and byte spans of every document.

    Null texts have null lists, empty ones empty lists; rows without an id and repeated rows stay.  Very long texts are
    encoded whole.  An empty table gives no rows.
    """
    return pieces.tokens(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("personal data", redact_personal_data),
    ("source mixture", mix_sources),
    ("pieces", encode_pieces),
]

#: SQL can state neither a trained model nor a tokenizer; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  What a stage wrote is removed once the next one has read it."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        if i:
            removed(spark, f"{base}/{i - 1}")
    return docs
