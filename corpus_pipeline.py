"""A corpus pipeline: five stages over ``documents``, each written and read again.

toxicity       documents that the model scores 0.5 or more go
near_join      one document of each class of near copies stays, the one of smallest doc_id
personal_data  spans of personal data become their kind in brackets
mixing         sources come near their target weights; a document may repeat or go
byte_bpe       texts become token ids, checked by decoding them again

Toxicity learns from the ``labels`` beside the documents, so SQL cannot express the whole;
tests hold every stage against a plain version.

Every stage goes by rows: rows that share a doc_id or have none are documents of their own, and
equal rows are copies of each other.  Nulls in any column, empty tables and further columns, by
whatever names, are allowed; all stages but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, jaccard, mixing, pii, toxicity
from quillspark.llm.common import discard, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; a null or empty text scores as one empty sentence."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("tox_score < 0.5").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: that of smallest doc_id.  Texts without words all stay."""
    return jaccard.representatives(docs).select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind in brackets; ``n_chars`` follows the text, and
    stays where the text is null."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each row as the mix takes; rows without words have size 0 and go."""
    mixed = mixing.mix(docs, tuple(docs.columns)).filter("copies > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return mixed.select("row", copies).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row; a null text is empty."""
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_join", drop_near_copies),
    ("personal_data", redact),
    ("mixing", mix),
    ("byte_bpe", tokenize),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage_{name}")
        discard(before)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
