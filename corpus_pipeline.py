"""The corpus pipeline: documents without toxic texts and near copies, secrets masked, mixed by source, then encoded.

Each stage reads the table that the one before it wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from alinea.llm import bpe, jaccard, mixing, secrets, toxicity
from alinea.llm.common import table, written

#: Of five tokens four are kept: domains, languages and sources by the weights of the plan, no document more than once.
MIX = mixing.Plan(percent=80, epochs=1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go.

    A null or empty text has the score of no words and stays unless that is toxic; a null doc_id is judged like any; rows that
    repeat are judged alike; all columns stay.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on shingles of five words, that of the smallest doc_id stays.

    Rows with a null doc_id, a null text or one without words link with nothing and stay. Of rows that repeat doc_id and text one
    stays (where their other columns differ, any of them).
    """
    return jaccard.keep_first(docs, jaccard.Params(words=5, percent=80))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no row goes. Null texts stay null, rows that repeat are masked alike; n_chars follows the new text."""
    return secrets.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf of the tree of domains, languages and sources gives documents up to its quota.

    A null language or source is a value of its own; null and empty texts have no tokens and cost a leaf nothing; rows that
    repeat are taken or left each.
    """
    return mixing.mixed_documents(docs, MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and proof that they decode to the text."""
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

ORACLE_SQL = None  # SQL cannot express the trained stages; tests hold each stage against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
