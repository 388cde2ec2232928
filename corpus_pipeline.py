"""Corpus pipeline: quality classifier, n-gram Jaccard join, benchmark decontamination, surrogates, packing.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
documents, further columns pass. run() writes each stage's rows to the shared folder and reads them again for the next.
In all stages a null text is an empty one and stays null where rows pass, rows with a null id pass (the second stage compares
them with none), and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import cut, table
from termloom.llm.decontaminate import decontaminated
from termloom.llm.jaccard_join import one_of_each
from termloom.llm.packing import pack
from termloom.llm.quality import accepted
from termloom.llm.queries import PRIVACY_KEY, tokenizer_path
from termloom.llm.surrogates import pseudonymise


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model accepts; equal texts fare alike, also rows that repeat an id."""
    return accepted(docs, table(spark, sf_dir, "labels"), folds=4, held=2, threshold=0.7)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of documents whose five-word shingles have a similarity of 0.8 or more.

    Texts without words are in no group. Rows that repeat an id are one document, of the smallest of their texts, and stay or
    go together.
    """
    return one_of_each(docs, n=5, num=80, den=100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; of rows that repeat an id all go if one has such a passage."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_people(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data, each row by itself; n_chars follows the text."""
    return pseudonymise(docs, PRIVACY_KEY).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 4096; a row that repeats an id has pieces of its own."""
    return pack(docs, tokenizer_path(), tokens=4096)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("PII surrogates", hide_people),
    ("best-fit packing", pack_sequences),
]
#: A boosted model, an alignment and a tokenizer are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
