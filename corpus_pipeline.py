"""Documents to a mixed, encoded training set, stage by stage, each written and read again before the next.

Every stage takes an empty table (it returns none), nulls in any column and columns of any name; all but the last
return whole rows. What each makes of nulls and of repeated rows is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import bpe, exact_dedup, jaccard, language, mixing
from runledger.session import stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter, or of none of the languages, go.

    A null text has no letter. Rows are judged one by one, so repeated ones and those with a null ``doc_id`` fare as
    their text does; a null ``lang`` teaches nothing and is no reason to go.
    """
    return language.keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, the one with the largest ``doc_id``.

    A null text counts as empty, a null ``doc_id`` loses to any other, and of rows alike in both one stays.
    """
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest ``doc_id``.

    Texts that share that ``doc_id`` are told apart by a hash, the smallest stays. Rows without a ``doc_id``, and null texts or
    those without a word, stay; rows alike in ``doc_id`` and text are one document and stay or go together.
    """
    return jaccard.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them.

    A null source is one of its own. A null text has no words and is taken at its place. Rows alike in ``doc_id``, source
    and size, null ids too, share their copies evenly.
    """
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of each row: its ids, and the digest of what they decode to.

    A null text counts as empty and has no ids. Repeated rows, and those with a null ``doc_id``, are encoded one by one.
    """
    both = bpe.encode_and_decode(docs)
    return both.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Language models, links between near copies and encoders are beyond SQL; a test holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
