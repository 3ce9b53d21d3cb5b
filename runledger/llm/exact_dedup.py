"""Exact duplicates of texts, with frequent texts split off before the shuffle.

Misra-Gries counters find digests that a large share of all rows has. An exact count verifies them and
picks their winners; these few rows are broadcast, so that copies of a frequent text are decided where
they are read. All other digests are shuffled; none of them has more rows than the share allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import text_or_empty
from runledger.session import stored

#: A digest is frequent if it has at least 1 / SHARE of all rows: so many are broadcast at most.
SHARE = 1000


def summarise(digests, counters: int) -> dict[bytes, int]:
    """Misra-Gries: counts that are too small by at most rows / (counters + 1)."""
    held: dict[bytes, int] = {}
    for digest in digests:
        if digest in held:
            held[digest] += 1
        elif len(held) < counters:
            held[digest] = 1
        else:
            held = {d: n - 1 for d, n in held.items() if n > 1}
    return held


def frequent(digests: DataFrame, share: int = SHARE) -> DataFrame:
    """``digest, keep_id, group_size`` of each digest with at least 1 / ``share`` of all rows.

    Each task keeps 4 * ``share`` counters. A sum of counters is short of the true count by a quarter
    of the wanted share at most, and sums that reach three quarters of it belong to at most
    4 / 3 * ``share`` digests, whatever the input's size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = summarise((d for b in batches for d in b.column(0).to_pylist()), 4 * share)
        yield pa.record_batch([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["digest", "n"])

    rows = digests.count()
    likely = (
        digests.select("digest")
        .mapInArrow(count, "digest binary, n long")
        .groupBy("digest")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") * (4 * share) >= 3 * rows)
        .select("digest")
    )
    return (
        digests.join(F.broadcast(likely), "digest")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") * share >= rows)
    )


def digest_of(text: str = "text"):
    return F.unhex(F.sha2(text_or_empty(text), 256))


def duplicate_groups(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, digest, keep_id, group_size, kept``.

    Reads ``doc_id`` and ``text`` only. Equal texts form a group, a null text counts as empty, and the
    row with the largest ``doc_id`` stays. A null ``doc_id`` loses to any other; of rows that share the
    winning ``doc_id`` all are marked kept, and a group of null ids keeps them all. No row gives none.
    """
    digests = stored(docs.select("doc_id", digest_of().alias("digest")), "digests")
    heavy = stored(frequent(digests, share), "frequent")
    group = Window.partitionBy("digest")
    light = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "doc_id", "digest",
        F.max("doc_id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"),
    )
    grouped = digests.join(F.broadcast(heavy), "digest").select("doc_id", "digest", "keep_id", "group_size").union(light)
    return grouped.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_duplicates(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """The rows of ``docs`` with one row for each text, that of the largest ``doc_id``, all columns as they are.

    Rows alike in text and ``doc_id`` are one document; any one of them stays. Copies of a frequent text
    are dropped where they are read; only rows that may stay are shuffled.
    """
    heavy = stored(frequent(docs.select("doc_id", digest_of().alias("digest")), share), "frequent")
    heavy = heavy.select(F.col("digest").alias("heavy"), F.col("keep_id").alias("keep"))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), digest_of().alias("digest"))  # own names clash with none
    marked = whole.join(F.broadcast(heavy), F.col("digest") == F.col("heavy"), "left")
    may_stay = marked.where(F.col("heavy").isNull() | F.col("id").eqNullSafe(F.col("keep"))).select("row", "id", "digest")
    newest = Window.partitionBy("digest").orderBy(F.col("id").desc_nulls_last())
    return may_stay.withColumn("nth", F.row_number().over(newest)).where("nth = 1").select("row.*")
