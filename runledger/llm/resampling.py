"""Importance resampling: a draw of documents whose words are distributed like those of a target set.

Hashed word runs of the documents and of the target are counted in buckets. What a bucket speaks for the
target is one number in an array, and a document's weight is the mean of these numbers over its runs. With
noise of a fixed kind added (Gumbel's), the highest scores are a draw by weight without replacement. A
quantile sketch gives a bracket around the last score drawn; exact counts outside confirm the bracket or
widen it, and only its rows are sorted to find where the draw ends.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.bpe import slices
from runledger.llm.common import running_total, text_or_empty
from runledger.session import stored

#: Runs of 1 to NGRAM words, hashed into BUCKETS; PERCENT of the documents of LEAST words or more are drawn.
NGRAM, BUCKETS, PERCENT, LEAST, SEED = 1, 10_000, 10, 20, "2024"
#: Accuracy of the sketch, and the share of all scores that the first bracket reaches to either side.
ACCURACY, MARGIN = 10_000, 0.001
#: Words whose buckets a task remembers at most.
REMEMBERED = 200_000

#: Bytes that are part of a word stay, A-Z are lower-cased, all others separate words. UTF-8 beyond ASCII is part of words.
FOLD = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


class Buckets(dict):
    """The bucket of each word or run, remembered for a while."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, run: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bucket = self[run] = zlib.crc32(run) % self.buckets
        return bucket


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def runs_of(words: list[bytes], ngram: int) -> list[bytes]:
    """All runs of 1 to ``ngram`` consecutive words."""
    runs = list(words)
    for n in range(2, ngram + 1):
        runs += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return runs


def bucket_counts(texts: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs of all of ``text`` each bucket holds: counted in tasks, summed by Spark, ``buckets`` numbers to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in slices(batches, 100):
            found = []
            for text in batch.column(0).to_pylist():
                found += map(bucket.__getitem__, runs_of(words_of(text), ngram))
            total += np.bincount(np.array(found, np.int64), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    parts = texts.select(text_or_empty().alias("text")).mapInArrow(count, "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row.bucket] = row.n
    return counts


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of how much likelier each bucket is in the target, rounded down; counts start at one."""
    s, t = float(source.sum() + len(source)), float(target.sum() + len(target))
    gains = [math.floor(1000 * math.log(((b + 1) * s) / ((a + 1) * t))) for a, b in zip(source.tolist(), target.tolist())]
    return np.array(gains, np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, ngram: int = NGRAM) -> DataFrame:
    """``doc_id, digest, n_words, n_features, weight`` of each row; the digest tells apart texts that share a ``doc_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Buckets(len(gains))
        for batch in slices(batches, 100):
            n_words, ends, found = [], [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                found += map(bucket.__getitem__, runs_of(words, ngram))
                n_words.append(len(words))
                ends.append(len(found))
            totals = np.concatenate([[0], np.cumsum(gains[np.array(found, np.int64)])])
            ends = np.array([0, *ends], np.int64)
            features = np.diff(ends)
            weight = np.diff(totals[ends]) // np.maximum(features, 1)
            columns = [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(features), pa.array(weight)]
            yield pa.record_batch(columns, ["doc_id", "digest", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("digest"), text_or_empty().alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, digest long, n_words long, n_features long, weight long")


def noise(seed: str, doc_id: str = "doc_id") -> Column:
    """A thousand times a Gumbel number that the id and the seed fix, rounded down."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def bracket(scores: DataFrame, rows: int, take: int, margin: float = MARGIN, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """``low, high, above``: the ``take``-th highest ``score`` is within the first two, and ``above`` scores are higher.

    A quantile sketch proposes the bracket. Exact counts above and within it say whether it holds the score;
    else it is made four times as wide, in the end from the least to the highest score.
    """
    while True:
        aim = 1 - take / rows
        ends = F.percentile_approx("score", [max(0.0, aim - margin), min(1.0, aim + margin)], accuracy)
        if margin >= 1:
            ends = F.array(F.min("score"), F.max("score"))
        low, high = scores.agg(ends.alias("ends")).first().ends
        score = F.col("score")
        counts = scores.agg(F.count_if(score > high).alias("above"), F.count_if(score.between(low, high)).alias("within")).first()
        if counts.above < take <= counts.above + counts.within:
            return low, high, counts.above
        margin = max(4 * margin, 1 / rows)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, ngram: int = NGRAM, buckets: int = BUCKETS,
    seed: str = SEED,
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, digest, n_words, n_features, weight, score, rank``.

    Reads ``doc_id`` and ``text`` of ``docs`` and ``text`` of ``target``; a null text has no words, weight 0,
    and a null ``doc_id`` the noise of an empty one. Of the N rows with ``least`` words or more, floor(``percent`` * N /
    100) with the highest scores are drawn and numbered in ``rank``; it is null for all others. Ties go to the
    smaller ``doc_id``, null last, then to the smaller hash of the text; rows alike in both follow each other
    in any order. An empty target leaves weights that favour rare words; no row gives none, and fewer rows
    than make up one whole draw are all undrawn.
    """
    gains = gains_of(bucket_counts(docs, ngram, buckets), bucket_counts(target, ngram, buckets))
    scored = stored(weigh(docs, gains, ngram).withColumn("score", F.col("weight") + noise(seed)), "scores")
    fit = scored.where(F.col("n_words") >= least)
    rows = fit.count()
    take = percent * rows // 100
    unranked = F.lit(None).cast("long").alias("rank")
    if not take:
        return scored.select("*", unranked)
    low, high, above = bracket(fit, rows, take)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("digest")]
    edge = fit.where(F.col("score").between(low, high)).withColumn("one", F.lit(1))
    edge = running_total(edge, order, "one", "place").withColumn("in", F.col("place") <= take - above).drop("one", "place")
    edge = stored(edge, "bracket")
    drawn = fit.where(F.col("score") > high).union(edge.where("in").drop("in")).withColumn("one", F.lit(1))
    ranked = running_total(drawn, order, "one", "rank").drop("one")
    rest = scored.where((F.col("n_words") < least) | (F.col("score") < low)).union(edge.where("NOT in").drop("in"))
    return ranked.withColumn("rank", F.col("rank").cast("long")).union(rest.select("*", unranked))


def draw(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that :func:`resample` draws, all columns as they are.

    Rows alike in ``doc_id`` and text are drawn together, the last of them as often as the draw has room.
    """
    keys = resample(docs, target, **how).groupBy("doc_id", "digest").agg(F.count("rank").alias("drawn"), F.count(F.lit(1)).alias("rows"))
    keys = stored(keys.where("drawn > 0"), "drawn")
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text_or_empty()).alias("hash"))
    same = lambda k: F.col("id").eqNullSafe(k["doc_id"]) & (F.col("hash") == k["digest"])
    whole = keys.where("drawn = rows")
    taken = row.join(whole, same(whole), "left_semi").select("row.*")
    for cut in keys.where("drawn < rows").collect():  # one key at most: where the draw ends
        alike = F.col("id").eqNullSafe(F.lit(cut.doc_id)) & (F.col("hash") == cut.digest)
        taken = taken.union(row.where(alike).limit(cut.drawn).select("row.*"))
    return taken
