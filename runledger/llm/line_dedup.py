"""Lines that an earlier document has already, looked up in levelled sorted runs of line hashes.

Documents come in batches, by ascending ``doc_id``. The index holds every line hash seen so far in runs:
tables bucketed and sorted by hash, so that a lookup merges a run with the batch without shuffling the
run. A batch drops what the runs hold and what a smaller ``doc_id`` of its own has, and adds the rest as
a new run. ``FANOUT`` runs of a level are merged into one of the next: few runs at any time, and a hash
is rewritten once for each level only.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import shuffle_partitions, text_or_empty
from runledger.session import stored

BATCHES, FANOUT, MIN_CHARS = 4, 3, 10
HASH = ["h1", "h2"]
#: What tells rows apart: rows alike in both have the same lines and lose the same.
ROW = ["doc_id", "text_hash"]


class LineIndex:
    """Sorted runs of line hashes, ``h1, h2``; each hash is in one run."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT) -> None:
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = [[]]

    @property
    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, hashes: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        # As many files as buckets: rows of a bucket meet before they are written.
        dealt = hashes.select(*HASH).repartition(self.buckets, *HASH)
        dealt.write.format("parquet").bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def missing(self, hashes: DataFrame) -> DataFrame:
        """Rows whose hash is in no run: a merge anti join with one run after the other."""
        return reduce(lambda left, run: left.join(run.hint("merge"), HASH, "left_anti"), self.runs, hashes)

    def add(self, hashes: DataFrame) -> None:
        """Add a run of hashes that no run holds; merge levels that are full."""
        self._write(hashes, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(reduce(DataFrame.union, [self.spark.table(name) for name in full]), level + 1)
            for name in full:
                self.spark.sql(f"DROP TABLE {name}")
            level += 1

    def drop(self) -> None:
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE {name}")
        self.levels = [[]]


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.btrim(line, F.lit("\t\n\x0b\x0c\r ")), upper, upper.lower())


def rows_of(docs: DataFrame, doc_id: Column) -> DataFrame:
    """``doc_id, text_hash, text``: a row's text and its 64-bit hash, which tells rows alike in ``doc_id`` apart."""
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """The row, ``pos`` and the 128-bit hash of each line whose key has ``min_chars`` code points or more.

    Reads ``doc_id, text_hash, text``.
    """
    lines = docs.select(*ROW, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select(*ROW, "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select(*ROW, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def batch_bounds(docs: DataFrame, batches: int) -> list:
    """``doc_id`` values that cut the documents into batches of about the same number."""
    shares = [n / batches for n in range(1, batches)]
    return sorted({x for x in docs.select("doc_id").approxQuantile("doc_id", shares, 0.001)}) if batches > 1 else []


def dropped_lines(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, text_hash, places``: the line numbers, from 0 and ascending, that each row with such lines loses.

    Reads ``doc_id`` and ``text``. A line goes if its key has ``min_chars`` code points or more and a
    smaller ``doc_id`` has it too; a null ``doc_id`` counts as smaller than any other. Rows alike in
    ``doc_id`` are one document, so none of their lines goes for the other's sake; each has its own places.
    """
    spark = docs.sparkSession
    index = LineIndex(spark, shuffle_partitions(docs))
    bounds = [None, *batch_bounds(docs, batches), None]
    parts = []
    for low, high in zip(bounds, bounds[1:]):
        # On the column as it is, so that a scan reads the batch only; null comes first.
        part = docs
        if low is not None:
            part = part.where(F.col("doc_id") >= F.lit(int(low)))
        if high is not None:
            part = part.where((F.col("doc_id") < F.lit(int(high))) | (F.lit(low is None) & F.col("doc_id").isNull()))
        part = rows_of(part, F.coalesce(F.col("doc_id"), F.lit(-(2**63))))
        lines = stored(lines_of(part, min_chars), "lines")
        firsts = lines.groupBy(*HASH).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
        new = stored(index.missing(firsts), "line_owners")
        # Lines that stay are most of all lines and need no join: only hashes with another holder are looked up.
        own = new.where("owner = last").select(*HASH)
        shared = new.where("owner < last").select(*HASH, "owner")
        index_add = new.select(*HASH)
        lost = lines.join(own, HASH, "left_anti").join(shared, HASH, "left")
        lost = lost.where(F.col("owner").isNull() | (F.col("owner") < F.col("doc_id")))
        places = lost.groupBy(*ROW).agg(F.sort_array(F.collect_set("pos")).alias("places"))
        parts.append(stored(places, "lost_lines"))
        index.add(index_add)
    index.drop()
    found = reduce(DataFrame.union, parts)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(-(2**63)), F.col("doc_id")))


def dedup_lines(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_lines, n_dropped, kept_text``.

    Texts are split at line feeds; a null or empty text is one empty line. The lines that
    :func:`dropped_lines` names are cut out, the others stay as they are, joined by line feeds.
    """
    lost = dropped_lines(docs, batches, min_chars).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    texts = rows_of(docs, F.col("doc_id"))
    # A merge at any size: a plan that changed with the input would tell nothing about a larger one.
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    both = texts.join(lost.hint("merge"), same, "left")
    lines = F.split("text", "\n", -1)
    cuts = F.coalesce("places", F.array().cast("array<int>"))
    both = both.select("doc_id", F.inline(F.array(F.struct(lines.alias("lines"), cuts.alias("cuts")))))
    # The stretches between lines that go, rather than a test of each line against all of them.
    stretches = F.transform(
        F.sequence(F.lit(0), F.size("cuts")),
        lambda n: F.slice(
            F.col("lines"),
            F.coalesce(F.get("cuts", n - 1), F.lit(-1)) + 2,
            F.coalesce(F.get("cuts", n), F.size("lines")) - F.coalesce(F.get("cuts", n - 1), F.lit(-1)) - 1,
        ),
    )
    return both.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("cuts").cast("long").alias("n_dropped"),
        F.array_join(F.flatten(stretches), "\n").alias("kept_text"),
    )
