"""Mixing sources to target weights by weighted fair queueing.

Each document of a source, in shuffled order, gets a virtual finish time: the source's words so far
divided by its target. Sorted by that time, sources advance in step, and cutting the order at the total
budget leaves each with its share. Sources that are to give more than they have go round again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import WORD, running_total
from runledger.session import stored

WEIGHTS = (3, 1, 2)
#: Share of all words that the mix holds, in percent, and the rounds over a source at most.
PERCENT, ROUNDS = 150, 2


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """Add ``target`` to ``source, source_size``, one row per source.

    Sources in code point order, null last, take the weights in turn. A target stops at ``rounds`` times
    the source's size; what is above goes to the others by weight. Sorted by size over weight, the
    sources that stop come first, so sums before and after each row give the level of the rest.
    All sums are whole numbers: the same input gives the same targets to the last bit.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long"))
    by_room = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(0))
    left = F.sum("source_size").over(everything) * percent - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * (100 * rounds)
    levels = weighed.select(
        "source", "source_size", "w", F.row_number().over(by_room).alias("n"),
        left.alias("left"), F.sum("w").over(after).alias("w_left"),
    )
    fits = F.col("left") * F.col("w") <= F.col("source_size") * (100 * rounds) * F.col("w_left")
    first = F.min(F.when(fits, F.struct("n", "left", "w_left"))).over(everything)
    level = levels.withColumn("first", first)
    room = (F.col("source_size") * rounds).cast("double")
    share = F.col("w") * F.col("first.left") / (F.col("first.w_left") * 100)
    return level.select(
        "source", "source_size", F.when(F.col("n") >= F.col("first.n"), share).otherwise(room).alias("target")
    )


def shares(
    docs: DataFrame, seed: str = "mix", weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, rounds: int = ROUNDS
) -> DataFrame:
    """``doc_id, source, size, source_size, target, n, rows``: how often the mix takes all ``rows`` alike in the first three together."""
    sized = docs.select("doc_id", "source", size_of().alias("size"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    ordered = running_total(sized.withColumn("_key", key), ["source", "_key", "doc_id", "size"], "size", "_total")
    ordered = ordered.withColumnRenamed("source", "_source")
    sources = ordered.groupBy("_source").agg(
        F.sum("size").alias("source_size"), F.min(F.col("_total") - F.col("size")).alias("_offset")
    )
    offsets = sources.select(F.col("_source").alias("source"), "_offset")
    aims = targets(sources.select(F.col("_source").alias("source"), "source_size"), weights, percent, rounds)
    aims = aims.join(offsets, aims["source"].eqNullSafe(offsets["source"])).drop(offsets["source"])
    timed = ordered.join(aims, F.col("_source").eqNullSafe(F.col("source")))
    done = F.col("_total") - F.col("_offset")
    times = [F.struct(F.lit(n).alias("round"), F.try_divide(done + F.col("source_size") * n, F.col("target")).alias("finish")) for n in range(rounds)]
    copies = timed.select("doc_id", "_source", "_key", "size", "source_size", "target", F.inline(F.array(*times)))
    copies = copies.withColumn("finish", F.coalesce("finish", F.lit(0.0)))  # a source without words has target 0
    budget = aims.agg(F.sum(F.col("target").cast("decimal(38,6)")).cast("double").alias("_budget"))
    queue = running_total(copies, ["finish", "_source", "round", "_key", "doc_id", "size"], "size", "_used")
    taken = queue.crossJoin(F.broadcast(budget)).withColumn("_in", (F.col("_used") <= F.col("_budget")).cast("long"))
    own = ["doc_id", "_source", "size", "source_size", "target"]
    # Rows alike in all of these share their rounds evenly: each is there as often as its first round.
    counted = taken.groupBy(*own).agg(F.sum("_in").alias("n"), F.sum((F.col("round") == 0).cast("long")).alias("rows"))
    return counted.withColumnRenamed("_source", "source")


def copies_of(nth: Column) -> Column:
    """How often the ``nth`` of ``rows`` alike is taken."""
    return F.floor(F.col("n") / F.col("rows")) + (nth <= F.col("n") % F.col("rows")).cast("long")


def mix(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, source, size, source_size, target, copies``, the times the mix takes it.

    ``size`` is the number of words; a null or blank text has none and adds nothing to the mix, but is taken
    at its place. A null source is one of its own. Documents are shuffled by a digest of ``doc_id`` and
    ``seed``, so reruns agree. Rows alike in ``doc_id`` count one by one. No row gives no row. ``how`` goes to
    :func:`shares`.
    """
    numbered = shares(docs, seed, **how).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return numbered.select("doc_id", "source", "size", "source_size", "target", copies_of(F.col("nth")).alias("copies"))


def take_mix(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns as they are.

    Rows alike in ``doc_id``, source and size share their copies evenly, those of the smaller hash of their text first.
    A null ``doc_id`` or source equals null only. The texts are shuffled once.
    """
    whole = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("of"), size_of().alias("words")
    )  # own names clash with none
    plan = stored(shares(docs, seed, **how).where("n > 0").select("doc_id", "source", "size", "n", "rows"), "plan")
    same = F.col("id").eqNullSafe(F.col("doc_id")) & F.col("of").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size"))
    even, odd = plan.where("n % rows = 0"), plan.where("n % rows > 0")
    taken = whole.join(even, same).select("row", copies_of(F.lit(1)).alias("copies"))
    # Of rows alike some are taken once more than the others: numbered over the whole order, as one id may have very many.
    alike = ["id", "of", "words"]
    numbered = running_total(
        whole.join(odd, same).withColumn("one", F.lit(1)).withColumn("hash", F.xxhash64(F.coalesce("row.text", F.lit("")))),
        [*alike, "hash"], "one", "place",
    )
    firsts = stored(numbered.groupBy(*alike).agg(F.min("place").alias("first")), "firsts")
    firsts = firsts.select(*[F.col(c).alias(f"its_{c}") for c in alike], "first")
    of_group = [F.col(c).eqNullSafe(F.col(f"its_{c}")) for c in alike]
    rest = numbered.join(firsts, of_group).select("row", copies_of(F.col("place") - F.col("first") + 1).alias("copies"))
    counted = taken.union(rest).where("copies > 0")
    return counted.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
