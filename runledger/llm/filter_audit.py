"""How filters act together: what each order of them removes, and what a filter removes alone.

Documents that fail the same filters are counted together. The step at which an order removes them is a
minimum: of the positions, in that order, of the filters that they fail. So a matrix of masks (0 where a
filter fails, infinite elsewhere) is combined with the matrix of positions of all orders, a minimum of
sums in place of a sum of products, and counts are scattered by the resulting steps.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import WORD, text_or_empty
from runledger.session import stored

#: Orders grow as the factorial of the filters: 5,040 of seven.
MOST = 7
#: The bounds of the filters of :func:`failures`.
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SYMBOLS = 50, 65, 5, "[#$%&*|]"


def positions(filters: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders as rows of filters, and their inverses: the step, from 1, at which each filter comes."""
    orders = np.array(list(permutations(range(filters))))
    steps = np.empty_like(orders)
    np.put_along_axis(steps, orders, np.arange(1, filters + 1)[None, :], axis=1)
    return orders, steps


def removal_steps(fails: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The step that removes each mask (row) in each order (column); one beyond the last if none does."""
    beyond = steps.shape[1] + 1
    mask = np.where(fails, 0, beyond)
    return np.minimum((mask[:, None, :] + steps[None, :, :]).min(axis=2), beyond)


def effects(fails: np.ndarray, weights: np.ndarray, filters: Sequence[str]) -> dict[str, list]:
    """A row for each order and step from masks and their ``weights``, of which the first column counts documents."""
    k = len(filters)
    orders, steps = positions(k)
    removed_at = removal_steps(fails, steps)
    n_orders, rows = len(orders), np.arange(len(orders))
    lost = np.zeros((weights.shape[1], n_orders, k + 2), np.int64)
    for mask, weight in enumerate(weights):
        lost[:, rows, removed_at[mask]] += weight[:, None]
    lost = lost[:, :, 1 : k + 1]
    redundant = np.zeros((n_orders, k), np.int64)
    for step in range(k):
        failing = fails[:, orders[:, step]] & (removed_at <= step)  # removed at an earlier step, counted from 1
        redundant[:, step] = weights[:, 0] @ failing
    alone = weights[:, 0] @ (fails & (fails.sum(axis=1) == 1)[:, None])
    by_filter = np.take_along_axis(lost[0], steps - 1, axis=1).sum(axis=0)
    names = ["".join(filters[f] for f in order) for order in orders]
    return {
        "filter_order": np.repeat(names, k).tolist(), "step": np.tile(np.arange(1, k + 1), n_orders).tolist(),
        "kept": (weights[:, 0].sum() - lost[0].cumsum(axis=1)).ravel().tolist(), "removed": lost[0].ravel().tolist(),
        "redundant": redundant.ravel().tolist(), "unique_fails": alone[orders].ravel().tolist(),
        "lost": [x.ravel().tolist() for x in lost[1:]], "shapley": by_filter[orders].ravel().tolist(),
    }


def audit(rows: DataFrame, part: str, filters: Sequence[str], lost: Sequence[str] = ()) -> DataFrame:
    """One row per ``part``, order of ``filters`` and step, with counts of rows as longs.

    ``filters`` are boolean columns with names of one letter, true where the filter rejects a row; null is
    false. ``lost`` are boolean columns whose rows are counted where they are removed, as ``<name>_lost``.
    ``kept`` is what is left after the step, ``removed`` what it takes, ``redundant`` what its filter rejects but
    an earlier step took, ``unique_fails`` what its filter alone rejects, ``shapley`` what its filter takes over
    all orders together. Other columns are not read. Parts with no row have none, a null part is one of its own.
    """
    if not 1 <= len(filters) <= MOST:
        raise ValueError(f"1 to {MOST} filters can be tried in all orders")
    places = [f"_{n}" for n in range(len(lost))]
    flag = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(False))
    masks = rows.select(F.col(f"`{part}`").alias("part"), F.array(*map(flag, filters)).alias("fails"), *[flag(c).cast("long").alias(p) for c, p in zip(lost, places)])
    masks = masks.groupBy("part", "fails").agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).alias(p) for p in places])
    kind = masks.schema["part"].dataType.simpleString()
    numbers = ["kept", "removed", "redundant", "unique_fails", *[f"{c}_lost" for c in lost], "shapley"]

    def run(group: pa.Table) -> pa.Table:
        """All orders for one part, of which there is a row for each mask at most."""
        fails = np.array(group["fails"].to_pylist(), bool)
        weights = np.array([group[c].to_pylist() for c in ("n", *places)], np.int64).T
        made = effects(fails, weights, filters)
        counts = [made["kept"], made["removed"], made["redundant"], made["unique_fails"], *made["lost"], made["shapley"]]
        own = pa.array([group["part"][0].as_py()] * len(made["step"]), group["part"].type)
        columns = [own, pa.array(made["filter_order"]), pa.array(made["step"], pa.int32()), *[pa.array(c, pa.int64()) for c in counts]]
        return pa.table(columns, ["part", "filter_order", "step", *numbers])

    schema = f"part {kind}, filter_order string, step int, " + ", ".join(f"`{c}` long" for c in numbers)
    return masks.groupBy("part").applyInArrow(run, schema)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part`` and the flags ``A`` to ``E``, ``good``, ``toxic`` of each row of ``docs``.

    Reads ``doc_id, text, source`` and ``doc_id, quality, toxic`` of ``labels``. A null text counts as empty, a null
    source as an empty one. A: too few words. B: too few distinct ones. C: too many capitals. D: a symbol. E: the
    text of a smaller ``doc_id``; a null ``doc_id`` is smaller than none and has none smaller, rows that share the
    smallest are all first. A document is good (toxic) if any of its labels says so; without labels it is neither.
    """
    text = text_or_empty()
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    read = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"),
        F.inline(F.array(F.struct(text.alias("text"), words.alias("words")))),
    )
    judged = read.select(
        "doc_id", "part", F.unhex("digest").alias("digest"), (F.size("words") < LEAST_WORDS).alias("A"),
        (100 * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * F.size("words")).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > CAPITALS_PERCENT * F.char_length("text")).alias("C"),
        F.col("text").rlike(SYMBOLS).alias("D"),
    )
    judged = stored(judged, "judged")
    copied = judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copied = stored(copied, "copied")  # read anew, so that Spark can split a text of very many copies in the join
    said = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.bool_or(F.col("quality").eqNullSafe(1)).alias("good"), F.bool_or(F.col("toxic").eqNullSafe(1)).alias("toxic")
    )
    flagged = judged.join(copied, "digest", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    flags = ["part", "A", "B", "C", "D", "E"]
    named = flagged.where(F.col("doc_id").isNotNull()).join(said, "doc_id", "left").select(*flags, "good", "toxic")
    nameless = flagged.where(F.col("doc_id").isNull()).select(*flags, F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return named.union(nameless)
