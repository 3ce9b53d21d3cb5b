"""Quality rules: fixed rules on counts, and texts whose statistics lie far from their language and source.

Each text's shares (symbols, capitals, repeated words and so on) are transformed to a vector. For every
language and source the minimum covariance determinant gives a centre and a scatter that outliers do not
bend: starting from robust guesses, the share CORE of the vectors that lies nearest is used for the next
estimate, until the determinant falls no more. Vectors too far away by Mahalanobis distance are rejected.
Each step is a pass of Spark over all vectors: a histogram of distances per group, sums over the nearest
part, and one small matrix per group. Vectors are whole numbers, so sums do not depend on their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.bpe import slices
from runledger.llm.common import text_or_empty
from runledger.session import stored

#: The statistics, each with the spread that is never taken for less: shares of short texts vary by chance.
FLOORS = {
    "word_length": 0.05, "symbols": 0.05, "capitals": 0.04, "marks": 0.05, "digits": 0.12, "repeated_lines": 0.15,
    "repeated_words": 0.15, "variety": 0.04,
}
#: Units in 1.
UNIT = 10_000
#: The share of vectors that an estimate rests on, the rows that a group needs for its own, and the steps at most.
CORE, ROWS, STEPS = 0.75, 100, 12
#: The share of ordinary vectors that may lie beyond the limit of the last estimate, and of the verdict.
REWEIGHT, REJECT = 0.025, 1e-6
#: Bins of the histogram of distances for each factor of e.
BINS = 100
#: The base rules.
LEAST_WORDS, REPEAT_PERCENT, WINDOW, SYMBOLS = 20, 30, 8, b"#*$%&|<>"

CAPITALS, SMALL, DIGITS, SPACES = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57), (9, 13)))
BEYOND = bytes(range(128, 256))
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals",
    "n_letters", "n_marks", "n_digits",
)


def in_repeated_windows(ids: np.ndarray, span: int) -> int:
    """How many positions lie in windows of ``span`` ids that occur twice or more.

    Windows are numbered exactly: those of twice the length are pairs of numbers of the shorter ones.
    """
    windows = len(ids) - span + 1
    if windows < 2:
        return 0
    length, codes, n = 1, ids, 0
    while length < span:
        step = min(length, span - length)
        pairs = codes[: len(codes) - step] * (int(codes.max()) + 1) + codes[step:]
        found, codes = np.unique(pairs, return_inverse=True)
        n, length = len(found), length + step
        if n == len(codes):
            return 0
    edges = np.zeros(len(ids) + 1, np.int64)
    starts = np.flatnonzero(np.bincount(codes, minlength=n)[codes] > 1)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + span, -1)
    return int((edges.cumsum() > 0).sum())


def count(text: str) -> tuple[int, ...]:
    """The numbers named in COUNTS. Letters are those of ASCII and all characters beyond it."""
    raw = text.encode()
    size = lambda chars: len(raw) - len(raw.translate(None, chars))
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(word, len(seen)) for word in words), np.int64, len(words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    blanks, capitals = size(SPACES + b" "), size(CAPITALS)
    beyond = len(text) - len(raw.translate(None, BEYOND))
    return (
        len(words), len(text) - blanks, size(SYMBOLS), len(lines) - len(set(lines)),
        in_repeated_windows(ids, WINDOW) if len(seen) < len(words) else 0, len(lines), len(seen), capitals,
        capitals + size(SMALL) + beyond, size(MARKS), size(DIGITS),
    )


def vector() -> Column:
    """The statistics of a row of counts as whole numbers, in units."""
    share = lambda part, whole: F.asin(F.sqrt(F.coalesce(F.try_divide(part, whole), F.lit(0.0))))
    variety = F.when(F.col("n_words") > 1, F.log("n_distinct") / F.log("n_words")).otherwise(1.0)
    made = [
        F.log(F.coalesce(F.try_divide("word_chars", "n_words"), F.lit(1.0))), share("n_symbols", "word_chars"),
        share("n_capitals", "n_letters"), share("n_marks", "word_chars"), share("n_digits", "word_chars"),
        share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), variety,
    ]
    return F.array(*[F.round(x * UNIT).cast("long") for x in made])


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source``, the COUNTS and ``base_failed`` of each row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = np.array([count(text) for text in batch.column(3).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            columns = [batch.column(k) for k in range(3)] + [pa.array(np.ascontiguousarray(c)) for c in counts.T]
            yield pa.record_batch(columns, ["doc_id", "lang", "source", *COUNTS])

    own = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang", "source"))
    counted = docs.select("doc_id", "lang", "source", text_or_empty().alias("text")).mapInArrow(
        run, f"{own}, " + ", ".join(f"{c} long" for c in COUNTS)
    )
    n = F.col("n_words")
    return counted.withColumn("base_failed", (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * n))


def chi_square(x: float, k: int) -> float:
    """The share of sums of ``k`` squared normal numbers that is at most ``x``, by its series."""
    if x <= 0:
        return 0.0
    half, a = x / 2, k / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= half / n
        total += term
    return min(1.0, total * math.exp(a * math.log(half) - half - math.lgamma(a)))


def chi_limit(share: float, k: int) -> float:
    low, high = 0.0, 10.0 * k + 1000
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, k) < share else (low, middle)
    return high


def consistency(share: float, k: int) -> float:
    """What the scatter of the nearest ``share`` of normal vectors is to be multiplied by."""
    return share / chi_square(chi_limit(share, k), k + 2)


def model_of(n: int, sums: np.ndarray, products: np.ndarray, factor: float) -> tuple[list[float], list[float], float]:
    """Centre, packed inverse root of the scatter, and log-determinant, from sums over ``n`` vectors.

    The least spread of each statistic is added, so that the scatter has an inverse where a statistic is
    the same everywhere.
    """
    k = len(sums)
    mean, square = sums / n, np.zeros((k, k))
    square[np.tril_indices(k)] = products / n
    square += np.tril(square, -1).T
    return packed(mean, (square - np.outer(mean, mean)) * factor)


def packed(mean: np.ndarray, scatter: np.ndarray) -> tuple[list[float], list[float], float]:
    scatter = scatter + np.diag([(f * UNIT) ** 2 for f in FLOORS.values()])
    root = np.linalg.cholesky(scatter)
    inverse = np.linalg.inv(root)
    return mean.tolist(), inverse[np.tril_indices(len(mean))].tolist(), 2 * float(np.log(np.diag(root)).sum())


MODEL = "cell string, start int, centre array<double>, root array<double>, logdet double"
PAIRS = [(i, j) for i in range(len(FLOORS)) for j in range(i + 1)]


def distance(vector: str = "y") -> Column:
    """Squared Mahalanobis distance of a vector by ``centre`` and ``root``."""
    total = F.lit(0.0)
    for i in range(len(FLOORS)):
        row = F.lit(0.0)
        for j in range(i + 1):
            row += F.get("root", F.lit(i * (i + 1) // 2 + j)) * (F.get(vector, F.lit(j)) - F.get("centre", F.lit(j)))
        total += row * row
    return total


def moments(rows: DataFrame, keys: list[str], vector: str = "y") -> DataFrame:
    """Number, sums and sums of products of the vectors of each key: whole numbers, added up before the shuffle."""
    at = lambda k: F.get(vector, F.lit(k))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(at(k)) for k in range(len(FLOORS))]).alias("sums"),
        F.array(*[F.sum(at(i) * at(j)) for i, j in PAIRS]).alias("products"),
    )


def fitted(sums: DataFrame, factor: float) -> DataFrame:
    """A model from each row of :func:`moments`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                centre, root, logdet = model_of(row["n"], np.array(row["sums"], float), np.array(row["products"], float), factor)
                made.append({"cell": row["cell"], "start": row["start"], "centre": centre, "root": root, "logdet": logdet})
            yield pa.RecordBatch.from_pylist(made, MODEL_ARROW)

    return sums.select("cell", "start", "n", "sums", "products").mapInArrow(run, MODEL)


FLOATS = pa.list_(pa.float64())
MODEL_ARROW = pa.schema([("cell", pa.string()), ("start", pa.int32()), ("centre", FLOATS), ("root", FLOATS), ("logdet", pa.float64())])


def cells(vectors: DataFrame, rows: int = ROWS) -> DataFrame:
    """``group, cell``: what each language and source is judged with.

    Those with ``rows`` vectors stand alone. Smaller ones of a language are judged together, and those of
    languages that do not reach ``rows`` so, all together.
    """
    counts = stored(vectors.groupBy("group", "lang", "source").agg(F.count(F.lit(1)).alias("n")), "groups")
    few = counts.where(F.col("n") < rows)
    together = few.groupBy("lang").agg((F.sum("n") >= rows).alias("enough")).withColumnRenamed("lang", "of")
    alone = counts.where(F.col("n") >= rows).select("group", F.col("group").alias("cell"))
    by_lang = F.when(F.col("enough"), F.to_json(F.struct(F.lit("lang").alias("by"), "lang"))).otherwise("{}")
    return alone.union(few.join(together, F.col("lang").eqNullSafe(F.col("of"))).select("group", by_lang.alias("cell")))


def first_models(vectors: DataFrame, middles: DataFrame) -> DataFrame:
    """Two guesses a cell from vectors around the medians: spreads alone, and with the correlation of bounded vectors."""
    size = len(FLOORS)
    floor = [f * UNIT for f in FLOORS.values()]
    wide = vectors.join(middles.select("cell", "spread"), "cell")
    bounded = [F.round(F.tanh(F.get("y", F.lit(k)) / F.greatest(F.get("spread", F.lit(k)), F.lit(floor[k]))) * UNIT).cast("long") for k in range(size)]
    sums = moments(wide.select("cell", F.array(*bounded).alias("u")), ["cell"], "u").join(middles.select("cell", "spread"), "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                spread = np.maximum(np.array(row["spread"], float), floor)
                square = np.zeros((size, size))
                square[np.tril_indices(size)] = np.array(row["products"], float) / row["n"]
                square += np.tril(square, -1).T
                mean = np.array(row["sums"], float) / row["n"]
                scatter = square - np.outer(mean, mean)
                own = np.sqrt(np.maximum(np.diag(scatter), 1.0))
                correlation = scatter / np.outer(own, own)
                np.fill_diagonal(correlation, 1.0)
                for start, guess in enumerate((np.eye(size), correlation)):
                    centre, root, logdet = packed(np.zeros(size), guess * np.outer(spread, spread))
                    made.append({"cell": row["cell"], "start": start, "centre": centre, "root": root, "logdet": logdet})
            yield pa.RecordBatch.from_pylist(made, MODEL_ARROW)

    return sums.select("cell", "n", "sums", "products", "spread").mapInArrow(run, MODEL)


def concentrated(vectors: DataFrame, models: DataFrame, core: float) -> DataFrame:
    """The models of the nearest share ``core`` of each cell's vectors, by the models before.

    A histogram of distances gives the bin that completes the share, and the whole bin is taken.
    """
    keys = ["cell", "start"]
    placed = vectors.join(models.select("cell", "start", "centre", "root"), "cell")
    placed = placed.select(*keys, "y", F.floor(F.log1p(distance()) * BINS).cast("int").alias("bin"))
    bins = placed.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy(*keys)
    bins = bins.withColumn("below", F.sum("n").over(of.orderBy("bin"))).withColumn("all", F.sum("n").over(of))
    ends = bins.where(F.col("below") >= core * F.col("all")).groupBy(*keys).agg(F.min("bin").alias("end"))
    nearest = placed.join(stored(ends, "ends"), keys).where("bin <= end")
    return fitted(moments(nearest, keys), consistency(core, len(FLOORS)))


def estimate(vectors: DataFrame, core: float = CORE, steps: int = STEPS) -> DataFrame:
    """One model per cell of ``cell, y``, and its ``middle``, around which ``y`` is taken: ``cell, centre, root, middle``."""
    size = len(FLOORS)
    half = lambda c: F.array(*[F.percentile_approx(c(k), 0.5, 10_000) for k in range(size)])
    middles = stored(vectors.groupBy("cell").agg(half(lambda k: F.get("x", F.lit(k))).alias("middle")), "middles")
    around = F.array(*[F.get("x", F.lit(k)) - F.get("middle", F.lit(k)) for k in range(size)])
    vectors = stored(vectors.join(middles, "cell").select("cell", around.alias("y")), "centred")
    spread = vectors.groupBy("cell").agg(half(lambda k: F.abs(F.get("y", F.lit(k)))).alias("off"))
    spread = spread.select("cell", F.transform("off", lambda x: x * 1.4826).alias("spread"))
    middles = stored(middles.join(spread, "cell"), "spreads")
    models, before = stored(first_models(vectors, middles), "models"), None
    for _ in range(steps):
        models = stored(concentrated(vectors, models, core), "models")
        told = models.agg(F.sum(F.round("logdet", 6).cast("decimal(38,6)")).alias("logdet")).first().logdet
        if told == before:
            break
        before = told
    best = models.groupBy("cell").agg(F.min(F.struct("logdet", "start")).alias("best"))
    models = models.join(best, "cell").where("start = best.start").drop("best")
    # Sums once more over all that lies within the limit of ordinary vectors: less depends on the share.
    inside = vectors.join(models.select("cell", "start", "centre", "root"), "cell").where(distance() <= chi_limit(1 - REWEIGHT, size))
    models = fitted(moments(inside.select("cell", "start", "y"), ["cell", "start"]), consistency(1 - REWEIGHT, size))
    return stored(models.select("cell", "centre", "root").join(middles.select("cell", "middle"), "cell"), "models")


def judge(docs: DataFrame, core: float = CORE, rows: int = ROWS, reject: float = REJECT) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, lang, source``, the COUNTS, ``base_failed, distance, kept``.

    Reads ``doc_id, lang, source, text``. A null text has no words; texts that fail the base rules have no
    ``distance`` and are not kept. The others are kept unless their squared distance to their language and
    source is beyond what a share ``reject`` of ordinary vectors has. Null languages and sources are groups
    like any other; groups below ``rows`` are judged together by language, then all together; if even those
    are fewer, their rows have no ``distance`` and are kept. Rows are judged one by one, repeated ones and those
    with a null ``doc_id`` too. No row gives no row.
    """
    group = F.to_json(F.struct("lang", "source"))
    measured = stored(measure(docs).withColumn("group", group).withColumn("x", vector()), "counts")
    fit = measured.where("NOT base_failed")
    places = stored(cells(fit, rows), "cells")
    vectors = stored(fit.select("group", "x").join(places, "group").select("cell", "x"), "vectors")
    enough = stored(vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rows).select("cell"), "enough")
    models = places.join(estimate(vectors.join(enough, "cell", "left_semi"), core), "cell").drop("cell")
    y = F.array(*[F.get("x", F.lit(k)) - F.get("middle", F.lit(k)) for k in range(len(FLOORS))])
    judged = measured.join(models, "group", "left").withColumn("y", y)
    far = F.when(~F.col("base_failed"), distance())
    kept = ~F.col("base_failed") & F.coalesce(far <= chi_limit(1 - reject, len(FLOORS)), F.lit(True))
    return judged.select("doc_id", "lang", "source", *COUNTS, "base_failed", far.alias("distance"), kept.alias("kept"))


def keep_ordinary(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, all columns as they are."""
    key = F.unhex(F.sha2(F.to_json(F.struct("text", "lang", "source")), 256)).alias("doc_id")
    keyed = docs.select(key, F.struct("*").alias("row"))
    judged = judge(keyed.select("doc_id", "row.text", "row.lang", "row.source"), **how)
    return keyed.join(judged.where("kept").select("doc_id").distinct(), "doc_id", "left_semi").select("row.*")
