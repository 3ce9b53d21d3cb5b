"""Language identification by unigrams of pieces, summed over all segmentations.

Pieces come from a fixed public vocabulary. For each language, expectation-maximisation fits the pieces'
probabilities on a bounded sample of labelled texts: a forward and a backward pass over the lattice of
each distinct word give every piece its expected count. A text's likelihood is the product over its words
of the forward sum, so no segmentation is chosen; the language with the largest posterior wins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.bpe import slices
from runledger.llm.common import counted_side, kept
from runledger.session import stored

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Texts of each language that its model is fitted on, at most, and the rounds of fitting.
SAMPLE, ROUNDS = 300, 5
#: Words of more characters need scaling and are gone through in step; pieces of more are not looked for.
PART, LONGEST = 32, 16
#: Count that each piece has beforehand, and the probability of a character that no piece has.
PRIOR, UNSEEN = 0.02, 1e-7
#: Words that a Python worker remembers, and how many are worked out together.
HELD, TOGETHER = 400_000, 20_000
UNKNOWN = "und"
#: Score under which a text is rejected, as no language is clearly ahead; that takes a very short text.
LEAST = 0.5


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """Number of each piece, from 2 on; 0 stands for no piece, 1 for a character without one."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [n for n in range(model.get_piece_size()) if not (model.is_control(n) or model.is_unknown(n) or model.is_byte(n))]
    return {model.id_to_piece(n): place for place, n in enumerate(plain, 2)}


def word_of(chunk: str) -> str:
    """A chunk in lower case from its first to its last letter or digit; empty if it has no letter."""
    if not any(map(str.isalpha, chunk)):
        return ""
    low, high = 0, len(chunk)
    while not chunk[low].isalnum():
        low += 1
    while not chunk[high - 1].isalnum():
        high -= 1
    return chunk[low:high].lower()


@lru_cache(maxsize=PART + 1)
def stretches(n: int) -> list[tuple[int, int, int]]:
    """Start, end and the number that stands for no piece, of each stretch of n characters, by its end."""
    return [(i, j, int(j - i == 1)) for j in range(1, n + 1) for i in range(max(0, j - LONGEST), j)]


def lattices(parts: Sequence[str], pieces: dict[str, int]) -> Iterator[tuple[np.ndarray, list, np.ndarray]]:
    """Parts of one length at a time: their places, the stretches, and the piece on each stretch."""
    by_length: dict[int, list[int]] = {}
    for place, part in enumerate(parts):
        by_length.setdefault(len(part), []).append(place)
    get = pieces.get
    for n, places in by_length.items():
        spans = stretches(n)
        for low in range(0, len(places), TOGETHER):
            some = places[low : low + TOGETHER]
            found = [[get(part[i:j], none) for i, j, none in spans] for part in map(parts.__getitem__, some)]
            yield np.array(some), spans, np.array(found, np.int32)


def forward(spans: list, found: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of each beginning, by language."""
    sums = np.zeros((spans[-1][1] + 1, len(found), chances.shape[1]))
    sums[0] = 1
    for s, (i, j, _) in enumerate(spans):
        sums[j] += sums[i] * chances[found[:, s]]
    return sums


def steps(words: Sequence[str], pieces: dict[str, int]) -> Iterator[np.ndarray]:
    """For each character of words that come longest first, the pieces that end there, longest first, by word.

    Words that have ended are left out.
    """
    get, live = pieces.get, len(words)
    for j in range(1, len(words[0]) + 1 if words else 0):
        while len(words[live - 1]) < j:
            live -= 1
        lengths = [(k, int(k == 1)) for k in range(LONGEST, 0, -1)]
        yield np.array([[get(word[j - k : j], none) if k <= j else 0 for k, none in lengths] for word in words[:live]], np.int32)


def carried(every: Iterable[np.ndarray], count: int, chances: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Forward sums of long words, scaled: only the last LONGEST are carried on, the latest as 1.

    For each character the factor by which the sum grows, and the share of it that each piece ending there has.
    """
    held = np.zeros((count, LONGEST, chances.shape[1]))
    held[:, -1] = 1
    for found in every:
        shares = held[: len(found)] * chances[found]
        grown = shares.sum(axis=1)
        yield grown, shares / grown[:, None]
        held = np.concatenate((held[: len(found), 1:] / grown[:, None], np.ones((len(found), 1, chances.shape[1]))), axis=1)


def by_size(words: Sequence[str]) -> tuple[list[int], list[list[int]]]:
    """Places of the short words, and those of the long ones, longest first, some at a time."""
    short = [place for place, word in enumerate(words) if len(word) <= PART]
    long = sorted((place for place, word in enumerate(words) if len(word) > PART), key=lambda place: -len(words[place]))
    return short, [long[low : low + TOGETHER] for low in range(0, len(long), TOGETHER)]


def log_chances(words: Sequence[str], pieces: dict[str, int], chances: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word in each language, over all segmentations of the whole word."""
    out, words = np.zeros((len(words), chances.shape[1])), ["▁" + word for word in words]
    short, groups = by_size(words)
    owner = np.array(short, np.int64)
    for places, spans, found in lattices([words[place] for place in short], pieces):
        out[owner[places]] = np.log(forward(spans, found, chances)[-1])
    for group in groups:
        total = np.zeros((len(group), chances.shape[1]))
        for grown, _ in carried(steps([words[place] for place in group], pieces), len(group), chances):
            total[: len(grown)] += np.log(grown)
        out[group] = total
    return out


def fit(words: Counter, pieces: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """Probability of each piece, by expectation-maximisation over the words' segmentations."""
    size, all_words, counts = len(pieces) + 2, ["▁" + word for word in words], np.array(list(words.values()), float)
    short, groups = by_size(all_words)
    owner = np.array(short, np.int64)
    every = [(spans, found, counts[owner[p]]) for p, spans, found in lattices([all_words[place] for place in short], pieces)]
    long = [(list(steps([all_words[place] for place in group], pieces)), counts[group]) for group in groups]
    chances = np.full(size, 1 / size)
    chances[:2] = 0, UNSEEN
    for _ in range(rounds):
        expected = np.zeros(size)
        for spans, found, weight in every:
            ahead = forward(spans, found, chances[:, None])[:, :, 0]
            behind = np.zeros_like(ahead)
            behind[-1] = weight / ahead[-1]
            for s in range(len(spans) - 1, -1, -1):
                i, j, _ = spans[s]
                here = chances[found[:, s]] * behind[j]
                behind[i] += here
                expected += np.bincount(found[:, s], here * ahead[i], size)
        for found_at, weight in long:
            # How likely a piece ends at each character goes back by the shares, the last one's being certain.
            shares = [share[:, :, 0] for _, share in carried(found_at, len(weight), chances[:, None])]
            ends, live = np.zeros((len(weight), LONGEST + 1)), 0
            for found, share in zip(reversed(found_at), reversed(shares)):
                ends[live : len(found), -1] = weight[live : len(found)]
                live = len(found)
                here = ends[:live, -1:] * share
                expected += np.bincount(found.ravel(), here.ravel(), size)
                ends[:live, 1:] = ends[:live, :-1]
                ends[:live, 0] = 0
                ends[:live, 1:] += here
        expected[:2] = 0
        chances = (expected + PRIOR) / (expected.sum() + PRIOR * size)
        chances[:2] = 0, UNSEEN
    return chances


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, path: str = VOCABULARY, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Probabilities of the pieces in each language.

    Learns from ``text`` and non-null ``lang`` of documents that are not held out, at most ``sample`` whole
    texts of each language, chosen by a hash of ``doc_id``. Languages are fitted apart, each in a task.
    """
    open_ = docs.select("doc_id", "lang", "text").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy("_hash", "doc_id")
    chosen = open_.select("doc_id", "lang", F.xxhash64("doc_id").alias("_hash"))
    chosen = chosen.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample)
    chosen = stored(chosen.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct(), "sample")
    texts = open_.join(counted_side(chosen), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi")

    def fit_one(rows: pd.DataFrame) -> pd.DataFrame:
        words = Counter(word for text in rows["text"] for word in map(word_of, text.split()) if word)
        found = fit(words, vocabulary(path)) if words else np.zeros(0)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "chances": [found.tolist()]})

    models = texts.select("lang", "text").groupBy("lang").applyInPandas(fit_one, "lang string, chances array<double>")
    return {row.lang: np.array(row.chances) for row in models.orderBy("lang").collect() if row.chances}


class Identifier:
    def __init__(self, models: dict[str, np.ndarray], path: str) -> None:
        self.languages, self.pieces = list(models), vocabulary(path)
        # The last column is the background, any piece being as likely as any other.
        any_piece = np.full(len(self.pieces) + 2, 1 / len(self.pieces))
        any_piece[:2] = 0, UNSEEN
        self.chances = np.stack([*models.values(), any_piece], axis=1)
        self.forget()

    def forget(self) -> None:
        """Place 0 is that of a chunk without a letter."""
        self.place: dict[str, int] = {}
        self.logs = [np.zeros((1, self.chances.shape[1]))]
        self.held = 1

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language and score of each text, and whether the language explains it better than the background does."""
        if self.held > HELD:
            self.forget()
        new = list(set().union(*[t.split() for t in texts if t]).difference(self.place))
        words = list(map(word_of, new))
        some = list({w for w in words if w})
        self.logs.append(log_chances(some, self.pieces, self.chances))
        of_word = dict(zip(some, range(self.held, self.held + len(some)))) | {"": 0}
        self.place.update(zip(new, map(of_word.__getitem__, words)))
        self.held += len(some)
        logs = np.concatenate(self.logs)
        self.logs = [logs]
        return [self.judge(logs, text) for text in texts]

    def judge(self, logs: np.ndarray, text: str | None) -> tuple[str, float, bool]:
        places = np.fromiter(map(self.place.__getitem__, text.split()), np.int64) if text else np.zeros(0, np.int64)
        if not self.languages or not places.any():
            return UNKNOWN, 0.0, False
        *total, background = logs[places].sum(axis=0)
        total = np.array(total)
        chances = np.exp(total - total.max())
        best = int(chances.argmax())
        return self.languages[best], float(chances[best] / chances.sum()), bool(total[best] > background)


def identifier(models: Broadcast, path: str) -> Identifier:
    """Words that an earlier task of this worker has met need not be worked out again."""
    value = models.value
    return kept(("language", path, *[(language, hash(v.tobytes())) for language, v in value.items()]), lambda: Identifier(value, path))


def keep_identified(docs: DataFrame, least: float = LEAST, path: str = VOCABULARY, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose language :func:`identify` tells with a score of at least ``least``, all columns as they are.

    Texts that get ``und`` go, and so do those that any piece being as likely as any other explains better
    than the best language does: other languages and gibberish. The score tells learned languages apart
    only and is near 1 beyond a few words, so a mixture of them stays unless it fails the second test. Rows are judged
    where they are read; nothing is shuffled. A null text goes; rows that repeat, or have a null ``doc_id`` or a
    null ``lang``, fare as their text does. No row gives none, and where nothing can be learned none stays.
    """
    models = docs.sparkSession.sparkContext.broadcast(learn(docs, path, sample))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = identifier(models, path)
        for batch in slices(batches, 1500):
            found = judge(batch.column(place).to_pylist())
            yield batch.filter(pa.array([fits and score >= least for _, score, fits in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, path: str = VOCABULARY, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, held_out, lang_pred, score``.

    Learns as :func:`learn` does and predicts from ``text`` alone. A null text, a text without a letter,
    and any text where nothing could be learned, get ``und`` with score 0; otherwise the score is the
    posterior of the language, all languages being as likely beforehand. Ties go to the first by code
    point. No row gives no row.
    """
    models = docs.sparkSession.sparkContext.broadcast(learn(docs, path, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = identifier(models, path)
        for batch in slices(batches, 1500):
            found = judge(batch.column(2).to_pylist())
            languages, scores, _ = zip(*found) if found else ((), (), ())
            columns = [batch.column(0), batch.column(1), pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
            yield pa.record_batch(columns, ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
