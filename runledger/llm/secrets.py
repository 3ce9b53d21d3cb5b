"""Secrets: spans by fixed rules, and strings that look random rather than like an identifier.

Two Markov models of characters, one of random strings and one of ordinary identifiers, are trained on
labelled samples: what the base rules find, and words beside it. A long token whose log-likelihood ratio
speaks for the random model clearly enough is a secret, too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.bpe import slices
from runledger.llm.common import text_or_empty
from runledger.session import stored

KINDS = ("assign", "access", "hex", "random")
#: Documents that each model's strings are taken from, at most.
SAMPLE = 2000
#: Least log-likelihood ratio of a secret, in all and for each character.
TOTAL, EACH = 15.0, 0.5
#: Count that each character has beforehand, and the weight of single characters in that of pairs.
PRIOR, SINGLE = 0.5, 10.0

# The base rules. The stretches that access and hex leave out hold no match further on.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Ordinary strings: words shorter than any token that is judged, and numbers.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z][A-Za-z0-9_-]{5,14}|[0-9]{4,})(?![A-Za-z0-9+/_=-])")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end by the base rules, by start and kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def overlaps(start: int, end: int, spans: list[tuple[int, int, int]]) -> bool:
    return any(start < high and low < end for low, _, high in spans)


def value_of(text: str, start: int, kind: int, end: int) -> str:
    """The string that is to be secret, without the name that it is assigned to."""
    return ASSIGN.match(text, start).group(2) if kind == 0 else text[start:end]


def codes(string: str) -> np.ndarray:
    """Characters as numbers, from a start of 0; all beyond ASCII share 127."""
    return np.array([0, *[min(ord(c), 127) for c in string]], np.int64)


def log_chances(counts: np.ndarray) -> np.ndarray:
    """Log-probability of each character after each; pairs seen too seldom follow the single characters."""
    single = counts.sum(axis=0) + PRIOR
    return np.log((counts + SINGLE * single / single.sum()) / (counts.sum(axis=1, keepdims=True) + SINGLE))


def ratio(string: str, models: np.ndarray) -> float:
    """Log-likelihood ratio for random against ordinary; ``models`` is the difference of the two."""
    seen = codes(string)
    return float(models[seen[:-1], seen[1:]].sum())


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, spans, values, tokens, n_tokens``: base spans, their secrets, and other long tokens with their start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
        token = pa.struct([("start", pa.int32()), ("token", pa.string())])
        for batch in slices(batches):
            spans, values, tokens = [], [], []
            for text in batch.column(1).to_pylist():
                found = base_spans(text)
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                values.append([value_of(text, *f) for f in found])
                rest = [m for m in TOKEN.finditer(text) if not overlaps(*m.span(), found)]
                tokens.append([{"start": m.start(), "token": m.group()} for m in rest])
            columns = [batch.column(0), pa.array(spans, pa.list_(span)), pa.array(values, pa.list_(pa.string())), pa.array(tokens, pa.list_(token))]
            yield pa.record_batch(columns, ["doc_id", "spans", "values", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        run,
        f"doc_id {kind}, spans array<struct<start: int, kind: int, end: int>>, values array<string>, "
        "tokens array<struct<start: int, token: string>>",
    )


def train_both(docs: DataFrame, found: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """The models' difference, from the strings of at most ``sample`` documents each; None without secrets.

    The documents are those of the smallest hashes of ``doc_id``, then of the smallest id and strings, so that a rerun
    takes the same. A document's strings are counted where it is; only pair counts reach the driver.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(128 * 128, np.int64)
        for batch in batches:
            for strings in batch.column(0).to_pylist():
                for string in strings:
                    seen = codes(string)
                    np.add.at(counts, seen[:-1] * 128 + seen[1:], 1)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used), pa.array(counts[used])], ["pair", "n"])

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = []
            for text in batch.column(0).to_pylist():
                spans = base_spans(text)
                words.append([m.group() for m in IDENTIFIER.finditer(text) if not overlaps(*m.span(), spans)])
            yield pa.record_batch([pa.array(words, pa.list_(pa.string()))], ["strings"])

    def counted(strings: DataFrame) -> np.ndarray:
        parts = strings.mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        counts = np.zeros(128 * 128)
        for row in parts.collect():
            counts[row.pair] += row.n
        return counts.reshape(128, 128)

    order = F.xxhash64("doc_id")
    random = counted(found.where(F.size("values") > 0).select("doc_id", "values").orderBy(order, "doc_id", "values").limit(sample).select("values"))
    if not random.any():
        return None
    ids = docs.select("doc_id").orderBy(order, "doc_id").limit(sample).select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(text_or_empty().alias("text"))
    plain = counted(texts.mapInArrow(ordinary, "strings array<string>"))
    return log_chances(random) - log_chances(plain)


def secret_spans(docs: DataFrame, sample: int = SAMPLE, total: float = TOTAL, each: float = EACH) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, spans``, by the base rules and by the models.

    Reads ``doc_id`` and ``text``; a null or empty text has no spans. A span tells ``start``, ``kind`` (a place
    in KINDS, ``random`` for the models') and ``end``, in code points, end exclusive; spans come by start and
    kind. A token is at least 16 characters long, overlaps no base span, and is random if its ratio is at
    least ``total`` and ``each`` times its length. Where no base span is found, nothing is learned and no
    token is random. No row gives no row.
    """
    found = stored(find_spans(docs), "secrets")
    models = train_both(docs.select("doc_id", "text"), found, sample)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            rows = []
            for spans, tokens in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for token in tokens if models is not None else ():
                    string = token["token"]
                    if ratio(string, models) >= max(total, each * len(string)):
                        spans.append({"start": token["start"], "kind": 3, "end": token["start"] + len(string)})
                rows.append(sorted(spans, key=lambda s: (s["start"], s["kind"])))
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(span))], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "spans", "tokens").mapInArrow(judge, f"doc_id {kind}, spans array<struct<start: int, kind: int, end: int>>")
