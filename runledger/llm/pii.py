"""Personal data: labelers vote on spans, their reliabilities are estimated, a classifier decides.

The base rules give spans that always stay. Looser rules propose more. On each span, of either sort, four
labelers vote for, against or not at all: the format by pattern, a gazetteer, cues in the words before, and
the characters beside it. Expectation-maximisation finds from all documents' votes how reliable each labeler
is on each kind and how likely each combination of votes is to be right. With these likelihoods as its aims, a logistic
classifier learns from spans themselves: their length, shape and digit groups, the words and characters around
them, and the votes. It decides on the proposed spans, so that two spans with the same votes may fare
differently.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.bpe import slices
from runledger.llm.common import text_or_empty
from runledger.session import stored

KINDS = ("email", "ip", "card", "phone")
#: A proposed span is taken if the classifier gives it this probability.
ACCEPT = 0.9
ROUNDS, STEPS = 30, 400
#: Spans of each kind that the classifier learns from at most, those of the smallest hashes, and its hashed features.
SAMPLE, FEATURES = 5000, 4096
#: Characters before a span in which cues count.
NEAR = 32

# The base rules.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# A run of digits that does not begin an address does not begin one further on either.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser rules, gazetteers and cues.
SPELT_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]+)+", re.I
)
LONG_IP = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])")
# Top domains that are no country's, those of countries whose name differs from their ISO code, and test names.
GENERIC = frozenset(
    "aero app arpa art asia biz blog cat cloud com coop dev edu email gov info int jobs mil mobi museum name net news "
    "online org post pro shop site store tech tel travel world xyz eu uk su".split()
)
# Calling codes. Those of two digits; the first two digits of those of three; unassigned ones among these.
TWO = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
THREE = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
UNASSIGNED = frozenset(
    "210 214 215 217 219 259 292 293 294 295 296 384 388 422 424 425 426 427 428 429 671 684 693 694 695 696 697 698 699 "
    "801 802 803 804 805 806 807 809 851 854 857 858 859 871 872 873 874 875 876 877 879 884 885 887 889 969 978 990 991 997 999".split()
)


def calling(digits: str) -> bool:
    """Whether a number begins with an assigned calling code: 1 or 7, or one of two or three digits."""
    return digits[:1] in ("1", "7") or digits[:2] in TWO or digits[:2] in THREE and digits[:3] not in UNASSIGNED


def domains(spark: SparkSession) -> frozenset[str]:
    """Top domains: generic ones, and the countries that the Java runtime knows."""
    return GENERIC | {code.lower() for code in spark.sparkContext._jvm.java.util.Locale.getISOCountries()}


CUES = {
    "email": re.compile(r"e-?mail|contact|write to|reach|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|client", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|call|tel\b|mobile|fax|cell|telefon|t[ée]l[ée]", re.I),
}
AGAINST = re.compile(r"version|\bv\.?$|section|chapter|isbn|issn|order|serial|\bno\.?\x20?$|\bid\b|doi|figure", re.I)


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def digits_of(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What EMAIL finds, looked for around each @ only."""
    done, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > done and text[low - 1] in LOCAL:
            low -= 1
        found = EMAIL.match(text, low) if low < at else None
        if found:
            yield found.span()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Kind, start and end by the base rules."""
    out = [(0, *span) for span in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(map(small, m.group().split(".")))]
    for m in CARD.finditer(text):
        digits = digits_of(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(digits_of(m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def proposed_spans(text: str) -> list[tuple[int, int, int]]:
    """Kind, start and end by looser rules, base spans among them."""
    out = []
    if re.search(r"at[)\]]", text, re.I):
        out += [(0, *m.span()) for m in SPELT_EMAIL.finditer(text)]
    if text.count(":") >= 7:
        out += [(1, *m.span()) for m in LONG_IP.finditer(text)]
    out += [(2, *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(digits_of(m.group())) <= 19]
    return out + [(3, *m.span()) for m in LOCAL_PHONE.finditer(text)]


def by_format(kind: int, span: str) -> int:
    if kind == 0:
        return 1 if re.search(r"[A-Za-z]{2,}$", span) and ".." not in span else -1
    if kind == 1:
        return 1 if ":" in span or all(p == "0" or p[0] != "0" for p in span.split(".")) else -1
    if kind == 2:
        return 1 if luhn(digits_of(span)) else -1
    return 1 if 10 <= len(digits_of(span)) <= 13 and span.count("(") == span.count(")") else -1


def by_gazetteer(kind: int, span: str, tops: frozenset[str]) -> int:
    if kind == 0:
        return 1 if re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]"))[-1].lower() in tops else -1
    if kind == 1:
        return 0 if ":" in span else 1 if 0 < int(span.split(".")[0]) < 224 else -1
    digits = digits_of(span)
    if kind == 2:
        return 1 if digits[0] in "3456" else -1
    if span[0] != "+":
        return 1 if digits[0] > "1" else -1
    return 1 if calling(digits) else -1


def by_cue(kind: int, before: str) -> int:
    return 1 if CUES[KINDS[kind]].search(before) else -1 if AGAINST.search(before) else 0


def by_neighbours(before: str, after: str) -> int:
    return -1 if before[-1:].isalnum() or before[-1:] in tuple("/_-=#") or after[:1].isalnum() or after[:1] in tuple("/_-=") else 1


def votes(kind: int, start: int, end: int, text: str, tops: frozenset[str] = GENERIC) -> str:
    """One sign for each labeler."""
    span, before, after = text[start:end], text[max(0, start - NEAR) : start], text[end : end + 1]
    cast = (by_format(kind, span), by_gazetteer(kind, span, tops), by_cue(kind, before), by_neighbours(before, after))
    return "".join("-0+"[vote + 1] for vote in cast)


def features(kind: int, start: int, end: int, text: str, cast: str) -> list[int]:
    """Hashed features of a span: votes, length, shape, digit groups, and what stands around it."""
    span, before, after = text[start:end], text[max(0, start - NEAR) : start], text[end : end + NEAR]
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", lambda m: f"9{min(len(m.group()), 6)}", span))
    words, next_ = re.findall(r"[^\W_]+", before.lower())[-2:], re.findall(r"[^\W_]+", after.lower())[:1]
    told = [f"vote {n} {v}" for n, v in enumerate(cast)] + [
        "any", f"votes {cast}", f"length {min(len(span) // 4, 12)}", f"shape {shape[:40]}", f"digits {min(sum(groups), 24)}",
        f"groups {min(len(groups), 9)}", f"longest {min(max(groups, default=0), 20)}", f"left {before[-1:]}", f"right {after[:1]}",
        f"after {' '.join(next_)}", f"near {' '.join(words[-1:])}", f"first {start == 0 or text[start - 1] == chr(10)}",
    ] + [f"word {w}" for w in words]
    return sorted({zlib.crc32(f"{kind} {name}".encode()) % FEATURES for name in told})


def spans_of(text: str, tops: frozenset[str] = GENERIC) -> list[tuple[int, int, int, bool, str, list[int]]]:
    """Kind, start, end, whether by the base rules, votes and features; by kind and start. No proposal overlaps a base span."""
    base = base_spans(text)
    taken = [(start, end) for _, start, end in base]
    more = [
        (kind, start, end) for kind, start, end in proposed_spans(text)
        if not any(start < high and low < end for low, high in taken)
    ]
    rows = [(*span, True) for span in base] + [(*span, False) for span in more]
    out = []
    for kind, start, end, sure in sorted(rows):
        cast = votes(kind, start, end, text, tops)
        out.append((kind, start, end, sure, cast, features(kind, start, end, text, cast)))
    return out


SPAN = "array<struct<kind: int, start: int, end: int, base: boolean, votes: string, features: array<int>>>"
SPAN_ARROW = pa.list_(pa.struct([
    ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()),
    ("features", pa.list_(pa.int32())),
]))


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``: base and proposed spans of each text, with their votes; start and end in code points."""
    tops = domains(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "base", "votes", "features")
        for batch in slices(batches):
            found = [[dict(zip(names, s)) for s in spans_of(text, tops)] for text in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, SPAN_ARROW)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, spans {SPAN}")


def reliabilities(ballots: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Likelihood that each combination of votes (-1, 0, 1) is right, by expectation-maximisation."""
    # To begin with, a vote against weighs as much as three for: labelers vote for most of what the rules propose.
    right = 1 / (1 + np.exp(-1.5 * ((ballots > 0).sum(axis=1) - 3 * (ballots < 0).sum(axis=1))))
    cast = ballots[:, :, None] == np.array([-1, 0, 1])
    for _ in range(rounds):
        # A labeler is taken to be right rather than wrong beforehand, by a few spans' worth.
        yes = np.einsum("p,plv->lv", n * right, cast) + np.array([1.0, 1.0, 3.0])
        no = np.einsum("p,plv->lv", n * (1 - right), cast) + np.array([3.0, 1.0, 1.0])
        share = (n @ right + 1) / (n.sum() + 2)
        odds = np.log(share / (1 - share)) + np.einsum("plv,lv->p", cast, np.log(yes / yes.sum(1, keepdims=True)) - np.log(no / no.sum(1, keepdims=True)))
        right = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return right


def likelihoods(counts: list[tuple[int, str, int]]) -> dict[tuple[int, str], float]:
    """How likely spans of a kind with these votes are right, from how often each combination occurs."""
    out = {}
    for kind in sorted({kind for kind, *_ in counts}):
        here = [(cast, n) for k, cast, n in counts if k == kind]
        ballots = np.array([["-0+".index(v) - 1 for v in cast] for cast, _ in here])
        right = reliabilities(ballots, np.array([n for _, n in here], float))
        out |= {(kind, cast): float(p) for (cast, _), p in zip(here, right)}
    return out


def trained(rows: list[tuple[float, list[int]]], steps: int = STEPS) -> np.ndarray:
    """Weights of the features, from spans with the likelihood that each is right; the last weight is of no feature."""
    weights = np.zeros(FEATURES + 1)
    if not rows:
        return weights
    most = max(len(found) for _, found in rows)
    at = np.full((len(rows), most), FEATURES)
    for n, (_, found) in enumerate(rows):
        at[n, : len(found)] = found
    aim, sums = np.array([p for p, _ in rows]), np.full(FEATURES + 1, 1e-8)
    for _ in range(steps):
        error = aim - 1 / (1 + np.exp(-np.clip(weights[at].sum(axis=1), -50, 50)))
        slope = np.bincount(at.ravel(), np.repeat(error, most), FEATURES + 1) / len(rows) - 1e-4 * weights
        slope[FEATURES] = 0.0
        sums += slope * slope
        weights += 0.3 * slope / np.sqrt(sums)  # rare features learn as fast as frequent ones
    return weights


def sampled(found: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` spans of each kind: ``kind, votes, features``. Spans alike in order are alike in all of it."""
    each = found.select("doc_id", F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features", F.xxhash64("doc_id", "s").alias("at"))
    parts = [each.where(F.col("kind") == k).orderBy("at", "votes", "features").limit(sample) for k in range(len(KINDS))]
    return reduce(DataFrame.union, parts).drop("at")


def personal_data(docs: DataFrame, least: float = ACCEPT, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, spans``, those found by the base rules and those accepted.

    Reads ``doc_id`` and ``text``; a null or empty text has no spans. A span tells ``kind`` (a place in KINDS),
    ``start``, ``end`` (code points, end exclusive), ``base`` and ``votes``; spans come by kind and start.
    Votes of all documents are counted by combination, of which there are 4 * 3 ** 4 at most; only these
    counts, and the features of at most ``sample`` spans of each kind, reach the driver. No row gives no row.
    """
    found = stored(find_spans(docs), "spans")
    each = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").count()
    right = likelihoods([(row.kind, row.votes, row["count"]) for row in each.orderBy("kind", "votes").collect()])
    weights = trained([(right[row.kind, row.votes], row.features) for row in sampled(found, sample).collect()])
    limit = float(np.log(least / (1 - least)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[s for s in spans if s["base"] or weights[s["features"]].sum() >= limit] for spans in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(rows, SPAN_ARROW)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    kept = found.mapInArrow(judge, f"doc_id {kind}, spans {SPAN}")
    parts = ("kind", "start", "end", "base", "votes")
    return kept.select("doc_id", F.transform("spans", lambda s: F.struct(*[s[c].alias(c) for c in parts])).alias("spans"))
