"""I-Match fingerprints: hashes of a document's terms in randomised subsets of a lexicon.

The lexicon holds the terms whose inverse document frequency lies in a band: neither those that most
documents have nor those that hardly any has. For each subset of the lexicon, the document's distinct
terms in it are sorted and hashed. Subsets of all densities, from the whole lexicon down to a small part,
make likeness graded: dense ones tell near copies from others, sparse ones agree for distant kin.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import shuffle_partitions, text_or_empty
from runledger.session import stored

#: Terms are kept if at least one document in RARE has them and at most one in COMMON.
RARE, COMMON = 2000, 8
#: A subset holds a term with probability 1 / 2 ** n; the first is the whole lexicon.
SUBSETS = (0, 2, 4, *[5, 6] * 3, *[7, 8] * 5, *[9, 10] * 8)
#: Hexadecimal digits of the fingerprint for each subset: all 64 bits of the hash, so that unlike texts with few
#: terms of the lexicon have unlike fingerprints, and a part by itself can be matched among many documents.
DIGITS = 16
#: Terms that a Python worker counts before it hands them over.
HELD = 500_000
EMPTY = "-" * DIGITS
#: ASCII letters and digits stay, in lower case, and so does all beyond ASCII; the rest parts terms.
FOLD = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str) -> set[bytes]:
    return set(text.encode().translate(FOLD).split())


def document_frequencies(docs: DataFrame, rare: int) -> DataFrame:
    """``term, n, word``: the number of documents that have each term, by its hash, and the term if it may be kept.

    A term that one document in ``rare`` has is that frequent in some task, too. Only there it is spelt out;
    the many others are shuffled as numbers.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = Counter(), 0

        def handed_over() -> Iterator[pa.RecordBatch]:
            found = list(counts.items())
            for low in range(0, len(found), 50_000):
                some = found[low : low + 50_000]
                columns = [
                    pa.array([xxhash.xxh3_64_intdigest(word) - (1 << 63) for word, _ in some], pa.int64()),
                    pa.array([n for _, n in some], pa.int64()),
                    pa.array([word if n * rare >= texts else None for word, n in some], pa.binary()),
                ]
                yield pa.record_batch(columns, ["term", "n", "word"])
            counts.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(terms_of(text))
                texts += 1
                if len(counts) > HELD:
                    yield from handed_over()
                    texts = 0
        yield from handed_over()

    parts = docs.select(text_or_empty().alias("text")).mapInArrow(count, "term long, n long, word binary")
    return parts.groupBy("term").agg(F.sum("n").alias("n"), F.max("word").alias("word"))


def lexicon(docs: DataFrame, rare: int = RARE, common: int = COMMON) -> list[bytes]:
    """The terms in the band, in order; all documents count.

    Each document adds its distinct terms to the sum of frequencies, and a kept term takes up 1 / ``rare``
    of the documents, so the lexicon has at most ``rare`` times the mean number of distinct terms of a
    document, however many documents there are. A term of one document only is never kept.
    """
    total = docs.count()
    kept = document_frequencies(docs, rare).where(
        (F.col("n") * rare >= total) & (F.col("n") >= 2) & (F.col("n") * common <= total)
    )
    return sorted(bytes(row.word) for row in kept.select("word").collect())


class Fingerprinter:
    def __init__(self, words: list[bytes]) -> None:
        self.words, self.place = frozenset(words), dict(zip(words, range(len(words))))
        self.hashes = np.array([xxhash.xxh3_64_intdigest(word) for word in words], np.uint64)
        subsets = np.arange(len(SUBSETS), dtype=np.uint64)
        mixed = self.hashes[:, None] ^ (subsets * np.uint64(0x9E3779B97F4A7C15))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
        self.member = (mixed & ((np.uint64(1) << np.array(SUBSETS, np.uint64)) - np.uint64(1))) == 0

    def __call__(self, text: str) -> str:
        found = terms_of(text)
        kept = found & self.words
        if not kept:
            return "=" + xxhash.xxh3_64_hexdigest(b" ".join(sorted(found)))
        places = np.sort(np.fromiter(map(self.place.__getitem__, kept), np.int64, len(kept)))
        hashes, member = self.hashes[places], self.member[places].T
        parts = []
        for held, some in zip(member, member.any(axis=1).tolist()):
            parts.append(xxhash.xxh3_64_hexdigest(hashes[held].tobytes()) if some else EMPTY)
        return "".join(parts)


def likeness(one: str, other: str) -> float:
    """Share of the subsets on which two fingerprints agree, of those in which either has a term."""
    if one == other:
        return 1.0
    if "=" in (one[0], other[0]):
        return 0.0
    pairs = [(one[n : n + DIGITS], other[n : n + DIGITS]) for n in range(0, len(one), DIGITS)]
    used = [a == b for a, b in pairs if a != EMPTY or b != EMPTY]
    return sum(used) / len(used)


def fingerprint(docs: DataFrame, rare: int = RARE, common: int = COMMON) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fingerprint``.

    Reads ``doc_id`` and ``text``; a null text counts as empty. Equal texts have equal fingerprints. A
    text without a term of the lexicon, an empty one too, gets ``=`` and a hash of all its terms, which
    is like itself only. No row gives no row.
    """
    terms = docs.sparkSession.sparkContext.broadcast(lexicon(docs, rare, common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(terms.value)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(map(make, batch.column(1).to_pylist()), pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def edit(text: str, following: str) -> str:
    """A text whose last half is replaced by as many code points, or all, of the following text's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, rare: int = RARE, common: int = COMMON) -> DataFrame:
    """Fingerprints of each text and of an edited one, and how alike they are.

    Returns ``doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next`` with
    ``edited`` the edited text's SHA-256. The next document is that of the next smaller ``doc_id``, the
    first after the last; a null ``doc_id`` comes last, and rows alike in ``doc_id`` follow in any order. A null text counts
    as empty, other columns are not read, and no row gives none.

    Texts are dealt out once, compressed, in ranges of ``doc_id``. A task pairs its own neighbours; its last
    row waits for the next task's first one, and these few rows, two for each task, are joined.
    """
    terms = docs.sparkSession.sparkContext.broadcast(lexicon(docs, rare, common))
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = "n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compared(make: Fingerprinter, text: str, own: str, following: str, other: str) -> tuple:
        changed = edit(text, following)
        print_ = own if changed == text else make(changed)
        return len(text), hashlib.sha256(changed.encode()).hexdigest(), own, print_, likeness(own, print_), likeness(own, other)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = [squeeze(text.encode()) for text in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "packed"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, task = Fingerprinter(terms.value), TaskContext.get().partitionId()
        unpack = zstandard.ZstdDecompressor().decompress
        last, ids, rows, ends = None, [], [], []

        def out(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = [pa.array(x) for x in zip(*rows)] if rows else [[]] * 6
            own = pa.array(ids, batch.schema.field(0).type)
            edge = [pa.array([e and e[n] for e in ends], t) for n, t in enumerate((pa.string(), pa.string()))]
            return pa.record_batch([own, *[pa.array(c, t) for c, t in zip(columns, kinds)], pa.array([task] * len(ids), pa.int32()), *edge], ["doc_id", *names, "task", "role", "text"])

        batch = None
        for batch in batches:
            for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = unpack(packed).decode()
                own = make(text)
                if last is None:
                    ids.append(doc_id), ends.append(("first", text)), rows.append((None, None, own, None, None, None))
                else:
                    ids.append(last[0]), ends.append(None), rows.append(compared(make, last[1], last[2], text, own))
                last = doc_id, text, own
            yield out(batch)
            ids, rows, ends = [], [], []
        if last is not None:
            ids, rows, ends = [last[0]], [(None, None, last[2], None, None, None)], [("last", last[1])]
            yield out(batch)

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(terms.value)
        for batch in batches:
            _, *columns = [c.to_pylist() for c in batch.columns]
            rows = [compared(make, *row) for row in zip(*columns)]
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds)]], ["doc_id", *names])

    texts = docs.select("doc_id", text_or_empty().alias("text"))
    dealt = texts.mapInArrow(pack, f"doc_id {kind}, packed binary")
    last_first = F.col("doc_id").desc_nulls_last()
    dealt = dealt.repartitionByRange(shuffle_partitions(docs), last_first).sortWithinPartitions(last_first)
    paired = stored(dealt.mapInArrow(pair, f"doc_id {kind}, {made}, task int, role string, text string"), "neighbours")
    firsts, lasts = paired.where("role = 'first'"), paired.where("role = 'last'")
    # One row for each task, without its text.
    order = Window.orderBy("task")
    turn = firsts.select("task", F.lead("task").over(order).alias("_after"), F.min("task").over(order).alias("_least"))
    turn = turn.select("task", F.coalesce("_after", "_least").alias("following"))
    starts = firsts.select(F.col("task").alias("following"), F.col("text").alias("_text"), F.col("fingerprint").alias("_print"))
    ends = lasts.join(turn, "task").join(starts, "following").select("doc_id", "text", "fingerprint", "_text", "_print")
    ends = ends.mapInArrow(join_ends, f"doc_id {kind}, {made}")
    return paired.where("role IS NULL").select("doc_id", *names).union(ends)
