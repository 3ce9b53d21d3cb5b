"""Byte-level BPE by a rank queue: encoding to ids and decoding.

Merging always takes the pair of the lowest rank, the leftmost of such pairs first. Pairs wait in one
bucket for each rank, as positions in a linked list of tokens. A hierarchical bitmap marks the buckets
in use, so that the lowest rank is found by three find-first-set steps whatever the length. A merge
changes the pairs beside it and leaves their old entries where they are; an entry that does not match
its position's rank any more is skipped. Long pre-tokens are merged one by one that way; the many short
ones of a batch lie end to end in one list, and a bucket's pairs, the leftmost of each pre-token, are
merged at once.

Texts reach the merging as chunks: a space that follows something other than white space always begins
a new match of the pattern, so texts are cut there, and a chunk met before is looked up.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import kept, text_or_empty

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Pre-tokens of more bytes are merged on their own; fewer of them in a batch, too.
LONG, FEW = 64, 200
#: Chunks that a Python worker remembers; the memory starts anew beyond, which costs time only.
REMEMBERED = 400_000
#: Code points of a section of a text, and of the sections looked up together, about.
SECTION, GROUP = 1 << 18, 1 << 21

Ranks = dict[bytes, int]


class RankQueue:
    """The ranks in use, as bits in three levels of 64-bit words."""

    def __init__(self) -> None:
        self.low, self.middle, self.top = [0] * 4096, [0] * 64, 0

    def add(self, rank: int) -> None:
        word, group = rank >> 6, rank >> 12
        self.low[word] |= 1 << (rank & 63)
        self.middle[group] |= 1 << (word & 63)
        self.top |= 1 << group

    def first(self) -> int:
        """The lowest rank in use, -1 if none is."""
        if not self.top:
            return -1
        group = (self.top & -self.top).bit_length() - 1
        bits = self.middle[group]
        word = group << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        return word << 6 | (bits & -bits).bit_length() - 1

    def remove(self, rank: int) -> None:
        word, group = rank >> 6, rank >> 12
        self.low[word] &= ~(1 << (rank & 63))
        if not self.low[word]:
            self.middle[group] &= ~(1 << (word & 63))
            if not self.middle[group]:
                self.top &= ~(1 << group)


def merge_long(piece: bytes, ranks: Ranks) -> list[int]:
    """Ids of one pre-token of any length."""
    n = len(piece)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    queue, buckets, rank_at = RankQueue(), {}, [-1] * (n + 1)

    def push(at: int) -> None:
        end = after[at]
        rank = ranks.get(piece[at : after[end]], -1) if end < n else -1
        rank_at[at] = rank
        if rank >= 0:
            bucket = buckets.get(rank)
            if bucket is None:
                bucket = buckets[rank] = []
                queue.add(rank)
            heappush(bucket, at)

    for i in range(n - 1):
        push(i)
    while (rank := queue.first()) >= 0:
        bucket = buckets[rank]
        at = heappop(bucket)
        if not bucket:
            del buckets[rank]
            queue.remove(rank)
        if rank_at[at] != rank:
            continue
        gone = after[at]
        rank_at[gone] = -1
        after[at] = after[gone]
        if after[at] <= n:
            before[after[at]] = at
        push(at)
        if before[at] >= 0:
            push(before[at])
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class Pairs:
    """Rank by two neighbouring ids, for arrays of them."""

    def __init__(self, ranks: Ranks) -> None:
        found = [
            (left << 20 | right, rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        ]
        table = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.keys, self.ranks = np.append(table[:, 0], 1 << 62), np.append(table[:, 1], -1).astype(np.int32)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 20 | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.ranks[at], -1)


def merge_many(pieces: list[bytes], pairs: Pairs) -> list[bytes]:
    """Ids of each pre-token, as little-endian 32-bit numbers."""
    none = (1 << 20) - 1  # stands between pre-tokens and pairs with nothing
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    total = int(sizes.sum()) + len(pieces) + 1
    ends = np.cumsum(sizes + 1)
    ids = np.full(total, none, np.int64)
    inside = np.ones(total, bool)
    inside[0] = inside[ends] = False
    ids[inside] = pairs.single[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces) + 1), np.append(1, sizes + 1))
    after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
    rank_at = np.full(total, -1, np.int32)
    rank_at[:-1] = pairs(ids[:-1], ids[1:])
    queue, buckets = RankQueue(), {}

    def push(places: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        starts = np.flatnonzero(np.diff(ranks, prepend=-1))
        for rank, low, high in zip(ranks[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(ranks)]):
            if rank in buckets:
                buckets[rank].append(places[low:high])
            else:
                buckets[rank] = [places[low:high]]
                queue.add(rank)

    waiting = np.flatnonzero(rank_at >= 0)
    push(waiting, rank_at[waiting])
    while (rank := queue.first()) >= 0:
        held = buckets.pop(rank)
        queue.remove(rank)
        places = held[0] if len(held) == 1 else np.concatenate(held)
        places = places[rank_at[places] == rank]
        if not len(places):
            continue
        if len(places) > 1:
            if len(held) > 1:
                places = np.unique(places)
            leftmost = np.diff(owner[places], prepend=-1) > 0
            if not leftmost.all():
                buckets[rank] = [places[~leftmost]]
                queue.add(rank)
                places = places[leftmost]
        gone = after[places]
        behind = after[gone]
        ids[places] = rank
        rank_at[gone], ids[gone] = -1, -1
        after[places], before[behind] = behind, places
        ahead = before[places]
        changed = np.concatenate((places, ahead))
        ranks = pairs(np.concatenate((ids[places], ids[ahead])), np.concatenate((ids[behind], ids[places])))
        rank_at[changed] = ranks
        some = ranks >= 0
        if some.any():
            push(changed[some], ranks[some])
    left = (ids >= 0) & (ids != none)
    cuts = np.append(0, np.cumsum(np.bincount(owner[left], minlength=len(pieces) + 1)[1:])) * 4
    flat = ids[left].astype("<u4").tobytes()
    return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


class Encoder:
    """Whole texts to ids; remembers chunks from batch to batch."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, "rb") as file:
            self.ranks: Ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.pairs = Pairs(self.ranks)
        self.pattern = regex.compile(pattern)
        self.known: dict[str | tuple[str], bytes] = {}

    def encode_pieces(self, pieces: Iterable[bytes]) -> dict[bytes, bytes]:
        out, short = {}, []
        for piece in pieces:
            rank = self.ranks.get(piece)
            if rank is not None:
                out[piece] = rank.to_bytes(4, "little")
            elif len(piece) <= LONG:
                short.append(piece)
            else:
                out[piece] = np.array(merge_long(piece, self.ranks), "<u4").tobytes()
        if len(short) >= FEW:
            out |= zip(short, merge_many(short, self.pairs))
        else:
            out |= {p: np.array(merge_long(p, self.ranks), "<u4").tobytes() for p in short}
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        matches = [[m.encode() for m in self.pattern.findall(chunk)] for chunk in chunks]
        ids = self.encode_pieces({m for found in matches for m in found})
        return [b"".join([ids[m] for m in found]) for found in matches]

    def __call__(self, texts: list[str]) -> list[bytes]:
        return encode_texts(texts, self.known, self.encode_chunks)


ODD_SPACE = re.compile(r"\s ")
CUT = regex.compile(r"(?<=\S) ")


def chunks_of(section: str) -> list[str]:
    """Chunks of a section, the first as it is, the others without the space that each begins with."""
    return CUT.split(section) if ODD_SPACE.search(section) else section.split(" ")


def sections_of(text: str) -> Iterator[str]:
    """A text in sections of some length, cut where a chunk begins."""
    low = 0
    while len(text) - low > SECTION:
        cut = CUT.search(text, low + SECTION)
        if cut is None:
            break
        yield text[low : cut.start()]
        low = cut.start()
    yield text[low:] if low else text


def encode_texts(texts: list[str], known: dict[str | tuple[str], bytes], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """Ids of each text, from what is ``known`` of its chunks; ``encode`` makes those of new chunks.

    In ``known`` a text's first chunk stands in a tuple, and any other without the space that it begins with.
    """
    if len(known) > REMEMBERED:
        known.clear()
    out = [[] for _ in texts]
    group, size = [], 0

    def look_up() -> None:
        first, rest = set(), set()
        for _, section in group:
            chunks = chunks_of(section)
            first.add(chunks[0])
            rest.update(chunks[1:])
        heads = {c: known.get((c,)) for c in first}
        tails = [c for c in rest if c not in known]
        new = [c for c, ids in heads.items() if ids is None]
        made = encode([*new, *[" " + c for c in tails]])
        heads |= zip(new, made)
        known.update(zip(zip(new), made))
        known.update(zip(tails, made[len(new) :]))
        find = known.__getitem__
        for n, section in group:
            chunks = chunks_of(section)
            out[n].append(heads[chunks[0]])
            out[n].append(b"".join(map(find, chunks[1:])))
        for c in [c for c in tails if len(c) > LONG]:
            del known[c]
        for c in [c for c in new if len(c) > LONG]:
            del known[(c,)]

    for n, text in enumerate(texts):
        for section in sections_of(text):
            group.append((n, section))
            size += len(section)
            if size >= GROUP:
                look_up()
                group, size = [], 0
    if group:
        look_up()
    return [b"".join(parts) for parts in out]


def encoder(path: str) -> Encoder:
    return kept(("bpe", path), lambda: Encoder(path))


@lru_cache(maxsize=1)
def tokens(path: str) -> list[bytes]:
    """The bytes of each id."""
    return [token for token, _ in sorted(encoder(path).ranks.items(), key=lambda x: x[1])]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that what is made of them stays small."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, ids``, the ids as little-endian unsigned 32-bit numbers.

    Reads ``doc_id`` and ``text``; a null text counts as empty and has no ids. Texts are encoded whole,
    each match of the pattern on its own, without special tokens. ``path`` is a vocabulary file of ranks
    that each executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            ids = encoder(path)(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Add ``decoded``, the bytes that the ids of :func:`encode` stand for, to ``doc_id, ids``; null for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte = tokens(path).__getitem__
        for batch in slices(batches):
            made = [
                None if ids is None else b"".join(map(byte, np.frombuffer(ids, "<u4").tolist()))
                for ids in batch.column(1).to_pylist()
            ]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", F.col("ids")).mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def encode_and_decode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids, decoded``: :func:`encode` and :func:`decode` in one Python worker rather than two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte = tokens(path).__getitem__
        for batch in slices(batches, 1000):
            ids = encoder(path)(batch.column(1).to_pylist())
            made = [b"".join(map(byte, np.frombuffer(x, "<u4").tolist())) for x in ids]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary()), pa.array(made, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")
