"""Documents whose sets of word n-grams are alike, by universe partitions and the pigeonhole principle.

Two sets link when 4 * |x & y| >= 3 * |x | y|. A link's symmetric difference is then at most a third of the
smaller set. Sets are put into bands of size such that a link spans one band or two neighbouring ones. For
each band the universe of n-grams is hashed into m segments, more than that difference can reach: in at least
m - difference segments the two sets have the same subset. So each set publishes a hash of its subset of
each segment, and every link meets in one of them.

What many sets publish is not worth looking up. A subset that is empty, or that more than a limit of sets
publish, is skipped by all of them, and each set keeps account: as long as the segments left outnumber the
difference, none of its links can be lost. Sets whose account falls short publish again, among
themselves, subsets and all their one-deletion neighbours. A segment then bears one difference more, if
what it publishes is rare, which is the cheaper the rarer. The few sets that even then fall short, mostly
members of large groups of near copies, use segments so fine that each holds one n-gram. Of these a link
spoils no more than a quarter, so it is enough that each set looks up the rarest of its own, one more than
that: edits of a text are rare, and copies that have drifted too far apart no longer meet.

Sets that meet are verified exactly. Only one link of each set is looked at first, to its smallest partner or
to the most central set that it meets; sets that are in one component then need no further look. All pairs that meet and are
in different components are verified after that, so no link that joins components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.bpe import slices
from runledger.llm.common import counted_side, text_or_empty
from runledger.llm.components import connected
from runledger.session import stored

#: Words of an n-gram, and the least share of a union, in percent; bands and differences follow from the latter.
WORDS, PERCENT = 5, 75
#: A subset that more sets publish is skipped, at first and among those that publish again.
LIMIT = 32
#: Words that a Python worker remembers.
HELD = 400_000
#: The low bits of a set's key: it publishes as the larger of a pair, an account, a one-deletion neighbour.
LARGER, ACCOUNT, DELETED, FLAGS = 1, 2, 4, 7
MARK = -1  # in place of a key: others have skipped this subset

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


FACTORS = mix(np.arange(1, WORDS + 2, dtype=U)) | U(1)


def shingles(text: str, words: Words) -> np.ndarray:
    """Sorted hashes of the distinct n-grams; of fewer words, that of all of them.

    Encoded texts are lower-cased A-Z only, and split at ASCII white space only.
    """
    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, U)
    hashes = np.fromiter(map(words.__getitem__, parts), U, len(parts))
    if len(parts) < WORDS:
        hashes = np.append(hashes, U(len(parts)))
        return mix(np.add.reduce(hashes * np.append(FACTORS[: len(parts)], FACTORS[WORDS]), keepdims=True))
    n = len(parts) - WORDS + 1
    total = hashes[:n] * FACTORS[0]
    for k in range(1, WORDS):
        total += hashes[k : n + k] * FACTORS[k]
    return np.unique(mix(total))


def key_of(found: np.ndarray) -> int:
    """A set's key, 61 bits of its hash; the low bits are left for flags."""
    return (xxhash.xxh3_64_intdigest(found.tobytes()) >> 4) << 3


@lru_cache
def bands(largest: int = 1 << 40) -> list[int]:
    """Least size of each band, from 3 on: sets of one or two n-grams link with equal sets only."""
    out = [3, 4]
    while out[-1] < largest:
        out.append(4 * (out[-1] - 1) // 3 + 1)
    return out


def plan(band: int) -> tuple[int, int]:
    """Largest size of the smaller set in a band, and the number of segments."""
    most = bands()[band + 1] - 1
    return most, int(1.12 * (most // 3 + 1)) + 3


def bare(x: np.ndarray) -> np.ndarray:
    return x & ~np.int64(FLAGS)


class Publisher:
    """Collects what sets publish: signs, hashes of a subset in its segment, with the set's key.

    With ``deletions`` also those of a subset without one member. A sign's place is its segment, with a low
    bit for subsets of one.
    """

    def __init__(self, deletions: bool = False) -> None:
        self.deletions = deletions
        self.signs, self.keys, self.places, self.accounts = [], [], [], []

    def add(self, key: int, found: np.ndarray) -> None:
        """What a set publishes in the band of its size and, as the larger of a pair, in the one below."""
        if len(found) > 2:
            band = int(np.searchsorted(bands(), len(found), "right")) - 1
            self.publish(key, found, band)
            if band:
                self.publish(key | LARGER, found, band - 1)

    def publish(self, key: int, found: np.ndarray, band: int) -> None:
        most, m = plan(band)
        difference = min(len(found), most) // 3
        salt, other = (U((2 * band + n) * 0x9E3779B97F4A7C15 & (2**64 - 1)) for n in (1, 2))
        scrambled = mix(found ^ salt)
        segment = (scrambled >> U(32)) * U(m) >> U(32)
        segment = segment.astype(np.uint16 if m < 1 << 16 else np.int64)
        order = np.argsort(segment, kind="stable")
        segment, value = segment[order], mix(scrambled[order] + salt)
        starts = np.flatnonzero(np.diff(segment.astype(np.int64), prepend=-1))
        used, size = segment[starts].astype(np.int64), np.diff(np.append(starts, len(segment)))
        sums, spot = np.add.reduceat(value, starts), mix(used.view(U) + other)
        signs, keys, places = [mix(sums + spot)], [key] * len(used), [used * 2 + (size == 1)]
        balance = len(used) - difference - 1
        if self.deletions:
            several = np.repeat(size > 1, size)
            at = np.repeat(np.arange(len(used)), size)[several]
            signs.append(mix(sums[at] - value[several] + spot[at]))
            keys += [key | DELETED] * len(at)
            places.append(used[at] * 2)
            balance += int((size > 1).sum())
        self.signs.append(np.concatenate(signs).view(np.int64))
        self.keys.append(np.array(keys, np.int64))
        self.places.append(np.concatenate(places))
        self.accounts.append((key, balance))

    def rows(self, limit: int) -> pa.RecordBatch:
        """All that was published, and each set's account; signs too frequent already are skipped here.

        A skipped sign leaves a mark, for what others publish. An account's sign spreads the rows, and its
        place holds the balance.
        """
        empty = [np.zeros(0, np.int64)]
        signs, keys, places = (np.concatenate(x or empty) for x in (self.signs, self.keys, self.places))
        owners = np.array([key for key, _ in self.accounts], np.int64)
        balances = np.array([balance for _, balance in self.accounts], np.int64)
        marks = empty[0]
        if len(signs):
            _, back, count = np.unique(signs, return_inverse=True, return_counts=True)
            often = count[back] > limit
            if often.any():
                owner = np.repeat(np.arange(len(owners)), list(map(len, self.signs)))[often]
                at, lost = lost_of(owner, keys[often], places[often], self.deletions)
                balances[at] -= lost
                marks = np.unique(signs[often])
                signs, keys, places = signs[~often], keys[~often], places[~often]
        spread = mix(owners.view(U)).view(np.int64)
        columns = (
            np.concatenate((signs, marks, spread)),
            np.concatenate((keys, np.full(len(marks), MARK), owners | ACCOUNT)),
            np.concatenate((places, np.zeros(len(marks), np.int64), balances)).astype(np.int32),
        )
        return pa.record_batch(list(map(pa.array, columns)), ["sign", "key", "place"])


def lost_of(owner: np.ndarray, keys: np.ndarray, places: np.ndarray, deletions: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each owner and what skipped signs cost it: a segment's whole weight, or the second half of it."""
    if not deletions:
        return np.unique(owner, return_counts=True)
    cost = np.where(keys & DELETED > 0, 1, 2 - places % 2)
    order = np.lexsort((cost, places // 2, owner))
    owner, segment, cost = owner[order], places[order] // 2, cost[order]
    last = np.append((owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1]), True)[: len(owner)]
    each, back = np.unique(owner[last], return_inverse=True)
    return each, np.bincount(back, cost[last], len(each)).astype(np.int64)


MET = "kind byte, key long, other long, n int"
PAIR, BALANCE, LOST = 0, 1, 2


def meet(published: DataFrame, limit: int, deletions: bool = False) -> DataFrame:
    """Who meets where, as rows of a ``kind``.

    ``BALANCE`` and ``LOST`` tell of a ``key`` what its account holds and what skipped signs cost it. ``PAIR``
    rows have the two keys that share a sign, as many as the limit for each row at most. Signs are dealt
    out by themselves; none brings more rows than the limit times the tasks that published it, however
    frequent it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        sign, key, place = (np.concatenate(x) for x in zip(*parts))
        del parts
        account = (key & ACCOUNT > 0) & (key != MARK)
        yield met(BALANCE, key[account] & ~np.int64(ACCOUNT), n=place[account])
        sign, key, place = sign[~account], key[~account], place[~account]
        # Signs that stand alone are almost all of them.
        order = np.argsort(sign)
        same = sign[order][1:] == sign[order][:-1]
        shared = order[np.append(same, False) | np.append(False, same)] if len(order) else order
        sign, key, place = sign[shared], key[shared], place[shared]
        order = np.lexsort((key, sign))
        sign, key, place = sign[order], key[order], place[order]
        fresh = np.append(True, (sign[1:] != sign[:-1]) | (key[1:] != key[:-1]))[: len(sign)]
        sign, key, place = sign[fresh], key[fresh], place[fresh]
        if not len(sign):
            return
        starts = np.flatnonzero(np.append(True, sign[1:] != sign[:-1]))
        size = np.diff(np.append(starts, len(sign)))
        marked = np.logical_or.reduceat(key == MARK, starts)
        skipped = np.repeat(marked | (size > limit), size)
        gone = skipped & (key != MARK)
        owner, lost = lost_of(key[gone] & ~np.int64(DELETED), key[gone], place[gone], deletions)
        yield met(LOST, owner, n=lost)
        sign, key = sign[~skipped], key[~skipped]
        for apart in range(1, limit):
            at = np.flatnonzero(sign[apart:] == sign[:-apart])
            if not len(at):
                break
            one, two = key[at], key[at + apart]
            # Two that both publish as the larger meet in their own band, too; two deletions are two apart.
            proper = (one & two & (LARGER | DELETED) == 0) & (bare(one) != bare(two))
            yield met(PAIR, one[proper] & ~np.int64(DELETED), other=two[proper] & ~np.int64(DELETED))

    def met(kind: int, key, other=None, n=None) -> pa.RecordBatch:
        zero = np.zeros(len(key), np.int64)
        columns = [np.full(len(key), kind, np.int8), key, zero if other is None else other, (zero if n is None else n).astype(np.int32)]
        return pa.record_batch(list(map(pa.array, columns)), ["kind", "key", "other", "n"])

    return stored(published.repartition("sign").mapInArrow(run, MET), "meetings")


def accounts(met: DataFrame) -> DataFrame:
    """``key, balance``: by how many the segments left outnumber the difference that a link may have, less one."""
    balance = met.where(F.col("kind") == BALANCE).groupBy("key").agg(F.min("n").alias("balance"))
    lost = met.where(F.col("kind") == LOST).groupBy("key").agg(F.sum("n").alias("lost"))
    left = (F.col("balance") - F.coalesce("lost", F.lit(0))).alias("balance")
    return balance.join(lost, "key", "left").select("key", left)


def node(key: str):
    return F.col(key).bitwiseAND(F.lit(~FLAGS))


def short_of(balances: DataFrame) -> DataFrame:
    """Sets whose account falls short."""
    return stored(balances.where("balance < 0").select(node("key").alias("node")).distinct(), "short")


def likely(counted: DataFrame, balances: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of ``key, other, n`` that meet often enough for a link.

    A link differs in fewer segments than either account allows for, so it is met more often than the larger
    balance says. Two sets that both fall short are left to what they publish again.
    """
    more = F.greatest("_one", "_two")
    ones = balances.select("key", F.col("balance").alias("_one"))
    twos = balances.select(F.col("key").alias("other"), F.col("balance").alias("_two"))
    return pair_of(counted.join(ones, "key").join(twos, "other").where((F.col("n") > more) & (more >= 0)))


def pair_of(rows: DataFrame) -> DataFrame:
    one, two = node("key"), node("other")
    return rows.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()


PUBLISHED = "sign long, key long, place int"


def sets_of(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, n_shingles, node`` of each document; the same set has the same node, an empty one none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches):
            found = [shingles(text, words) for text in batch.column(2).to_pylist()]
            sizes, keys = list(map(len, found)), [key_of(f) if len(f) else None for f in found]
            words.clear() if len(words) > HELD else None
            columns = [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())]
            yield pa.record_batch(columns, ["doc_id", "digest", "n_shingles", "node"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("digest"), text_or_empty().alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, digest long, n_shingles long, node long")


def publish_texts(docs: DataFrame, limit: int) -> DataFrame:
    """What the documents publish at first; equal sets of a batch publish once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches):
            out, keys = Publisher(), set()
            for text in batch.column(0).to_pylist():
                found = shingles(text, words)
                if len(found) > 2 and (key := key_of(found)) not in keys:
                    keys.add(key)
                    out.add(key, found)
            words.clear() if len(words) > HELD else None
            yield out.rows(limit)

    return docs.select(text_or_empty().alias("text")).mapInArrow(run, PUBLISHED)


def publish_again(sets: DataFrame, limit: int) -> DataFrame:
    """What stored sets publish with one-deletion neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = Publisher(deletions=True)
            for node_, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out.add(node_, np.frombuffer(found, U))
            yield out.rows(limit)

    return sets.select("node", "found").mapInArrow(run, PUBLISHED)


def rarest(sets: DataFrame) -> DataFrame:
    """``sign, node, size, place, central``: the rarest n-grams of each set that another has, too, with their rank.

    Linked sets share three quarters of either at least. The rarest n-gram that they share is therefore among
    the rarest quarter of each, and one more. A set is the more central the more sets have its n-grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = [np.frombuffer(found, U).view(np.int64) for found in batch.column(1).to_pylist()]
            sizes = np.array(list(map(len, parts)), np.int64)
            columns = [np.concatenate(parts or [sizes]), np.repeat(batch.column(0).to_numpy(), sizes), np.repeat(sizes, sizes).astype(np.int32)]
            yield pa.record_batch(list(map(pa.array, columns)), ["sign", "node", "size"])

    every = stored(sets.select("node", "found").mapInArrow(run, "sign long, node long, size int"), "grams")
    often = every.groupBy("sign").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = Window.partitionBy("node")
    ranked = every.join(often, "sign").select(
        "sign", "node", "size", F.sum("n").over(own).alias("central"),
        # Those that no other set has come first.
        (F.col("size") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("n", "sign"))).alias("place"),
    )
    return stored(ranked.where("place <= floor(size / 4) + 1"), "rarest")


def written_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``node, size, found``: the sets of the documents with these ids, as sorted 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches):
            found = [shingles(text, words) for text in batch.column(0).to_pylist()]
            words.clear() if len(words) > HELD else None
            columns = [pa.array(map(key_of, found), pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())]
            yield pa.record_batch(columns, ["node", "found"])

    chosen = docs.join(counted_side(ids), "doc_id", "left_semi").select(text_or_empty().alias("text"))
    return stored(chosen.mapInArrow(run, "node long, found binary"), "sets")


#: Sets that are compared with one other in one task.
TOGETHER = 2000


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs ``a, b`` that link, compared exactly.

    The set of ``a`` goes once to each TOGETHER of its partners, so that no task holds all partners of one.
    """
    pairs = stored(pairs, "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    dealt = stored(dealt, "pairs")
    heads = dealt.select("a", "part").distinct().select(F.col("a").alias("node"), "a", "part", F.lit(0).alias("role"))
    rows = dealt.select(F.col("b").alias("node"), "a", "part", F.lit(1).alias("role"))
    wanted = stored(heads.union(rows), "pairs")
    joined = sets.join(counted_side(wanted), "node").select("a", "part", "role", "node", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for batch in batches:
            out = []
            for a, role, node, found in zip(*[batch.column(n).to_pylist() for n in (0, 2, 3, 4)]):
                other = np.frombuffer(found, U)
                if role == 0:
                    head, own = a, other
                    continue
                assert head == a, "a set without its head"
                common = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * common >= PERCENT * (len(own) + len(other) - common):
                    out.append((a, node))
            yield pa.record_batch([pa.array([x[n] for x in out], pa.int64()) for n in (0, 1)], ["a", "b"])

    dealt_out = joined.repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return stored(dealt_out.mapInArrow(run, "a long, b long").distinct(), "links")


def link_groups(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id``; see :func:`linked_rows`."""
    return linked_rows(docs, limit).select("doc_id", "n_shingles", "component_id")


def linked_rows(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, digest, n_shingles, component_id, component_digest``.

    Reads ``doc_id`` and ``text``. A text of fewer than five words has one n-gram, all of it; a null text, or
    one without words, has none and is linked with nothing. ``component_id`` is the smallest ``doc_id``
    reachable by links, equal sets being linked. Rows without a ``doc_id`` have no component and link
    nothing; rows alike in ``doc_id`` count one by one and meet in their component's id. ``digest`` is a hash of the
    text, and ``component_digest`` the smallest one of the rows that bear ``component_id``. A key stands for its
    set by 61 bits of a hash, an n-gram by 64.
    """
    texts = docs.select("doc_id", "text")
    known = texts.where(F.col("doc_id").isNotNull())
    members = stored(sets_of(texts), "members")
    named = members.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    ids = named.groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    met = meet(publish_texts(known, limit), limit)
    balances = accounts(met)
    counted = met.where(F.col("kind") == PAIR).groupBy("key", "other").agg(F.count(F.lit(1)).alias("n"))
    pairs = stored(likely(counted, balances), "pairs")
    short = short_of(balances)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(short).distinct()
    sets = written_sets(known, stored(ids.join(needed, "node").select("doc_id"), "needed"))

    again = meet(publish_again(sets.join(counted_side(short), "node", "left_semi"), limit), limit, True)
    pairs = pairs.union(pair_of(again.where(F.col("kind") == PAIR)))
    short = short_of(accounts(again))
    rare = rarest(sets.join(counted_side(short), "node", "left_semi"))

    # One link of each set first: to its smallest partner, and to the central set that it meets most often.
    hubs = rare.groupBy("sign").agg(F.max(F.struct("central", "node"))["node"].alias("a"))
    stars = rare.join(hubs, "sign").where("a <> node").groupBy("a", F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    stars = stars.groupBy("b").agg(F.max(F.struct("n", "a"))["a"].alias("a"))
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).union(stars).select("a", "b").distinct()
    links = verified(first, sets)
    groups = stored(connected(links), "groups")

    # Then what meets across the components so far.
    def placed(rows: DataFrame, by: str, name: str) -> DataFrame:
        parts = groups.select(F.col("node").alias(by), F.col("component").alias(name))
        return rows.join(parts, by, "left").withColumn(name, F.coalesce(name, by))

    across = placed(placed(pairs, "a", "one"), "b", "two").where("one <> two").select("a", "b")
    own = placed(rare.drop("central"), "node", "component")
    mixed = own.groupBy("sign").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    own = stored(own.join(mixed.select("sign"), "sign", "left_semi"), "mixed")
    partner = own.select(
        "sign", F.col("node").alias("b"), F.col("size").alias("_size"), F.col("place").alias("_place"), F.col("component").alias("_other")
    )
    # Links share 3 / 7 of both sizes, so 6 / 7 of the smaller set, and at the rarest shared n-gram that many are left.
    met_there = own.where("place <= floor(size / 7) + 1").join(partner, "sign").where(
        "(size < _size OR size = _size AND node < b) AND component <> _other"
        " AND 7 * (least(size - place, _size - _place) + 1) >= 3 * (size + _size)"
    ).select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
    across = across.union(met_there).distinct()
    groups = stored(connected(links.union(verified(across, sets))), "groups")

    placed_members = members.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = F.min(F.struct("doc_id", "digest"))
    least = placed_members.where(F.col("doc_id").isNotNull()).groupBy("component").agg(first.alias("first"))
    in_groups = placed_members.where(F.col("node").isNotNull()).join(least, "component", "left")
    alone = placed_members.where(F.col("node").isNull()).withColumn("first", F.struct("doc_id", "digest"))
    has_id = F.col("doc_id").isNotNull()
    columns = [
        "doc_id", "digest", "n_shingles", F.when(has_id, F.col("first.doc_id")).alias("component_id"),
        F.when(has_id, F.col("first.digest")).alias("component_digest"),
    ]
    return in_groups.select(*columns).union(alone.select(*columns))


def drop_near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, all columns as they are.

    The first has the smallest ``doc_id``, and of texts that share it the one of the smallest hash. Rows without a
    ``doc_id`` and texts without words stay; rows alike in ``doc_id`` and text are one document and stay or go together.
    """
    first = F.struct(F.col("component_id").alias("doc_id"), F.col("component_digest").alias("digest"))
    gone = linked_rows(docs, limit).where(first < F.struct("doc_id", "digest")).where("n_shingles > 0")
    dropped = stored(gone.select(F.col("doc_id").alias("id"), F.col("digest").alias("hash")).distinct(), "dropped")
    whole = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(text_or_empty()).alias("digest"))
    same = (F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("hash"))
    return whole.join(counted_side(dropped), same, "left_anti").select("row.*")
