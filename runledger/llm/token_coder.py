"""Adaptive range coder for token ids, many blocks in step.

Two contexts, the last id and the last two, each predict the id that followed last time, with a confidence.
Confidences and whether the predictions agree choose the adaptive probabilities that mix the two predictions
with the order-0 one: an adaptive distribution over the ids that a block's frequent ids table holds, and over
classes of all other ids, even within a class. A step of a carry-less range coder tells which prediction
holds, which frequent id it is or which class it is of; for a class, the bits that tell the id in it stand
beside the coded words. Every block starts anew, so any can be read by itself; blocks advance together, one id
of each at a time, as columns of arrays. Arrays are of 32 bits where that is enough, and shares follow the
counts only every so many ids, so that a symbol is looked up rather than searched.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U, U4 = np.uint64, np.uint32
#: Ids of a block at most, and blocks that advance together.
BLOCK, LANES = 4096, 4096
#: Slots of a block's tables of what followed one id and two, as bits, and what ids are multiplied by to find them.
BITS1, BITS2 = 10, 11
MIX1, MIX2 = 2654435761, 2246822519
#: The coder's total, the bits that it emits at once, and the least range that it keeps.
TOTAL_BITS, EMIT = 20, U(32)
LEAST = U(1 << 32)
#: Contexts of what holds, and bounds of the chances in them.
CONTEXTS, LOW, HIGH = 32, 1 / 64, 0.946
#: Classes of ids: those under 16, and each doubling from there.
CLASSES = 13
#: Places of a block's table of frequent ids, each a symbol of order 0 beside the classes; an id has one place.
FREQUENT = 115
SYMBOLS = CLASSES + FREQUENT
#: Shares of symbols are whole numbers of this many bits, one at least, and follow the counts every so many ids.
SHARE_BITS, REFRESH = 10, 128
MAGIC = b"TOK3"
HEADER = struct.Struct("<4sIIII")
#: The number of coded words, before these and the bits of classes.
SPLIT = struct.Struct("<I")


class Damaged(ValueError):
    """A block that is not what was written."""


CLASS = np.array([(n >> 4).bit_length() for n in range(1 << 16)], np.uint8)
FIRST = np.array([0, *[1 << (n + 3) for n in range(1, CLASSES)]], U4)
WIDTH = np.array([4, *range(4, CLASSES + 3)], U4)
BEGIN, BITS = FIRST.astype(np.int64), WIDTH.astype(np.int64)
PLACE = ((np.arange(1 << 16, dtype=np.int64) * 40503 >> 5) % FREQUENT).astype(np.uint8)


class Model:
    """Tables of some blocks, flat, each block with its own part.

    A slot holds the id that followed, and above 16 bits the confidence in it. Slots change with every id;
    shares of what holds, frequent ids and shares of symbols are told by counts and change by :meth:`refresh`.
    """

    def __init__(self, lanes: int) -> None:
        lane = np.arange(lanes)
        self.slots = np.zeros(lanes * ((1 << BITS1) + (1 << BITS2)), U4)
        self.base = np.stack((lane << BITS1, (lanes << BITS1) + (lane << BITS2)))
        # Of each context: how often neither held, the prediction of one id and that of two.
        self.held = np.tile(np.array([5.25, 0.75, 2.0]), (lanes * CONTEXTS, 1))
        self.counts = np.full((lanes, SYMBOLS), 8, np.int32)
        self.frequent, self.sure = np.zeros(lanes * FREQUENT, U4), np.zeros(lanes * FREQUENT, np.int32)
        self.row, self.context_row = lane * SYMBOLS, lane * CONTEXTS

    def refresh(self, n: int) -> None:
        """Shares by the counts so far, of the first n blocks."""
        self.n = n
        rest, held1, held2 = self.held[: n * CONTEXTS].T
        chance2 = np.clip(held2 / (rest + held1 + held2), LOW, HIGH)
        chance1 = np.clip(held1 / (rest + held1), LOW, HIGH) * (1 - chance2)
        chance1[1::2] = 0  # where the predictions agree
        total = 1 << TOTAL_BITS
        self.share2s = (chance2 * total).astype(U4)
        self.others_of = self.share2s + (chance1 * total).astype(U4)
        sums = np.cumsum(self.counts[:n], axis=1)
        ends = (sums * (((1 << SHARE_BITS) - SYMBOLS) / sums[:, -1:])).astype(U4)
        ends += np.arange(1, SYMBOLS + 1, dtype=U4)
        ends[:, -1] = 1 << SHARE_BITS
        self.widths = np.diff(ends, axis=1, prepend=U4(0))
        self.begins, self.ends = (ends - self.widths).reshape(-1), ends.reshape(-1)

    def count(self, ids: np.ndarray, contexts: np.ndarray, is1: np.ndarray, is2: np.ndarray, symbols: np.ndarray) -> None:
        """Count what held, symbols and frequent ids of some steps, each an array's row; early counts weigh less.

        ``symbols`` are SYMBOLS where a prediction held.
        """
        n = ids.shape[1]
        lane = np.arange(n)
        kinds = np.bincount(((contexts << 2) + (is1 + (is2 << np.uint8(1)))).reshape(-1), minlength=n * CONTEXTS * 4)
        held = self.held[: n * CONTEXTS]
        held *= 0.75
        held += kinds.reshape(-1, 4)[:, :3]
        found = np.bincount((symbols + lane * (SYMBOLS + 1)).reshape(-1), minlength=n * (SYMBOLS + 1)).reshape(n, -1)
        counts = self.counts[:n]
        counts -= counts >> 3
        counts += 24 * found[:, :SYMBOLS].astype(np.int32)
        # An id that comes again gets surer of its place; the last other one takes the place when that is used up.
        rare = np.flatnonzero(symbols < CLASSES)
        own = ids.reshape(-1)[rare]
        place = rare % n * FREQUENT + PLACE[own]
        last = np.zeros(n * FREQUENT, U4)
        last[place] = own
        sure = np.minimum(self.sure[: n * FREQUENT] + 2 * found[:, CLASSES:SYMBOLS].reshape(-1), 15) - np.bincount(place, minlength=n * FREQUENT)
        self.frequent[: n * FREQUENT] = np.where(sure < 0, last, self.frequent[: n * FREQUENT])
        self.sure[: n * FREQUENT] = np.maximum(sure, 0)

    def predict(self, at: np.ndarray, contexts: np.ndarray) -> None:
        """Predictions of the blocks from the slots ``at``, and their shares of the total."""
        self.at, self.slot = at, self.slots[at]
        self.guess = self.slot & 0xFFFF
        sure = self.slot >> 16
        agree = self.guess[0] == self.guess[1]
        np.add(sure[1] << 3 | sure[0] << 1 | agree, self.context_row[: self.n], out=contexts)
        self.share2, self.others = self.share2s[contexts], self.others_of[contexts]
        self.rest = (1 << TOTAL_BITS) - self.others

    def shares(self, begins: np.ndarray, ends: np.ndarray, is1: np.ndarray, is2: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where what holds begins in the total, and its share of that; the symbol's place in order 0 is given."""
        begin = self.rest * begins >> SHARE_BITS
        share = (self.rest * ends >> SHARE_BITS) - begin
        start = (self.others + begin) * rest + self.share2 * is1
        return start, share * rest + (self.others - self.share2) * is1 + self.share2 * is2

    def learn(self, ids: np.ndarray) -> None:
        slot, guess = self.slot, self.guess
        surer = np.minimum(slot + 0x10000, guess | 0x30000)
        less = np.where(slot >= 0x10000, slot >> 17 << 16 | guess, ids)
        self.slots[self.at] = np.where(guess == ids, surer, less)


class Range:
    """Low ends and widths of the ranges of some blocks."""

    def __init__(self, lanes: int) -> None:
        self.low, self.range = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)

    def settle(self, n: int, shift) -> None:
        """Move settled bits of the first n blocks out; ``shift`` is told whose, and their low ends."""
        where = np.flatnonzero(self.range[:n] < LEAST)
        if len(where):
            low = self.low[where]
            # A range that straddles a bound is cut short of it.
            self.range[where] = np.minimum(self.range[where], LEAST - (low & (LEAST - U(1)))) << EMIT
            shift(where, low)
            self.low[where] = low << EMIT


def segments(sizes: list[int]) -> list[tuple[int, int, int]]:
    """Steps from and to between changes of shares, and how many blocks advance, the sizes descending; a block goes on to their end."""
    out, begin = [], 0
    while begin < sizes[0]:
        end = begin + min(REFRESH, max(32, begin))
        out.append((begin, end, int(np.searchsorted(-np.array(sizes), -begin, "left"))))
        begin = end
    return out


def class_bits(ids: np.ndarray, symbols: np.ndarray) -> list[bytes]:
    """Of each block, a column, the bits that tell ids in their classes, in whole 16-bit words."""
    out = []
    for low in range(0, ids.shape[1], 64):
        own, kinds = np.ascontiguousarray(ids[:, low : low + 64].T), np.ascontiguousarray(symbols[:, low : low + 64].T)
        rare = kinds < CLASSES
        each = np.count_nonzero(rare, axis=1)
        classes = kinds[rare]
        width = BITS[classes]
        ends = np.cumsum(width)
        after = np.append(0, ends)[np.append(0, np.cumsum(each))]
        words = (np.diff(after) + 15 >> 4) + 1
        first = np.append(0, np.cumsum(words))
        begin = ends - width + np.repeat(first[:-1] * 16 - after[:-1], each)
        value = (own[rare] - BEGIN[classes]) << (32 - (begin & 15) - width)
        word = begin >> 4
        flat = np.bincount(word, value >> 16, first[-1]) + np.bincount(word + 1, value & 0xFFFF, first[-1])
        flat = flat.astype("<u2").tobytes()
        out += [flat[2 * a : 2 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    return out


def encode_lanes(blocks: list[np.ndarray]) -> list[bytes]:
    """Coded words and bits of classes of each block; blocks come by descending length."""
    lanes, parts = len(blocks), segments(list(map(len, blocks)))
    ids = np.zeros((parts[-1][1], lanes), np.uint16)
    for lane, block in enumerate(blocks):
        ids[: len(block), lane] = block
    model, coder = Model(lanes), Range(lanes)
    words, filled = np.zeros((lanes, len(ids) // 4 + 64), "<u4"), np.zeros(lanes, np.int64)
    every = np.full(ids.shape, SYMBOLS, np.uint8)

    def shift(where: np.ndarray, low: np.ndarray) -> None:
        nonlocal words
        at = filled[where]
        if at.max() == words.shape[1]:
            words = np.concatenate((words, np.zeros_like(words)), axis=1)
        words[where, at] = low >> EMIT
        filled[where] = at + 1

    key2 = np.zeros((1, lanes), U4)
    for begin, end, n in parts:
        model.refresh(n)
        part = ids[begin:end, :n].astype(U4)
        place = PLACE[part]
        often = model.frequent[place + np.arange(n) * FREQUENT] == part
        symbols = np.where(often, place + np.uint8(CLASSES), CLASS[part])
        at = symbols + model.row[:n]
        begins, ends = model.begins[at], model.ends[at]
        # Slots by the last id and the last two before each step.
        ats = np.empty((end - begin, 2, n), np.int64)
        last = np.concatenate((ids[max(0, begin - 1) : begin, :n].astype(U4) if begin else key2[:, :n], part[:-1]))
        key1 = last * MIX1
        ats[:, 0] = (key1 >> (32 - BITS1)) + model.base[0, :n]
        key2 = np.concatenate((key2[:, :n], last * MIX2))
        ats[:, 1] = (key1 + key2[:-1] >> (32 - BITS2)) + model.base[1, :n]
        key2 = key2[-1:]
        contexts, is1, is2 = np.empty(part.shape, np.int64), np.empty(part.shape, bool), np.empty(part.shape, bool)
        low, width = coder.low[:n], coder.range[:n]
        for step, now in enumerate(part):
            model.predict(ats[step], contexts[step])
            by2 = np.equal(model.guess[1], now, out=is2[step])
            by1 = np.greater(model.guess[0] == now, by2, out=is1[step])
            start, share = model.shares(begins[step], ends[step], by1, by2, ~(by1 | by2))
            unit = width >> U(TOTAL_BITS)
            low += start * unit
            np.multiply(share, unit, out=width)
            coder.settle(n, shift)
            model.learn(now)
        symbols[is1 | is2] = SYMBOLS
        model.count(part, contexts, is1, is2, symbols)
        every[begin:end, :n] = symbols
    for _ in range(2):
        shift(np.arange(lanes), coder.low)
        coder.low = coder.low << EMIT
    bits = class_bits(ids, every)
    return [SPLIT.pack(filled[lane]) + words[lane, : filled[lane]].tobytes() + bits[lane] for lane in range(lanes)]


def decode_lanes(coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """Ids of each block; blocks come by descending length."""
    lanes, parts = len(coded), segments(sizes)
    cuts = [SPLIT.size + 4 * SPLIT.unpack_from(block)[0] for block in coded]
    most = max(cuts) // 4 + 2
    # Bits of classes, as 32 from each 16th on.
    bits_most = max(len(block) - cut for block, cut in zip(coded, cuts)) // 2 + 2
    words, bits = np.zeros((lanes, most), "<u4"), np.zeros((lanes, bits_most), U4)
    for lane, (block, cut) in enumerate(zip(coded, cuts)):
        words[lane, : cut // 4 - 1] = np.frombuffer(block, "<u4", cut // 4 - 1, SPLIT.size)
        bits[lane, : (len(block) - cut) // 2] = np.frombuffer(block, "<u2", -1, cut)
    bits <<= U4(16)
    bits[:, :-1] |= bits[:, 1:] >> U4(16)
    words, read, bits, bit = words.reshape(-1), np.arange(lanes) * most + 2, bits.reshape(-1), np.arange(lanes) * (bits_most * 16)
    model, coder = Model(lanes), Range(lanes)
    # Of the code what lies above the low end.
    code = words[read - 2].astype(U) << EMIT | words[read - 1]

    def shift(where: np.ndarray, _: np.ndarray) -> None:
        at = read[where]
        code[where] = code[where] << EMIT | words[at]
        read[where] = at + 1

    ids = np.zeros((parts[-1][1], lanes), np.uint16)
    now, key2 = np.zeros(lanes, U4), np.zeros(lanes, U4)
    id_of = np.empty((lanes, SYMBOLS), U4)
    id_of[:, :CLASSES] = FIRST
    for begin, end, n in parts:
        model.refresh(n)
        id_of[:n, CLASSES:] = model.frequent[: n * FREQUENT].reshape(n, -1)
        own = id_of[:n].reshape(-1)
        symbol_at = np.repeat(np.tile(np.arange(SYMBOLS, dtype=np.uint8), n), model.widths.reshape(-1).astype(np.int64))
        table_row = np.arange(n) << SHARE_BITS
        shape = (end - begin, n)
        contexts, is1, is2, symbols = np.empty(shape, np.int64), np.empty(shape, bool), np.empty(shape, bool), np.empty(shape, np.uint8)
        low, width, row, off, base, at = coder.low[:n], coder.range[:n], model.row[:n], code[:n], model.base[:, :n], np.empty((2, n), np.int64)
        now, key2 = now[:n], key2[:n]
        for step in range(end - begin):
            key1 = now * MIX1
            np.add(key1 >> (32 - BITS1), base[0], out=at[0])
            np.add(key1 + key2 >> (32 - BITS2), base[1], out=at[1])
            key2 = now * MIX2
            model.predict(at, contexts[step])
            unit = width >> U(TOTAL_BITS)
            value = (off // unit).astype(U4)
            by2 = np.less(value, model.share2, out=is2[step])
            rest = value >= model.others
            by1 = np.equal(by2, rest, out=is1[step])
            # The last symbol that begins at or before the value.
            wanted = (((value - model.others) * rest << SHARE_BITS) + ((1 << SHARE_BITS) - 1)) / model.rest
            symbol = symbols[step]
            symbol[:] = symbol_at[wanted.astype(np.int64) + table_row]
            place = symbol + row
            start, share = model.shares(model.begins[place], model.ends[place], by1, by2, rest)
            begins = start * unit
            low += begins
            off -= begins
            np.multiply(share, unit, out=width)
            coder.settle(n, shift)
            now = own[place]
            rare = np.flatnonzero((symbol < CLASSES) & rest)
            if len(rare):
                wide, from_ = WIDTH[symbol[rare]], bit[rare]
                now[rare] += bits[from_ >> 4] << (from_ & 15).astype(U4) >> (32 - wide)
                bit[rare] = from_ + wide
            now = now * rest + model.guess[0] * by1 + model.guess[1] * by2
            ids[begin + step, :n] = now
            model.learn(now)
        symbols[is1 | is2] = SYMBOLS
        model.count(ids[begin:end, :n], contexts, is1, is2, symbols)
    return [ids[: sizes[lane], lane].astype(np.int64) for lane in range(lanes)]


def by_length(sizes: list[int]) -> list[list[int]]:
    """Places of blocks, by descending length, in groups that advance together."""
    order = sorted((n for n in range(len(sizes)) if sizes[n]), key=lambda n: -sizes[n])
    return [order[low : low + LANES] for low in range(0, len(order), LANES)]


def pack(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block with its header: magic, number of ids, CRC-32 of them, of the coded words, and those words' bytes."""
    coded = [b""] * len(blocks)
    for group in by_length(list(map(len, blocks))):
        for place, words in zip(group, encode_lanes([blocks[n] for n in group])):
            coded[place] = words
    return [
        HEADER.pack(MAGIC, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(words, len(ids)), len(words)) + words
        for ids, words in zip(blocks, coded)
    ]


def unpack(packed: list[bytes]) -> list[np.ndarray]:
    """The blocks' ids; raises Damaged if a checksum or a length does not hold."""
    heads = []
    for data in packed:
        if len(data) < HEADER.size:
            raise Damaged("a block shorter than its header")
        magic, size, check, coded_check, length = HEADER.unpack_from(data)
        if magic != MAGIC or len(data) != HEADER.size + length or zlib.crc32(data[HEADER.size :], size) != coded_check:
            raise Damaged("a block that was changed")
        heads.append((size, check))
    out = [np.zeros(0, np.int64)] * len(packed)
    for group in by_length([size for size, _ in heads]):
        for place, ids in zip(group, decode_lanes([packed[n][HEADER.size :] for n in group], [heads[n][0] for n in group])):
            out[place] = ids
    for ids, (_, check) in zip(out, heads):
        if zlib.crc32(ids.astype("<u4").tobytes()) != check:
            raise Damaged("ids that do not match their checksum")
    return out
