"""Token ids of documents in compressed files, in order of ``doc_id``, and back.

Documents are dealt out in ranges of ``doc_id``; a task encodes its range and writes it as one file of
blocks. A block holds whole documents, or a part of one that is longer than a block, as coded by
:mod:`runledger.llm.token_coder`, with a list of what it holds. Blocks are rows of a Parquet table, so
Spark commits a file as a whole, and a task that is run again leaves no half-written one.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runledger.llm import token_coder
from runledger.llm.bpe import LONG, REMEMBERED, SECTION, encode_texts, slices
from runledger.llm.common import kept, shuffle_partitions, text_or_empty
from runledger.session import shared_dir, stored

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Id after each document.
END = 0


#: What a token stands for a space by, and how many chunks the library is given as one text.
SPACE, TOGETHER = "\u0120", 256
#: A space after white space of any kind, in Arrow's spelling.
ODD_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "
#: Bytes of the texts whose chunks are looked up together, about.
GROUP = 1 << 23


class Encoder:
    """The tokenizers library on texts, chunk by chunk: a chunk always begins a match of its own.

    Texts are cut by Arrow, and each chunk of a group is looked up once; those with a space after other white space,
    and very long ones, go by :func:`encode_texts`. The library is given new chunks end to end, as their ids are
    told apart by the tokens that begin with a space.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        #: By chunk without the space that it begins with, or a text's first in a tuple; those of odd texts.
        self.known: dict[str | tuple[str], bytes] = {}
        self.odd: dict[str | tuple[str], bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[n for token, n in vocabulary.items() if token.startswith(SPACE)]] = True

    def encode_each(self, texts: list[str]) -> list[bytes]:
        out = []
        for low in range(0, len(texts), 20_000):
            found = self.tokenizer.encode_batch_fast(texts[low : low + 20_000], add_special_tokens=False)
            out += [np.array(x.ids, "<u4").tobytes() for x in found]
        return out

    def encode_new(self, chunks: list[str | tuple[str]]) -> list[bytes]:
        # White space at a chunk's end would go on in the space of the next.
        plain = [n for n, c in enumerate(chunks) if isinstance(c, str) and c and not c[-1].isspace()]
        made: list[bytes | None] = [None] * len(chunks)
        groups = [plain[low : low + TOGETHER] for low in range(0, len(plain), TOGETHER)]
        for group, ids in zip(groups, self.encode_each([" " + " ".join([chunks[n] for n in group]) for group in groups])):
            starts = np.flatnonzero(self.begins[np.frombuffer(ids, "<u4")]) * 4
            if len(starts) == len(group) and starts[0] == 0:
                cuts = [*starts.tolist(), len(ids)]
                for n, a, b in zip(group, cuts, cuts[1:]):
                    made[n] = ids[a:b]
        other = [n for n, x in enumerate(made) if x is None]
        texts = [c[0] if isinstance(c, tuple) else " " + c for c in [chunks[n] for n in other]]
        for n, ids in zip(other, self.encode_each(texts)):
            made[n] = ids
        return made

    def encode_group(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts without a space after other white space."""
        cut = pc.split_pattern(texts, " ")
        first, chunks = cut.offsets.to_numpy(), cut.flatten()
        coded = chunks.dictionary_encode()
        heads = list(zip(chunks.take(pa.array(first[:-1])).to_pylist()))
        keys = [*coded.dictionary.to_numpy(zero_copy_only=False).tolist(), *dict.fromkeys(heads)]
        number = dict(zip(keys[len(coded.dictionary) :], range(len(coded.dictionary), len(keys))))
        at = coded.indices.to_numpy().astype(np.int64)
        at[first[:-1]] = [number[head] for head in heads]
        ids = list(map(self.known.get, keys))
        used = np.bincount(at, minlength=len(keys)) > 0
        new = [n for n in np.flatnonzero(used).tolist() if ids[n] is None]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for n, made in zip(new, self.encode_new([keys[n] for n in new])):
            ids[n] = made
            if len(made) <= LONG:
                self.known[keys[n]] = made
        ids = [x or b"" for x in ids]
        flat, sizes = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        begins, each = np.cumsum(sizes) - sizes, sizes[at]
        ends = np.cumsum(each)
        out = flat[np.repeat(begins[at] - (ends - each), each) + np.arange(ends[-1])]
        return np.split(out, ends[first[1:-1] - 1])

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
        odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False) | (sizes > SECTION)
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        which = np.flatnonzero(odd)
        for n, ids in zip(which.tolist(), encode_texts(texts.take(pa.array(which)).to_pylist(), self.odd, self.encode_each)):
            out[n] = np.frombuffer(ids, "<u4")
        which = np.flatnonzero(~odd)
        group = np.cumsum(sizes[which]) // GROUP
        for places in np.split(which, np.flatnonzero(np.diff(group)) + 1):
            if len(places):
                for n, ids in zip(places.tolist(), self.encode_group(texts.take(pa.array(places)))):
                    out[n] = ids
        return out


def encoder(path: str) -> Encoder:
    return kept(("tokenizers", path), lambda: Encoder(path))


#: A block's place: its file and number, and the ids before it in the file. Its documents: their number in the
#: file, ``doc_id``, ids here, and ids before these of the same document; whether the document ends here.
def block_type(doc_id: str) -> str:
    parts = f"array<struct<nth: long, doc_id: {doc_id}, n: long, before: long, ends: boolean>>"
    return f"file int, block int, start long, parts {parts}, data binary"


def write(docs: DataFrame, folder: str, path: str = VOCABULARY) -> None:
    """Encode every whole text, append END, and write the files to a new folder.

    Reads ``doc_id`` and ``text``; a null or empty text has END only. Ids have to be below 65,536. A null
    ``doc_id`` comes first; rows alike in ``doc_id`` are written one after the other, in any order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, nth, number, start = TaskContext.get().partitionId(), 0, 0, 0
        parts: list[list[dict]] = [[]]
        ids: list[list[np.ndarray]] = [[]]
        size, types = 0, None

        def flush(count: int) -> pa.RecordBatch:
            nonlocal parts, ids, number, start
            blocks = [np.concatenate(x) for x in ids[:count]]
            sizes = np.cumsum([0, *map(len, blocks)])
            columns = [
                pa.array([file] * count, pa.int32()), pa.array(range(number, number + count), pa.int32()),
                pa.array((start + sizes[:-1]).tolist(), pa.int64()), pa.array(parts[:count], pa.list_(types)),
                pa.array(token_coder.pack(blocks), pa.binary()),
            ]
            parts, ids, number, start = parts[count:], ids[count:], number + count, start + int(sizes[-1])
            return pa.record_batch(columns, ["file", "block", "start", "parts", "data"])

        for batch in slices(batches, 2000):
            types = pa.struct([("nth", pa.int64()), ("doc_id", batch.schema.field(0).type), ("n", pa.int64()), ("before", pa.int64()), ("ends", pa.bool_())])
            for doc_id, found in zip(batch.column(0).to_pylist(), encoder(path)(batch.column(1))):
                own = np.append(found, np.uint32(END)).astype(np.int64)
                if size and size + len(own) > token_coder.BLOCK:
                    parts.append([]), ids.append([])
                    size = 0
                for low in range(0, len(own), token_coder.BLOCK):
                    if low:
                        parts.append([]), ids.append([])
                    piece = own[low : low + token_coder.BLOCK]
                    size = (0 if low else size) + len(piece)
                    parts[-1].append({"nth": nth, "doc_id": doc_id, "n": len(piece), "before": low, "ends": low + len(piece) == len(own)})
                    ids[-1].append(piece)
                nth += 1
            if len(parts) > token_coder.LANES:
                yield flush(len(parts) - 1)
        if types is not None:
            yield flush(len(parts))

    dealt = docs.select("doc_id", text_or_empty().alias("text"))
    dealt = dealt.repartitionByRange(shuffle_partitions(docs), "doc_id").sortWithinPartitions("doc_id")
    dealt.mapInArrow(run, block_type(docs.schema["doc_id"].dataType.simpleString())).write.parquet(folder)


def pieces(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """A row for each document's part in each block: ``file, nth, doc_id, start, n, before, ends, crc, ids``.

    ``start`` counts the ids before the part in its file, ``crc`` is that of the part's ids; ``ids`` are
    kept where asked for, and for documents of several blocks. Raises if a block is damaged.
    """
    table = spark.read.parquet(folder)
    kind = table.schema["parts"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, token_coder.LANES):
            file, start, parts, data = (batch.column(n).to_pylist() for n in range(4))
            rows = []
            for of, begin, held, ids in zip(file, start, parts, token_coder.unpack(data)):
                at = 0
                for part in held:
                    raw = ids[at : at + part["n"]].astype("<u4").tobytes()
                    whole = part["ends"] and not part["before"]
                    rows.append((of, part["nth"], part["doc_id"], begin + at, part["n"], part["before"], part["ends"], zlib.crc32(raw), raw if keep_ids or not whole else None))
                    at += part["n"]
            types = [pa.int32(), pa.int64(), batch.schema.field(2).type.value_type.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
            columns = zip(*rows) if rows else [[]] * len(types)
            names = ["file", "nth", "doc_id", "start", "n", "before", "ends", "crc", "ids"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = f"file int, nth long, doc_id {kind}, start long, n long, before long, ends boolean, crc long, ids binary"
    return table.select("file", "start", "parts", "data").mapInArrow(run, schema)


def read(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """One row for each document in the files: ``doc_id, start, n_tokens, ids_crc32``, and ``ids`` where asked for.

    ``start`` counts the ids of all documents before it, ``n_tokens`` has END in it, and ``ids`` are
    little-endian unsigned 32-bit numbers. Only documents of several blocks are put together in a shuffle,
    their parts in order.
    """
    # Read twice below, so decoded once and stored; the ids of whole documents are left out unless asked for.
    every = stored(pieces(spark, folder, keep_ids), "pieces")
    table = spark.read.parquet(folder)
    last = table.select("file", (F.col("start") + F.aggregate("parts", F.lit(0).cast("long"), lambda t, p: t + p["n"])).alias("end"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each file.
    files = last.groupBy("file").agg(F.max("end").alias("end"))
    files = files.select("file", F.coalesce(F.sum("end").over(before), F.lit(0)).alias("_first"))
    whole = F.col("ends") & (F.col("before") == 0)
    one = every.where(whole).select("file", "doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"), "ids")
    raw = F.array_sort(F.collect_list(F.struct("before", "ids")))["ids"]
    parts = every.where(~whole).groupBy("file", "nth").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), raw.alias("_ids")
    )
    ids = F.aggregate("_ids", F.lit(b""), lambda all_, x: F.concat(all_, x))
    several = parts.select("file", "doc_id", "start", "n_tokens", ids.alias("ids"))
    several = several.select("file", "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "ids")
    rows = one.unionByName(several).join(F.broadcast(files), "file")
    columns = ["doc_id", (F.col("start") + F.col("_first")).alias("start"), "n_tokens", "ids_crc32"]
    return rows.select(*columns, *["ids"] * keep_ids)


def write_and_read(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Write the documents to a new folder below ``spark.checkpoint.dir`` and read them back."""
    folder = shared_dir(docs.sparkSession, "tokens")
    write(docs, folder, path)
    return read(docs.sparkSession, folder)
