"""Exact dedup, mixing, line dedup and token coding against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from runledger.llm import exact_dedup, line_dedup, mixing, token_coder, token_files
from runledger.llm.queries import ORACLES, QUERIES
from workload.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    got, want = rows_of(got.columns, got.collect()), rows_of([d[0] for d in want.description], want.fetchall())
    assert got == want and len(got[0]) == (2400 if name == "op12_filter_audit" else 200)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_a_row_for_each_document(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == list(range(200))


def test_misra_gries_falls_short_by_its_bound_at_most():
    random.seed(3)
    digests = [b"hot"] * 400 + [str(random.randrange(300)).encode() for _ in range(600)]
    random.shuffle(digests)
    held, true = exact_dedup.summarise(digests, 20), Counter(digests)
    assert len(held) <= 20
    for digest, n in true.items():
        assert n - 1000 / 21 <= held.get(digest, 0) <= n


COPIES = [
    (1, "same"), (2, "same"), (None, "same"), (3, ""), (4, None), (5, "Same"), (9, "x" * 100_000), (8, "x" * 100_000),
    (7, "tie"), (7, "tie"), (None, "lone"), *[(100 + n, "hot") for n in range(60)],
]


@pytest.mark.parametrize("share", [3, 1000])
def test_groups_of_equal_texts(make, share):
    got = exact_dedup.duplicate_groups(make(COPIES), share).collect()
    groups = defaultdict(list)
    for doc_id, text in COPIES:
        groups[text or ""].append(doc_id)
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).digest()) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in got) == want


@pytest.mark.parametrize("share", [3, 1000])
def test_one_document_of_each_text_stays(make, share):
    docs = make(COPIES)
    got = exact_dedup.drop_duplicates(docs, share)
    assert got.columns == docs.columns
    rows = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert Counter(t or "" for _, t in rows) == Counter({t or "" for _, t in COPIES})
    assert {(2, "same"), (4, None), (9, "x" * 100_000), (7, "tie"), (None, "lone"), (159, "hot")} <= set(rows)


def fill(sizes: dict, total: float) -> dict:
    """Targets by resharing what is above twice a source's size until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}
    fixed: dict = {}
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        aims = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        above = [s for s in rest if aims[s] > 2 * sizes[s]]
        if not above:
            return fixed | aims
        fixed |= {s: 2 * sizes[s] for s in above}


def test_mix_meets_targets(make):
    random.seed(5)
    sources = [None, "b", "a", "é", "z", "none"]
    rows = [(n, " ".join("w" * random.randint(0, 9) for _ in range(random.randint(0, 60))), None, random.choice(sources[:5])) for n in range(400)]
    rows += [(1000, None, None, "none"), (1001, " \t", None, "none"), (None, "no id at all", None, "a"), (3, rows[3][1], None, rows[3][3])]
    docs = make(rows)
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((i, size(t)) for i, t, *_ in rows if i is not None)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += size(text)
    want = fill(dict(sizes), 1.5 * sum(sizes.values()))
    taken = Counter()
    for r in got:
        assert 0 <= r.copies <= 2 and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.size * r.copies
    assert all(abs(taken[s] - want[s]) <= 2 * 60 for s in sizes)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())


def test_taken_rows_are_the_mix(make):
    random.seed(6)
    docs = make([(n // 2 if n < 6 else n, "w " * random.randint(0, 30), None, random.choice("ab")) for n in range(80)])
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r.doc_id] += r.copies
    got = mixing.take_mix(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == +plan


def plain_lines(rows):
    key = lambda line: re.sub(r"[A-Z]", lambda m: m.group().lower(), line.strip("\t\n\x0b\x0c\r "))
    least = lambda i: -1 if i is None else i
    first = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            first[key(line)] = min(least(doc_id), first.get(key(line), 1 << 62))
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == least(doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_lines_go_but_in_the_smallest_document(make, batches):
    random.seed(batches)
    pool = ["a common line here", "  A Common LINE here\t", "short", "", "ÀÉ not ascii upper", "àÉ not ascii upper", "x" * 5000, "\x0bninechars\r", "tencharsxx"]
    pool += [f"line number {n} of some" for n in range(30)]
    rows = [(n, "\n".join(random.choice(pool) for _ in range(random.randint(1, 8)))) for n in random.sample(range(500), 120)]
    rows += [(1000, None), (1001, ""), (1002, "\n"), (1003, "\n".join(["same line twice"] * 3)), (1004, "same line twice"), (None, "a common line here")]
    got = line_dedup.dedup_lines(make(rows), batches)
    assert Counter(map(tuple, got.collect())) == plain_lines(rows)
    assert not any(t.name.startswith("line_run_") for t in got.sparkSession.catalog.listTables())


@pytest.mark.parametrize("batches", [1, 3])
def test_rows_alike_in_doc_id_lose_their_own_lines(make, batches):
    rows = [(1, "common line here"), (7, "common line here\nunique line aaa"), (7, "unique line bbb\ncommon line here")]
    rows += [(9, "unique line ccc\n" * 5 + "common line here"), (9, "unique line ddd"), (9, None), (9, "unique line ddd")]
    rows += [(None, "no id at all\nunique line eee"), (None, "unique line aaa")]
    got = line_dedup.dedup_lines(make(rows), batches).collect()
    assert Counter(map(tuple, got)) == plain_lines(rows)
    assert {(r.doc_id, r.kept_text) for r in got} >= {(7, "unique line bbb"), (9, "unique line ddd"), (9, "")}


def test_runs_are_merged_level_by_level(spark):
    index = line_dedup.LineIndex(spark, 2, fanout=2)
    for n in range(5):
        hashes = spark.range(n * 10, n * 10 + 15).selectExpr("id AS h1", "-id AS h2")
        index.add(index.missing(hashes))
    assert [len(level) for level in index.levels] == [1, 0, 1]
    assert sorted(r.h1 for run in index.runs for r in run.collect()) == list(range(55))
    index.drop()


def test_blocks_of_ids_come_back():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, 65536, n) for n in (0, 1, 7, 500)] + [np.zeros(900, int), np.arange(2000) % 50, (rng.zipf(1.2, 1500) % 50257)]
    packed = token_coder.pack(blocks)
    assert [b.tolist() for b in token_coder.unpack(packed)] == [b.tolist() for b in blocks]
    # What blocks hold does not depend on the blocks beside them.
    assert [token_coder.pack([b])[0] for b in blocks] == packed
    assert len(packed[5]) < 2000


def test_damage_is_found():
    packed = token_coder.pack([np.arange(300) * 7 % 911])[0]
    for at in (0, 5, 9, 14, 17, 25, len(packed) - 1):
        with pytest.raises(token_coder.Damaged):
            token_coder.unpack([packed[:at] + bytes([packed[at] ^ 4]) + packed[at + 1 :]])
    with pytest.raises(token_coder.Damaged):
        token_coder.unpack([packed[:-2]])


def test_files_hold_every_document(spark, make, shared):
    import zlib

    from tokenizers import Tokenizer

    random.seed(2)
    words = "the of and ñandú  \n <|endoftext|> 中文 12345 don't".split(" ")
    rows = [(n, " ".join(random.choices(words, k=random.randint(0, 40)))) for n in random.sample(range(10**6), 300)]
    rows += [(-5, None), (-6, ""), (-7, "long text " * 6000), (-8, "y" * 30000)]
    tokenizer = Tokenizer.from_file(token_files.VOCABULARY)
    assert tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids.count(50256) == 1
    rows += [(-9, "<|endoftext|>"), (-10, "x<|endoftext|>y  <|endoftext|>\n<|endoftext|> z <|endoftext|"), (-11, "hello <|endoftext|> world")]
    start, want = 0, []
    for doc_id, text in sorted(rows):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    folder = f"{shared}/tokens-test"
    token_files.write(make(rows, 5), folder)
    got = token_files.read(spark, folder, keep_ids=True)
    assert [(*r[:4], bytes(r.ids)) for r in got.orderBy("doc_id").collect()] == want
    assert all(r.n <= token_coder.BLOCK for r in token_files.pieces(spark, folder).collect())


def test_order_0_predicts_ids():
    rng = np.random.default_rng(5)
    often = rng.choice(50_000, 8, replace=False)
    blocks = [np.where(rng.random(4000) < 0.9, rng.choice(often, 4000), rng.integers(0, 50_000, 4000)) for _ in range(20)]
    packed = token_coder.pack(blocks)
    assert all((a == b).all() for a, b in zip(token_coder.unpack(packed), blocks))
    # Without any order: 3 bits for which of eight, 16 for one in ten, and half a bit to tell these apart.
    assert sum(map(len, packed)) * 8 / 80_000 < 0.9 * 3 + 0.1 * 17 + 0.5 + 1.2


def test_blocks_of_any_length_come_back():
    rng = np.random.default_rng(7)
    lengths = [1, 31, 32, 33, 63, 64, 65, 127, 128, 129, 255, 256, 257, 1023, 4095, 4096]
    blocks = [rng.zipf(1.3, n) % 65536 for n in lengths] + [np.tile(rng.integers(0, 65536, 40), 100)[:n] for n in lengths]
    packed = token_coder.pack(blocks)
    assert all(a.tolist() == b.tolist() for a, b in zip(token_coder.unpack(packed), blocks))
    assert [token_coder.pack([b])[0] for b in blocks] == packed
    # What follows an id, and what follows two, is predicted once it was seen.
    assert len(packed[-1]) * 8 / 4096 < 1.5


def test_new_chunks_reach_the_library_together():
    import pyarrow as pa

    random.seed(3)
    texts = [" ".join("".join(random.choices("aeiou bcd,é", k=300)).split()) for _ in range(100)]
    encoder = token_files.Encoder(token_files.VOCABULARY)
    library, given = encoder.tokenizer, []

    class Counting:
        def encode_batch_fast(self, batch, **options):
            given.extend(batch)
            return library.encode_batch_fast(batch, **options)

    encoder.tokenizer = Counting()
    try:
        got = encoder(pa.array(texts))
    except TypeError:
        got = encoder(texts)
    want = [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    # A text's first chunk by itself, all others end to end.
    assert len({chunk for text in texts for chunk in text.split(" ")}) > 2000 and len(given) < 120


def test_texts_of_odd_spaces_have_the_ids_of_the_library():
    import pyarrow as pa

    random.seed(1)
    parts = ["a", " ", "  ", "\n", " \n", "\u3000", "\xa0", "\x85", "\x1c", "é", "中", "<|endoftext|>", "'s", "1", "\0", "b c", "x. ", "\t", "\u200b", "\u0120"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(3000)] + ["", " ", "  ", "a ", " a", "a\n", "w " * 200_000]
    encoder = token_files.Encoder(token_files.VOCABULARY)
    want = [x.ids for x in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from what is known
        assert [x.tolist() for x in encoder(pa.array(texts))] == want
    assert encoder(pa.array([], pa.string())) == []


def test_empty_tables(empty):
    assert exact_dedup.duplicate_groups(empty).count() == 0
    assert exact_dedup.drop_duplicates(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.take_mix(empty).count() == 0
    assert line_dedup.dedup_lines(empty).count() == 0
    assert token_files.write_and_read(empty).count() == 0
