"""Whole rows of the queries without SQL, on the small table, against plain Python and the libraries."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from test_models import ids_of, plain_pii, plain_secrets
from tokenizers import Tokenizer

from runledger.llm import language, pii, secrets, token_files
from runledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def rows(spark, name):
    return {r.doc_id: r.asDict() for r in QUERIES[name](spark, SF).collect()}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_bpe(spark, texts):
    want = {}
    for i, text in texts.items():
        ids = ids_of(text)
        want[i] = {"doc_id": i, "n_tokens": len(ids) // 4, "ids_sha256": sha(ids), "decoded_sha256": sha(text)}
    assert rows(spark, "op1_bpe") == want


def plain_prints(texts):
    """I-Match from its definition: the fingerprint of any text, by the lexicon of ``texts``."""
    terms = lambda text: set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)))
    documents = Counter(term for text in texts for term in terms(text))
    kept = {t for t, n in documents.items() if n >= 2 and n * 2000 >= len(texts) and n * 8 <= len(texts)}
    subsets = [0, 2, 4, 5, 6, 5, 6, 5, 6, *[7, 8] * 5, *[9, 10] * 8]
    bits = (1 << 64) - 1

    def member(hash_, place, power):
        x = hash_ ^ (place * 0x9E3779B97F4A7C15 & bits)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor & bits
        return (x ^ x >> 31) % 2**power == 0

    def make(text):
        own = terms(text)
        found = [xxhash.xxh3_64_intdigest(t.encode()) for t in sorted(own & kept, key=str.encode)]
        if not found:
            return "=" + xxhash.xxh3_64_hexdigest(" ".join(sorted(own, key=str.encode)).encode())
        parts = []
        for place, power in enumerate(subsets):
            some = [h for h in found if member(h, place, power)]
            parts.append(xxhash.xxh3_64_hexdigest(b"".join(h.to_bytes(8, "little") for h in some)) if some else "-" * 16)
        return "".join(parts)

    def alike(one, other):
        if one == other or "=" in one + other:
            return float(one == other)
        pairs = [(one[n : n + 16], other[n : n + 16]) for n in range(0, len(one), 16)]
        used = [a == b for a, b in pairs if (a, b) != ("-" * 16, "-" * 16)]
        return sum(used) / len(used)

    return make, alike


def test_fingerprints(spark, texts):
    make, alike = plain_prints(list(texts.values()))
    order, want = sorted(texts, reverse=True), {}
    for i, following in zip(order, order[1:] + order[:1]):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[following][:half]
        own, other, next_ = map(make, (texts[i], edited, texts[following]))
        want[i] = {
            "doc_id": i, "n_chars": len(texts[i]), "edited_sha256": sha(edited), "fingerprint": own, "edited_fingerprint": other,
            "near_edited": alike(own, other), "near_next": alike(own, next_),
        }
    assert rows(spark, "op2_fingerprints") == want


def plain_pieces():
    model = sentencepiece.SentencePieceProcessor(model_file=language.VOCABULARY)
    return {model.id_to_piece(n) for n in range(model.get_piece_size()) if not (model.is_control(n) or model.is_unknown(n) or model.is_byte(n))}


def plain_word(chunk):
    found = [n for n, c in enumerate(chunk) if c.isalnum()]
    return chunk[found[0] : found[-1] + 1].lower() if any(c.isalpha() for c in chunk) else ""


def plain_sums(word, chance):
    """Sums over all segmentations of each beginning and of each end of a word, and its stretches with their chances."""
    n = len(word)
    arcs = [(i, j, chance(word[i:j])) for j in range(1, n + 1) for i in range(max(0, j - 16), j)]
    ahead, behind = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for i, j, p in arcs:
        ahead[j] += ahead[i] * p
    for i, j, p in sorted(arcs, key=lambda a: -a[1]):
        behind[i] += behind[j] * p
    return ahead, behind, arcs


def plain_language_model(words, pieces):
    size = len(pieces) + 2
    chances = dict.fromkeys(pieces, 1 / size)
    lookup = lambda s: chances[s] if s in chances else 1e-7 if len(s) == 1 else 0.0
    for _ in range(5):
        expected = Counter()
        for word, times in words.items():
            ahead, behind, arcs = plain_sums(word, lookup)
            for i, j, p in arcs:
                if p and word[i:j] in chances:
                    expected[word[i:j]] += times * ahead[i] * p * behind[j] / ahead[-1]
        total = sum(expected.values()) + 0.02 * size
        chances = {piece: (expected[piece] + 0.02) / total for piece in pieces}
        lookup = lambda s, c=chances: c[s] if s in c else 1e-7 if len(s) == 1 else 0.0
    return lookup


def test_language(spark, docs, texts):
    pieces, words = plain_pieces(), {}
    split = lambda text: ["▁" + w for w in map(plain_word, (text or "").split()) if w]
    for r in docs.collect():
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            words.setdefault(r.lang, Counter()).update(split(r.text))
    models = {name: plain_language_model(own, pieces) for name, own in sorted(words.items())}
    logs, want = {}, {}
    for i, text in texts.items():
        total = dict.fromkeys(models, 0.0)
        for word in split(text):
            if word not in logs:
                logs[word] = {name: math.log(plain_sums(word, chance)[0][-1]) for name, chance in models.items()}
            for name in models:
                total[name] += logs[word][name]
        best = max(models, key=lambda name: total[name])
        score = 1 / sum(math.exp(t - total[best]) for t in total.values())
        held = zlib.crc32(str(i).encode()) % 4 == 2
        found = (best, pytest.approx(score, rel=1e-6)) if split(text) else ("und", 0.0)
        want[i] = {"doc_id": i, "held_out": held, "lang_pred": found[0], "score": found[1]}
    assert rows(spark, "op6_language") == want


def spans_row(i, base, spans, kinds, counted):
    written = lambda found: ",".join(f"{kinds[k]}:{start}:{end}" for k, start, end in found)
    counts = {f"n_{kinds[k]}": sum(x[0] == k for x in base) for k in range(counted)}
    return {"doc_id": i, **counts, "base_sha256": sha(written(base)), "spans": written(spans)}


def test_pii(spark, docs, texts):
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.personal_data(docs).collect()}
    want = {i: spans_row(i, sorted(plain_pii(text)), found[i], pii.KINDS, 4) for i, text in texts.items()}
    assert rows(spark, "op7_pii") == want


def test_secrets(spark, docs, texts):
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.secret_spans(docs).collect()}
    base = {i: [(kind, start, end) for start, kind, end in plain_secrets(text)] for i, text in texts.items()}
    assert rows(spark, "op8_secrets") == {i: spans_row(i, base[i], found[i], secrets.KINDS, 3) for i in texts}


def test_token_files(spark, texts):
    tokenizer, start, want = Tokenizer.from_file(token_files.VOCABULARY), 0, {}
    for i in sorted(texts):
        ids = np.array(tokenizer.encode(texts[i], add_special_tokens=False).ids + [0], "<u4")
        want[i] = {"doc_id": i, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        start += len(ids)
    assert rows(spark, "op10_token_files") == want
