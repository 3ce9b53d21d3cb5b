"""Encoding, fingerprints, languages, personal data and secrets against plain Python and held-out rows."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from runledger.llm import bpe, fingerprints, language, pii, secrets

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids_of(text):
    return np.array(REFERENCE.encode_ordinary(text), "<u4").tobytes()


AWKWARD = st.text(st.sampled_from("ab \n\t'sé中\xa0\x1c\x85　​1!🙂t") | st.characters(exclude_categories=["Cs"]), max_size=80)


@settings(max_examples=300, deadline=None)
@given(st.lists(AWKWARD, max_size=4))
def test_ids_are_those_of_the_library(texts):
    assert bpe.encoder(bpe.VOCABULARY)(texts) == list(map(ids_of, texts))


def test_pieces_merged_together_and_apart_agree():
    random.seed(4)
    encoder = bpe.encoder(bpe.VOCABULARY)
    pieces = list({"".join(random.choices("abcdethe né", k=random.randint(1, 30))).encode() for _ in range(800)})
    apart = [np.array(bpe.merge_long(p, RANKS), "<u4").tobytes() for p in pieces]
    assert bpe.merge_many(pieces, encoder.pairs) == apart
    assert apart == [np.array(REFERENCE._core_bpe.encode_single_piece(p), "<u4").tobytes() for p in pieces]


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, " " * 3_000 + "x", "\n " * 2_000, "é" * 5_000, "word " * 200_000])
def test_long_texts(text):
    assert bpe.encoder(bpe.VOCABULARY)([text])[0] == ids_of(text)


def test_rank_queue_gives_the_lowest_rank():
    random.seed(0)
    queue, held = bpe.RankQueue(), set()
    for _ in range(4000):
        rank = random.randrange(50_256)
        (queue.remove if rank in held else queue.add)(rank)
        held ^= {rank}
        assert queue.first() == min(held, default=-1)


def test_documents_encode_and_decode(make):
    rows = ["some text", None, "", "  spaced   out ", "x" * 1000, "<|endoftext|>", "some text", (None, "no id")]
    got = bpe.decode(bpe.encode(make(rows))).collect()
    assert Counter(bpe.encode_and_decode(make(rows)).collect()) == Counter(got)
    want = Counter((n if isinstance(r, (str, type(None))) else None, ids_of((r if not isinstance(r, tuple) else r[1]) or "")) for n, r in enumerate(rows))
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    for r in got:
        text = rows[r.doc_id] if r.doc_id is not None else "no id"
        assert bytes(r.decoded) == (text or "").encode()


def test_edited_texts_and_likeness(make):
    random.seed(8)
    words = [f"w{n}" for n in range(400)]
    texts = [" ".join(random.choices(words, k=random.randint(0, 200))) for _ in range(90)] + [None, "", "é" * 999, "one"]
    texts += [texts[3], texts[3] + " extra"]
    rows = list(zip(random.sample(range(1000), len(texts)), texts))
    docs = make(rows, 4)
    docs.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r for r in fingerprints.compare_with_next(docs).collect()}
    finally:
        docs.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    make_print = fingerprints.Fingerprinter(fingerprints.lexicon(docs))
    near = []
    for (doc_id, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following, r = text or "", following or "", got[doc_id]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited == hashlib.sha256(changed.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (make_print(text), make_print(changed))
        assert r.near_edited == fingerprints.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == fingerprints.likeness(r.fingerprint, make_print(following))
        near.append((r.near_edited, r.near_next))
    assert np.mean(near, axis=0)[0] > 2 * np.mean(near, axis=0)[1]
    same = [got[i].fingerprint for i, t in rows if t == texts[3]]
    assert len(same) == 2 and len(set(same)) == 1
    other = next(got[i].fingerprint for i, t in rows if t == texts[-1])
    assert fingerprints.likeness(same[0], other) > 0.6
    one = fingerprints.compare_with_next(make([(5, "all alone here")])).collect()
    assert one[0].edited == hashlib.sha256(b"all aloall alo").hexdigest() and one[0].near_next == 1


def test_unlike_texts_have_unlike_fingerprints():
    words = [b"word%d" % n for n in range(4000)]
    make_print = fingerprints.Fingerprinter(words)
    prints = [make_print(word.decode()) for word in words]
    assert len(set(prints)) == 4000
    # Each part by itself tells terms apart.
    for low in range(0, len(prints[0]), fingerprints.DIGITS):
        parts = [p[low : low + fingerprints.DIGITS] for p in prints]
        parts = [p for p in parts if p != fingerprints.EMPTY]
        assert len(set(parts)) == len(parts)
    assert max(fingerprints.likeness(prints[0], p) for p in prints[1:]) == 0


def test_lexicon_counts_every_document(make):
    texts = ["The common, word"] * 40 + ["Rare thing"] * 2 + ["once"] + [f"filler{n} x" for n in range(60)]
    assert fingerprints.lexicon(make(texts), rare=60, common=2) == [b"common", b"rare", b"the", b"thing", b"word"]


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs, sample=40).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_what_has_no_language(make, empty):
    rows = [(n, "the cat and the dog", "en") for n in range(30)] + [(n, "der hund und die katze", "de") for n in range(30, 60)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 + 3 !", "en"), (103, "und die", None), (None, "der und", "de"), (104, "X" * 50_000, None)]
    docs = make(rows)
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert [got[n].lang_pred for n in (100, 101, 102, 103, None, 0, 40)] == ["und", "und", "und", "de", "de", "en", "de"]
    assert got[100].score == 0 and got[104].lang_pred in ("en", "de")
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= set(range(60)) | {103, None}
    assert not {100, 101, 102} & {r.doc_id for r in kept.collect()}
    assert language.identify(empty).count() == 0 and language.keep_identified(empty).count() == 0
    unlabelled = language.identify(make(["some words"])).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]


def test_forward_sums_all_segmentations():
    pieces = {"▁a": 2, "a": 3, "b": 4, "ab": 5, "▁ab": 6, "▁": 7}
    chances = np.array([[0], [1e-7], [0.2], [0.1], [0.3], [0.15], [0.05], [0.2]])
    want = 0.05 + 0.2 * 0.3 + 0.2 * 0.15 + 0.2 * 0.1 * 0.3
    assert np.exp(language.log_chances(["ab"], pieces, chances)[0, 0]) == pytest.approx(want)
    fitted = language.fit(Counter({"ab": 50, "b": 1}), pieces)
    assert fitted[6] == max(fitted) and fitted[2:].sum() == pytest.approx(1, abs=0.05)


def test_long_words_are_summed_over_all_segmentations():
    random.seed(11)
    pieces = {"▁": 2, "a": 3, "b": 4, "ab": 5, "abba": 6, "b" * 16: 7}
    chances = np.array([[0, 0], [1e-7, 1e-7], [0.1, 0.2], [0.2, 0.1], [0.1, 0.3], [0.3, 0.1], [0.2, 0.2], [0.1, 0.1]])
    words = ["".join(random.choices("aabbc", k=n)) for n in (31, 32, 33, 40, 60, 47)] + ["b" * 70, "short"]
    for word, got in zip(words, language.log_chances(words, pieces, chances)):
        sums = [np.ones(2)]
        for j in range(1, len(word) + 2):
            ends = [(i, ("▁" + word)[i:j]) for i in range(max(0, j - 16), j)]
            sums.append(sum(sums[i] * chances[pieces.get(piece, int(len(piece) == 1))] for i, piece in ends))
        assert got == pytest.approx(np.log(sums[-1]))
    assert np.isfinite(language.log_chances(["c" * 2000], pieces, chances)).all()


def test_long_and_short_words_are_fitted_alike(monkeypatch):
    pieces = {"▁": 2, "a": 3, "b": 4, "ab": 5, "abba": 6, "ba": 7}
    words = Counter({"abbaab": 5, "ab": 3, "baab" * 4: 2, "abbac": 1})
    want = language.fit(words, pieces)
    monkeypatch.setattr(language, "PART", 4)
    assert language.fit(words, pieces) == pytest.approx(want)


def test_texts_of_no_language_go(make):
    random.seed(12)
    rows = [(n, "the cat and the dog", "en") for n in range(30)] + [(n, "der hund und die katze", "de") for n in range(30, 60)]
    gibberish = " ".join("".join(random.choices("qxzjkvwbpfgh", k=8)) for _ in range(40))
    rows += [(100, gibberish, None), (101, "Быстрая коричневая лиса прыгает " * 5, None), (102, "快速的棕色狐狸" * 20, None)]
    docs = make(rows)
    assert {r.doc_id for r in language.keep_identified(docs).collect()} == set(range(60))
    assert all(r.score > 0.5 for r in language.identify(docs).where("doc_id < 60").collect())


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_pii(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        check = sum(d if n % 2 == 0 else d * 2 - 9 * (d > 4) for n, d in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and check % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("a@.1925+- ()%_é"), max_size=60) | st.from_regex(r"([0-9]{1,3}\.){2,6}[0-9]+|a(@b\.c_?){1,4}|\+1( ?[0-9]{2,4}){1,6}|4111(-?1111| 1111){3,4}", fullmatch=True))
def test_base_spans_of_personal_data(text):
    assert sorted(pii.base_spans(text)) == sorted(plain_pii(text))


def test_long_runs_do_not_hold_up():
    for text in ("9" * 100_000, "a" * 100_000 + "@", "+" + "1-" * 50_000, "1." * 50_000, "a@" * 30_000, "f" * 100_000, "token " + " " * 100_000):
        pii.spans_of(text), secrets.base_spans(text)


def test_personal_data_of_documents(make, empty):
    rows = [f"write to email me.{n}@mail.com or call +1 (234) 555-{1000 + n} please" for n in range(40)]
    rows += [f"phone (234) 555-{1000 + n} works" for n in range(30)] + [f"version 1.2.3.{n}" for n in range(10)]
    rows += [None, "", "plain words only", "ref x234 555 1234 9"]
    found = {r.doc_id: r.spans for r in pii.personal_data(make(rows)).collect()}
    assert len(found) == len(rows) and found[80] == found[81] == found[82] == found[83] == []
    for n, text in enumerate(rows[:80]):
        assert [(s.kind, s.start, s.end) for s in found[n] if s.base] == sorted(plain_pii(text))
    # The method's own: national numbers after a cue.
    assert [(s.kind, s.base) for s in found[45]] == [(3, False)]
    assert pii.personal_data(empty).count() == 0
    assert pii.likelihoods([]) == {} and not pii.trained([]).any()


def luhn_number(random_digits):
    """Digits completed to a number that passes the check."""
    return next(random_digits + d for d in "0123456789" if pii.luhn(random_digits + d))


def planted_personal(seed):
    """Texts with looser spans that are personal data and look-alikes that are not; those that are, by document."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    name = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    filler = lambda: " ".join(rng.choices("the report of last week says that we went over some pages with them again".split(), k=rng.randint(4, 14)))
    local = lambda: f"{rng.randint(2, 9)}{digits(2)}-{digits(3)}-{digits(4)}"
    card15 = lambda: luhn_number(rng.choice("34") + digits(13))
    right = [
        lambda: ("please call ", local()), lambda: ("phone: ", local()), lambda: ("my mobile is ", local()),
        lambda: ("email ", f"{name()} [at] {name()} [dot] com"), lambda: ("contact ", f"{name()}(at){name()}.org"),
        lambda: ("write to ", f"{name()} [at] {name()}.fr"), lambda: ("paid by credit card ", card15()), lambda: ("amex card ", card15()),
        lambda: ("login from host ", ":".join(f"{rng.randrange(1 << 12, 1 << 16):x}" for _ in range(8))),
    ]
    wrong = [
        lambda: ("order ", local()), lambda: ("serial ", local()), lambda: ("isbn ", f"{digits(3)}-{digits(3)}-{digits(4)}"),
        lambda: ("serial ", next(d for d in iter(lambda: digits(15), None) if not pii.luhn(d))),
        lambda: ("order id ", next(d for d in iter(lambda: digits(14), None) if not pii.luhn(d))), lambda: ("figure ", local()),
        lambda: ("see section ", f"{name()} [at] {name()} [dot] {name()}"),
    ]
    base = [lambda: ("email me at ", f"{name()}@{name()}.com"), lambda: ("call ", f"+1 (23{digits(1)}) 555-{digits(4)}"), lambda: ("server ", f"10.{rng.randrange(256)}.{rng.randrange(256)}.7")]
    texts, truth, judged = [], [], []
    for _ in range(900):
        text, own, every = "", set(), set()
        for kind in rng.choices(("right", "wrong", "base"), k=3):
            lead, span = rng.choice({"right": right, "wrong": wrong, "base": base}[kind])()
            text += f"{filler()} {lead}"
            place = (len(text), len(text) + len(span))
            if kind == "right":
                own.add(place)
            every.add(place) if kind != "base" else None
            text += f"{span} {filler()}.\n"
        texts.append(text)
        truth.append(own)
        judged.append(every)
    return texts, truth, judged


def test_added_spans_of_planted_documents(make):
    texts, truth, _ = planted_personal(3)
    right = wrong = missed = 0
    for r in pii.personal_data(make(texts), sample=2000).collect():
        added = {(s.start, s.end) for s in r.spans if not s.base}
        right += len(added & truth[r.doc_id])
        wrong += len(added - truth[r.doc_id])
        missed += len(truth[r.doc_id] - added)
    print(f"added spans: precision {right / (right + wrong):.3f}, recall {right / (right + missed):.3f}")
    assert right / (right + wrong) >= 0.9 and right / (right + missed) >= 0.9


def test_the_classifier_tells_spans_with_the_same_votes_apart():
    # Two shapes share their votes: one is mostly seen where votes are good, so it alone is believed.
    good, bad = pii.features(3, 5, 17, "call 555-123-4567 now", "++++"), pii.features(3, 3, 13, "id 5551234567 x", "-+--")
    rows = [(0.98, good)] * 60 + [(0.02, bad)] * 60
    weights = pii.trained(rows)
    same = "0+0+"
    like_good, like_bad = pii.features(3, 5, 17, "ring 555-987-6543 now", same), pii.features(3, 3, 13, "id 5559876543 x", same)
    assert weights[like_good].sum() > 0 > weights[like_bad].sum()


def test_calling_codes_and_domains(spark):
    assert all(map(pii.calling, ("1555", "7495", "3312", "4930", "35312", "85212", "99312", "590123")))
    assert not any(map(pii.calling, ("2101", "2591", "8011", "0123", "9991", "")))
    tops = pii.domains(spark)
    assert {"com", "de", "fr", "jp", "nz", "za", "uk", "eu", "dev"} <= tops and not {"txt", "local", "zz"} & tops


def test_estimation_equals_plain_loops():
    rng = random.Random(4)
    combos = ["".join(c) for c in {tuple(rng.choices("-0+", k=4)) for _ in range(25)}]
    counts = [(2, c, rng.randint(1, 80)) for c in combos]
    right = {c: 1 / (1 + math.exp(-1.5 * (c.count("+") - 3 * c.count("-")))) for c in combos}
    n = {c: k for _, c, k in counts}
    for _ in range(pii.ROUNDS):
        share = (sum(n[c] * right[c] for c in combos) + 1) / (sum(n.values()) + 2)
        odds = {}
        for c in combos:
            odds[c] = math.log(share / (1 - share))
            for labeler, sign in enumerate(c):
                def part(weight, prior):
                    each = {s: prior[s] + sum(n[x] * weight(x) for x in combos if x[labeler] == s) for s in "-0+"}
                    return each[sign] / sum(each.values())
                odds[c] += math.log(part(lambda x: right[x], {"-": 1, "0": 1, "+": 3}) / part(lambda x: 1 - right[x], {"-": 3, "0": 1, "+": 1}))
        right = {c: 1 / (1 + math.exp(-max(-50, min(50, o)))) for c, o in odds.items()}
    got = pii.likelihoods(counts)
    assert all(got[2, c] == pytest.approx(right[c], abs=1e-9) for c in combos)


def test_reliabilities_follow_the_votes():
    ballots = np.array([[1, 1, 1, 1], [1, 1, 0, 1], [-1, -1, 0, -1], [-1, 1, -1, -1], [1, -1, 0, 1]])
    right = pii.reliabilities(ballots, np.array([50.0, 200, 100, 30, 5]))
    assert right[0] > 0.99 and right[1] > 0.95 and right[2] < 0.05 and right[3] < 0.5


ASSIGN = re.compile(r"(?a)(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32])


@settings(max_examples=800, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWord", "toKen", "api_key", "apikey", "ſecret", "=", ": ", "'", '"', "AKIA", "ABCDEF0123", "deadbeef0", "x", " ", "é"]) | st.text("abcdef0123456789AKI=", max_size=20), max_size=12))
def test_base_spans_of_secrets(parts):
    text = "".join(parts)
    assert secrets.base_spans(text) == plain_secrets(text)


def test_secrets_do_not_depend_on_the_order_of_rows(make):
    random.seed(12)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(n % 5 if n % 7 else None, f"token={''.join(random.choices(letters, k=20))} some words and identifiers here {''.join(random.choices(letters, k=28))}") for n in range(60)]
    runs = []
    for order in (rows, rows[::-1]):
        found = secrets.secret_spans(make(order, 1 + len(runs) * 4), sample=9)
        runs.append(Counter((r.doc_id, str(r.spans)) for r in found.collect()))
    assert runs[0] == runs[1]


def test_ratio_equals_plain_sums():
    counts = {("a", "b"): 5, ("b", "a"): 3, ("", "a"): 2}
    table = np.zeros((128, 128))
    for (one, two), n in counts.items():
        table[ord(one) if one else 0, ord(two)] = n
    logs = secrets.log_chances(table)
    single = {c: sum(n for (_, two), n in counts.items() if two == c) + secrets.PRIOR for c in map(chr, range(128))}
    total = sum(single.values())

    def chance(one, two):
        out = sum(n for (x, _), n in counts.items() if x == one)
        return (counts.get((one, two), 0) + secrets.SINGLE * single[two] / total) / (out + secrets.SINGLE)

    want = sum(math.log(chance(one, two)) for one, two in zip(["", *"abab"], "ababz"))
    assert secrets.ratio("ababz", logs) == pytest.approx(want)


def test_random_strings_are_secrets(make, empty):
    random.seed(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    value = lambda n: "".join(random.choices(letters, k=n))
    plain = "the quick brown fox jumps over a lazy dog while nation_of identify internation realization international identifiers ionization meet internationalization_of_identifiers that goes on in number 123456789012345678"
    rows = [f"{plain} secret={value(24)} {plain}" for _ in range(60)]
    rows += [f"{plain} {value(30)} {plain}" for _ in range(10)] + [plain, None, ""]
    found = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in secrets.secret_spans(make(rows)).collect()}
    for n in range(60):
        assert found[n] == plain_secrets(rows[n])
    for n in range(60, 70):
        assert found[n] == [(len(plain) + 1, 3, len(plain) + 31)]
    assert found[70] == found[71] == found[72] == []
    assert secrets.secret_spans(empty).count() == 0
    assert secrets.secret_spans(make([value(40)])).collect()[0].spans == []


def test_empty_tables(empty):
    assert bpe.decode(bpe.encode(empty)).count() == 0
    assert fingerprints.fingerprint(empty).count() == 0
    assert fingerprints.compare_with_next(empty).count() == 0
