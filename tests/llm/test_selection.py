"""Resampling, filter audit and outliers against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from runledger.llm import filter_audit, outliers, resampling
from runledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{n % 977}" for n in range(40_000))
AWKWARD = [
    (1, "The quick brown fox"), (None, "The quick brown fox"), (2, None, None, None), (2, None, None, None), (3, ""), (4, " \n\t "),
    (5, LONG, "en", "a"), (6, "É x İ 日本語   y"), (7, "tie", "en", "a"), (7, "tie", "en", "a"), (7, "other", None, "b"),
    (None, "lone"), (None, "lone"), (9, "\x00 null\x00byte"),
]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Resampling


def plain_words(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def plain_resample(docs, target, percent, least, ngram, buckets, seed):
    def features(text):
        words = plain_words(text)
        return [" ".join(words[i : i + n]) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)))
    for text in target:
        t.update(map(bucket, features(text)))
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(buckets)}
    scored = []
    for doc_id, text in docs:
        found = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        scored.append((doc_id, len(plain_words(text)), len(found), weight, weight + noise))
    fit = [x for x in scored if x[1] >= least]
    last = (1 << 70)
    best = sorted(fit, key=lambda x: (-x[4], last if x[0] is None else x[0]))[: percent * len(fit) // 100]
    return scored, best


@pytest.mark.parametrize("percent, least, ngram, buckets", [(10, 20, 1, 10_000), (50, 1, 2, 64), (100, 0, 3, 7), (3, 1, 1, 100)])
def test_draw_equals_plain_python(spark, make, percent, least, ngram, buckets):
    random.seed(5)
    texts = [" ".join(random.choices(["alpha", "Beta", "gamma's", "д", "x1"], k=random.randrange(60))) for _ in range(150)]
    docs = [(r[0], r[1]) for r in AWKWARD] + [(100 + n, text) for n, text in enumerate(texts)]
    target = ["Beta x1 beta", None, "", "gamma"]
    how = {"percent": percent, "least": least, "ngram": ngram, "buckets": buckets, "seed": "s"}
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(make(docs), frame, **how).collect()
    scored, best = plain_resample(docs, target, **how)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter(scored)
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(best) + 1))
    assert [(r.doc_id, r.score) for r in drawn] == [(x[0], x[4]) for x in best]
    assert resampling.draw(make(docs), frame, **how).count() == len(best)


def test_draw_returns_whole_rows(spark, make):
    docs = make([(n, f"common words of document {n}") for n in range(40)] + [(7, "twin twin")] * 2)
    got = resampling.draw(docs, docs, percent=50, least=1)
    assert got.columns == docs.columns and got.count() == 21
    assert not got.exceptAll(docs).count()


@pytest.mark.parametrize("margin, accuracy", [(0.0, 2), (0.001, 10_000), (2.0, 5)])
def test_bracket_holds_the_score_that_ends_the_draw(spark, margin, accuracy):
    values = [n * n % 97 for n in range(1000)] + [50] * 500
    scores = spark.createDataFrame([(v,) for v in values], "score long").repartition(7)
    for take in (1, 2, 37, 750, 1499, 1500):
        low, high, above = resampling.bracket(scores, len(values), take, margin, accuracy)
        assert low <= sorted(values, reverse=True)[take - 1] <= high
        assert above == sum(v > high for v in values) < take


def test_draw_from_nothing(spark, make, empty):
    nothing = spark.createDataFrame([], "text string")
    assert resampling.resample(empty, nothing).count() == 0 == resampling.draw(empty, nothing).count()
    got = resampling.resample(make(AWKWARD), nothing, least=1).collect()
    assert len(got) == len(AWKWARD) and sum(r["rank"] is not None for r in got) == 1


# Filter audit


def plain_audit(rows, filters):
    """From (part, set of failed filters, good, toxic)."""
    out, taken = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations(filters):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in own) - len(gone)
                left = [r for r in left if f not in r[1]]
                taken[part, f] += len(gone)
                alone = sum(r[1] == {f} for r in own)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return sorted((*key, *counts, taken[key[0], key[1][key[2] - 1]]) for key, counts in out.items())


@pytest.mark.parametrize("filters", ["A", "XYZ", "ABCDE"])
def test_audit_equals_orders_applied_one_by_one(spark, filters):
    random.seed(7)
    rows = [(random.choice("pq"), {f for f in filters if random.random() < 0.3}, random.random() < 0.5, random.random() < 0.2) for _ in range(300)]
    rows.append(("r", set(), True, True))
    data = [(p, *[f in s or None for f in filters], g, t, "x", 1) for p, s, g, t in rows]
    columns = ", ".join(f"{f} boolean" for f in filters)
    df = spark.createDataFrame(data, f"p string, {columns}, good boolean, toxic boolean, n string, fails int")
    got = sorted(tuple(r) for r in filter_audit.audit(df, "p", filters, ["good", "toxic"]).collect())
    assert got == plain_audit(rows, filters)


def test_audit_of_nothing_and_of_too_many_filters(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failures(empty, labels), "part", "ABCDE", ["good"]).count() == 0
    with pytest.raises(ValueError):
        filter_audit.audit(empty, "source", "ABCDEFGH")


def test_failures_of_awkward_rows(spark, make):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (5, None, None), (999, 1, 1)], "doc_id long, quality int, toxic int")
    more = [(20, "Word " * 60), (21, "a#b " * 60), (22, "A b " * 60), *[(30 + n, "copy") for n in range(50)], (30, "copy")]
    docs = AWKWARD + more
    got = filter_audit.failures(make(docs), labels)
    first = defaultdict(lambda: math.inf)
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            first[text or ""] = min(first[text or ""], doc_id)
    want = []
    for doc_id, text, *rest in docs:
        text, words = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        flags = (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            bool(re.search(r"[#$%&*|]", text)), doc_id is not None and doc_id > first[text],
        )
        want.append((rest[1] if rest and rest[1] else "", *flags, doc_id == 1, doc_id == 1))
    said = [F.coalesce(c, F.lit(False)) for c in ("good", "toxic")]
    assert rows_of(got.select("part", *"ABCDE", *said)) == sorted(want, key=str)


# Outliers


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit.update(range(i, i + 8))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit)


def plain_vector(text):
    n, chars, symbols, dup, rep = plain_counts(text)
    ascii_letters = [c for c in text if c.isascii() and c.isalpha()]
    letters = len(ascii_letters) + sum(not c.isascii() for c in text)
    share = lambda a, b: math.asin(math.sqrt(a / b)) if b else 0.0
    words = text.encode().split()
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    marks = sum(33 <= ord(c) < 127 and not c.isalnum() for c in text)
    digits = sum(c in "0123456789" for c in text)
    made = [
        math.log(chars / n), share(symbols, chars), share(sum("A" <= c <= "Z" for c in text), letters), share(marks, chars),
        share(digits, chars), share(dup, len(lines)), share(rep, n), math.log(len(set(words))) / math.log(n),
    ]
    return [int(math.floor(abs(x) * 10_000 + 0.5) * (1 if x >= 0 else -1)) for x in made]


def plain_models(x, core, steps):
    """Centre and inverse scatter from all vectors of a cell, with whole matrices."""
    k, floors = x.shape[1], np.array(list(outliers.FLOORS.values())) * 10_000
    middle = np.array([np.sort(c)[math.ceil(len(x) / 2) - 1] for c in x.T])
    y = x - middle
    off = np.array([np.sort(np.abs(c))[math.ceil(len(x) / 2) - 1] for c in y.T])
    spread = np.maximum(off * 1.4826, floors)
    u = np.round(np.tanh(y / spread) * 10_000)
    scatter = u.T @ u / len(u) - np.outer(u.mean(0), u.mean(0))
    own = np.sqrt(np.maximum(np.diag(scatter), 1))
    correlation = scatter / np.outer(own, own)
    np.fill_diagonal(correlation, 1)
    far = lambda mean, s: np.einsum("ni,ij,nj->n", y - mean, np.linalg.inv(s), y - mean)
    best = None
    for guess in (np.eye(k), correlation):
        mean, s, before = np.zeros(k), guess * np.outer(spread, spread) + np.diag(floors**2), None
        for _ in range(steps):
            bins = np.floor(np.log1p(far(mean, s)) * 100)
            near = y[bins <= np.sort(bins)[math.ceil(core * len(y)) - 1]]
            mean = near.mean(0)
            s = np.cov(near.T, bias=True) * outliers.consistency(core, k) + np.diag(floors**2)
            now = np.linalg.slogdet(s)[1]
            if before is not None and abs(now - before) < 1e-9:
                break
            before = now
        if best is None or now < best[0] - 1e-9:
            best = now, mean, s
    near = y[far(*best[1:]) <= outliers.chi_limit(1 - outliers.REWEIGHT, k)]
    s = np.cov(near.T, bias=True) * outliers.consistency(1 - outliers.REWEIGHT, k) + np.diag(floors**2)
    return far(near.mean(0), s)


def plain_verdicts(docs, rows, steps=50):
    """Kept flags in the order of ``docs``: (text, lang, source)."""
    fit = {}
    for n, (text, lang, source) in enumerate(docs):
        counts = plain_counts(text)
        if counts[0] >= 20 and 100 * counts[4] <= 30 * counts[0]:
            fit[n] = lang, source
    sizes, cells = Counter(fit.values()), {}
    by_lang = Counter()
    for (lang, source), n in sizes.items():
        by_lang[lang] += n if n < rows else 0
    for n, group in fit.items():
        cells[n] = group if sizes[group] >= rows else (group[0], "few") if by_lang[group[0]] >= rows else "rest"
    kept = {n: True for n in fit}
    for cell in set(cells.values()):
        own = [n for n in cells if cells[n] == cell]
        if len(own) >= rows:
            far = plain_models(np.array([plain_vector(docs[n][0]) for n in own], float), outliers.CORE, steps)
            kept |= dict(zip(own, (far <= outliers.chi_limit(1 - outliers.REJECT, len(outliers.FLOORS))).tolist()))
    return [kept.get(n, False) for n in range(len(docs))]


def test_outliers_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    verdicts = plain_verdicts([(r.text, r.lang, r.source) for r in docs], outliers.ROWS, outliers.STEPS)
    want = []
    for r, kept in zip(docs, verdicts):
        n = plain_counts(r.text)
        want.append((r.doc_id, *n, n[0] < 20 or 100 * n[4] > 30 * n[0], kept))
    got = rows_of(QUERIES["op13_outliers"](spark, SF))
    assert got == sorted(want, key=str)
    assert {r[-1] for r in got if not r[-2]} == {True, False}


def planted(seed=1, ordinary=400):
    random.seed(seed)
    words = ["the", "of", "and", "river", "stone", "carried", "village", "because", "winter", "slowly", "light", "under"]
    docs = []
    for n in range(ordinary):
        text = ". ".join(" ".join(random.choices(words, k=9)).capitalize() for _ in range(random.randrange(4, 40)))
        docs.append((text + ".", "en", "hot" if n % 3 else None))
    for k, source in enumerate(["hot", None] * 10):
        body = random.choices(words, k=80)
        docs.append(([" ".join(body).upper(), " | ".join(body), " ".join(f"{w}$$$" for w in body)][k % 3], "en", source))
    return docs


def test_outliers_find_what_is_planted(spark, make):
    docs = planted()
    table = make([(n, text, lang, source) for n, (text, lang, source) in enumerate(docs)])
    got = {r.doc_id: r.kept for r in outliers.judge(table).collect()}
    assert [got[n] for n in range(len(docs))] == plain_verdicts(docs, outliers.ROWS, outliers.STEPS)
    assert [n for n in got if not got[n]] and not any(got[n] for n in range(400, 420))
    assert sum(got[n] for n in range(400)) == 400
    kept = outliers.keep_ordinary(table)
    assert kept.columns == table.columns and kept.count() == 400


def test_outliers_of_awkward_rows(spark, make, empty):
    docs = AWKWARD + [(40, " ".join(["same"] * 25)), (41, " ".join(f"w{n}" for n in range(25)))]
    got = outliers.judge(make(docs)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r.doc_id, *[r[c] for c in names]) for r in got) == Counter((r[0], *plain_counts(r[1])) for r in docs)
    for r in got:
        assert r.kept == (not r.base_failed) and r.distance is None
    assert outliers.judge(empty).count() == 0 == outliers.keep_ordinary(empty).count()


def test_repeated_windows():
    random.seed(2)
    for span in (1, 2, 3, 5, 8, 13):
        for _ in range(60):
            ids = [random.randrange(random.choice((2, 3, 30))) for _ in range(random.randrange(60))]
            windows = [tuple(ids[i : i + span]) for i in range(len(ids) - span + 1)]
            hit = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + span)}
            assert outliers.in_repeated_windows(np.array(ids, np.int64), span) == len(hit)


def test_chi_square():
    # Fixed values of tables of the distribution.
    for share, k, limit in ((0.95, 1, 3.841), (0.95, 8, 15.507), (0.975, 8, 17.535), (0.5, 2, 1.386), (0.999, 10, 29.588)):
        assert outliers.chi_limit(share, k) == pytest.approx(limit, abs=1e-3)
