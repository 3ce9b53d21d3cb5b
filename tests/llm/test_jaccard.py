"""Links between near copies and the pipeline against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from runledger.llm import bpe, exact_dedup, jaccard, language, mixing
from runledger.llm.components import connected


def grams(text):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[n : n + 5]) for n in range(max(1, len(parts) - 4))} if parts else set()


def groups(rows):
    """Component of each row with a doc_id, by comparing all pairs."""
    sets = [(i, grams(t)) for i, t in rows if i is not None]
    parent = list(range(len(sets)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        least[root(n)] = min(i, least.get(root(n), i))
    return Counter((i, len(s), least[root(n)]) for n, (i, s) in enumerate(sets))


def corpus(seed, near, size=(30, 120), passage=0):
    """Random documents, chains of edits of one another, many near copies, and a passage in many of them."""
    rng = random.Random(seed)
    words = [f"w{n}" for n in range(500)]
    text = lambda: [rng.choice(words) for _ in range(rng.randint(*size))]
    shared = [f"p{n}" for n in range(passage)]
    base, out = text(), []
    for _ in range(near):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(copy)
    chain = text()
    for _ in range(25):
        chain = list(chain)
        for _ in range(2):
            chain[rng.randrange(len(chain))] = rng.choice(words)
        out.append(chain)
    for _ in range(60):
        own = text()
        at = rng.randrange(len(own))
        out.append(own[:at] + shared + own[at:])
    for _ in range(30):
        small = text()[: rng.randint(1, 14)]
        out += [small, small[:-1], small + ["x"]]
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("limit, seed, passage", [(32, 1, 0), (3, 2, 40), (2, 3, 200), (4, 4, 15)])
def test_components_are_those_of_all_pairs(make, limit, seed, passage):
    texts = corpus(seed, 50, passage=passage)
    rows = list(zip(random.Random(seed).sample(range(-500, 5000), len(texts)), texts))
    got = jaccard.link_groups(make(rows), limit).collect()
    assert Counter(map(tuple, got)) == groups(rows)


def test_awkward_rows(make, empty):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "a b"), (3, "A  B"), (9, "a b c"), (None, "a b"), (4, "x" * 50_000), (2, "x" * 50_000)]
    rows += [(10, "one two three four five six seven eight"), (11, "ONE two three four five six seven\teight"), (11, "ONE two three four five six seven\teight")]
    rows += [(12, "é É one two three"), (13, "É é one two three"), (14, "a\xa0b c d e f"), (15, "a b c d e f")]
    docs = make(rows)
    got = jaccard.link_groups(docs).collect()
    assert Counter(map(tuple, (r for r in got if r.doc_id is not None))) == groups(rows)
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, 1, None)]
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    stay = {i for i, _, c in groups(rows) if i == c}
    assert {r.doc_id for r in kept.collect()} == stay | {None}
    assert jaccard.link_groups(empty).count() == 0 and jaccard.drop_near_duplicates(empty).count() == 0


def test_bands_and_segments_cover_every_link():
    starts = jaccard.bands()
    for size in range(3, 3000):
        band = int(np.searchsorted(starts, size, "right")) - 1
        assert size <= jaccard.plan(band)[0]
        assert int(np.searchsorted(starts, 4 * size // 3, "right")) - 1 <= band + 1
        assert jaccard.plan(band)[1] > jaccard.plan(band)[0] // 3


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(0)
    edges = [(n, n + 1) for n in range(60)] + [(100, n) for n in range(101, 140)] + [(200 + n, 200 + (n + 1) % 15) for n in range(15)] + [(300, 300)]
    edges += [(b, a) for a, b in edges[:20]]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(61)} | {n: 100 for n in range(100, 140)} | {n: 200 for n in range(200, 215)}


def test_pipeline_against_plain_steps(spark, make, tmp_path):
    random.seed(11)
    texts = corpus(7, 12)
    rows = [(n, t, random.choice(["en", "de"]), random.choice(["s1", "s2", None])) for n, t in enumerate(texts)]
    rows += [(900, "1 2 3 !", "en", "s1"), (901, None, "en", "s1"), (902, texts[70], "en", "s2"), (903, texts[71], "de", "s2")]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    # The language model cannot be redone here: its verdicts are its operator's, all else is plain.
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in language.identify(docs).where("lang_pred <> 'und' AND score >= 0.5").collect()}
    left = [r for r in rows if r[0] in kept]
    assert not kept & {900, 901}
    newest = {}
    for r in sorted(left):
        newest[r[1]] = r
    left = sorted(newest.values())
    first = {i for i, _, c in groups([r[:2] for r in left]) if i == c}
    left = [r for r in left if r[0] in first]
    plan = {r.doc_id: r.copies for r in mixing.mix(make(left)).collect()}
    want = Counter()
    for i, text, *_ in left:
        ids = bpe.encoder(bpe.VOCABULARY)([text])[0]
        want[(i, len(ids) // 4, ids, hashlib.sha256(text.encode()).hexdigest())] += plan[i]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in got) == +want
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name


def test_stages_are_the_operators():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "mixing", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert exact_dedup.SHARE == 1000
