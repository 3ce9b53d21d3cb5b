"""Rows that share an id, and foreign columns with any name that an operator uses itself."""

import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runledger.llm import common, exact_dedup, jaccard, language, mixing, outliers, resampling

OWN = {"doc_id", "text", "lang", "source", "n_chars"}
KEEPING = {
    "drop_duplicates": (exact_dedup, exact_dedup.drop_duplicates),
    "take_mix": (mixing, lambda docs: mixing.take_mix(docs, percent=100, rounds=1)),
    "drop_near_duplicates": (jaccard, jaccard.drop_near_duplicates),
    "keep_identified": (language, language.keep_identified),
    "draw": (resampling, lambda docs: resampling.draw(docs, docs, percent=100, least=0)),
    "keep_ordinary": (outliers, outliers.keep_ordinary),
}


def names_in(module):
    """Every word between quotes in a module and in the helpers that all use: column names among them."""
    found = set()
    for m in (module, common):
        found |= set(re.findall(r"""["'`]\b(_?[a-z][a-z0-9_]*)\b["'`]""", Path(m.__file__).read_text()))
        found |= set(re.findall(r"alias\(\"(\w+)\"\)", Path(m.__file__).read_text()))
    return sorted(found - OWN)


@pytest.mark.parametrize("name", sorted(KEEPING))
def test_foreign_columns_come_back_whatever_their_names(spark, name):
    module, keep = KEEPING[name]
    extra = names_in(module)
    assert len(extra) > 10
    sentence = "the quick brown fox and the lazy dog went over a long bridge in the early morning of a day with word{n} and word{m}."
    rows = [(n, sentence.format(n=n, m=n * 7), "en", "a") for n in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.select("*", *[F.concat_ws("-", F.lit(c), "doc_id").alias(c) for c in extra])
    got = keep(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert kept and all(r[c] == f"{c}-{r.doc_id}" for r in kept for c in extra)


def test_near_copies_that_share_their_id_are_told_apart(make):
    base = " ".join(f"w{n}" for n in range(40))
    other = " ".join(f"v{n}" for n in range(40))
    docs = make([(1, base), (7, base + " end"), (7, other), (8, other + " end"), (9, "alone"), (9, "alone"), (None, base), (7, None)])
    got = Counter((r.doc_id, r.text) for r in jaccard.drop_near_duplicates(docs).collect())
    assert got == Counter([(1, base), (7, other), (9, "alone"), (9, "alone"), (None, base), (7, None)])


def test_of_near_copies_with_one_id_one_stays(make):
    base = " ".join(f"w{n}" for n in range(40))
    got = jaccard.drop_near_duplicates(make([(3, base), (3, base + " x"), (3, base + " y")])).collect()
    assert len(got) == 1


@pytest.mark.parametrize("rows", [1, 2, 7, 50])
def test_rows_alike_share_what_the_mix_takes(make, rows):
    random.seed(rows)
    docs = [(None, "a b c", None, "s")] * rows + [(None, "c b a", None, "s")] + [(5, "x y", None, None)] * 3 + [(5, "y x", None, None)]
    docs += [(100 + n, "w " * random.randint(1, 9), None, random.choice(["s", "t"])) for n in range(30)]
    table = make(docs)
    plan = Counter()
    for r in mixing.mix(table).collect():
        plan[r.doc_id, r.source, r.size] += r.copies
    got = mixing.take_mix(table)
    taken = Counter((r.doc_id, r.source, len(r.text.split())) for r in got.collect())
    assert got.columns == table.columns and taken == +plan
    again = Counter((r.doc_id, r.source, r.text) for r in mixing.take_mix(table).collect())
    assert again == Counter((r.doc_id, r.source, r.text) for r in got.collect())


def test_stages_take_tables_with_nulls_everywhere(spark, make, empty):
    awkward = make([(None, None, None, None), (None, "", None, None), (1, " ", None, "s"), (1, " ", None, "s"), (2, "é" * 3000, "en", None)])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
        stage(spark, awkward, "").collect()
