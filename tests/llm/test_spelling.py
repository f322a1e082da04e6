import random

import numpy as np
import pytest

from tests.llm import brute
from usagelens.llm import spelling as sp

SF = "/root/testdata/sf0.001"


def as_dict(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def words(spark, n):
    return spark.createDataFrame([(w, c, "x") for w, c in n.items()], "word string, n bigint, form string")


def test_documents(spark):
    docs = [(d["doc_id"], d["text"]) for d in brute.rows(spark, SF, "documents")]
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute.corpus_words(docs)
    counted = sp.corpus_words(df)
    assert {r.word: r.n for r in counted.collect()} == want and len(want) > 100
    assert as_dict(sp.spelling_variants(counted)) == brute.spelling_variants(want)


@pytest.mark.parametrize("block", [512, 7])
def test_against_all_pairs(spark, monkeypatch, block):
    """Dense neighbourhoods over two letters (many equal halves), with hot tiles cut into blocks."""
    monkeypatch.setattr(sp, "BLOCK", block)
    rng = random.Random(block)
    pool = {"".join(rng.choices("ab", k=rng.randrange(1, 9))) for _ in range(150)}
    pool |= {"longsharedprefix" + "".join(rng.choices("xyé", k=rng.randrange(0, 4))) for _ in range(60)}
    pool |= {"".join(rng.choices("xyü", k=rng.randrange(0, 4))) + "longsharedending" for _ in range(60)}
    n = {w: rng.choice([1, 1, 2, 5, 10, 50, 50, 250, 1250]) for w in sorted(pool)}
    assert as_dict(sp.spelling_variants(words(spark, n))) == brute.spelling_variants(n)


def test_edge_cases(spark):
    long = "lang" * 1500
    n = {"abcdef": 100, "abcdefg": 20, "abcdeg": 4, "zbcdeg": 1, long: 500, long[1:]: 3, long[:3000] + "x" + long[3000:]: 7, "alone": 3, "": 9}
    assert as_dict(sp.spelling_variants(words(spark, n))) == brute.spelling_variants(n)
    assert as_dict(sp.spelling_variants(words(spark, {"w": 1}).where("n > 1"))) == {}
    assert as_dict(sp.spelling_variants(spark.createDataFrame([(None, 3), ("abcabc", 1)], "word string, n bigint"))) == {
        "abcabc": (None, "abcabc", 1, 0, None)}
    with pytest.raises(ValueError):
        sp.spelling_variants(words(spark, n), ratio=1)


def test_words_of_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(sp, "_HELD", 3)
    docs = [(None, "Wörter wörter WÖRTER Ünder"), (1, None), (1, ""), (5, "Striking " * 5000), (5, "striking×÷ striking"), (5, "striking×÷ striking")]
    docs += [(i, f"remarkable{chr(192 + i % 60)} occasion Occasion") for i in range(400)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, word int")
    for kw in ({}, {"every": 3}, {"min_length": 1, "min_count": 1}):
        mine = {{"every": "slip_every"}.get(k, k): v for k, v in kw.items()}
        assert {r.word: r.n for r in sp.corpus_words(df, **mine).collect()} == brute.corpus_words(docs, **kw)
    assert sp.corpus_words(df.limit(0)).count() == 0


def test_long_words_pair_by_pair(monkeypatch):
    rng = random.Random(2)
    pool = sorted({"".join(rng.choices("ab", k=rng.choice([6, 7]))) for _ in range(60)})
    args = pool, np.zeros(len(pool), int), np.zeros(len(pool), int), np.full(len(pool), 6), np.zeros(len(pool), bool)
    dense = {tuple(p) for p in sp.near_in_tiles(*args).tolist()}
    monkeypatch.setattr(sp, "_WIDE", 1)
    assert dense and {tuple(p) for p in sp.near_in_tiles(*args).tolist()} == dense
