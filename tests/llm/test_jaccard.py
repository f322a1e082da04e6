import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from usagelens.llm import jaccard as jc

SCHEMA = "doc_id bigint, text string"


def found(df, **kw):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id is None, r.component_id or 0)
                  for r in jc.jaccard_groups(df, **kw).collect())


def wanted(docs, **kw):
    return sorted((i is None, i or 0, n, c is None, c or 0) for i, n, c in brute.jaccard_groups(docs, **kw))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10 ** 6)}"
    return words


def corpus(seed, n=160):
    """Bases, copies with few and many edits, shared passages, texts that are mostly one passage."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=60)
    bases = [rng.choices(vocab, k=rng.choice([1, 3, 4, 5, 6, 9, 20, 60, 120])) for _ in range(12)]
    docs = []
    for i in range(n):
        words = edited(rng, rng.choice(bases), rng.choice([0, 0, 1, 1, 2, 3, 8]))
        kind = rng.random()
        if kind < 0.2:
            words = passage + words[:rng.randrange(1, 14)]
        elif kind < 0.4:
            words = words + passage
        docs.append((i * 7 % 1000, " ".join(words)))
    return docs


@pytest.mark.parametrize("seed,percent,words", [(1, 80, 5), (2, 80, 5), (3, 60, 3), (4, 95, 5), (5, 30, 2)])
def test_against_all_pairs(spark, seed, percent, words):
    docs = corpus(seed)
    assert found(spark.createDataFrame(docs, SCHEMA), percent=percent, words=words) == wanted(docs, percent=percent, k=words)


def test_near_copies_in_small_pieces(spark, monkeypatch):
    """One group of near copies at and around the threshold; lists are dealt in pieces of four."""
    monkeypatch.setattr(jc, "PIECE", 4)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    docs = [(i, " ".join(edited(rng, base, rng.choice([0, 1, 1, 2, 2, 3])))) for i in range(150)]
    want = wanted(docs)
    assert len({c for *_, c in want}) > 5
    assert found(spark.createDataFrame(docs, SCHEMA)) == want


def test_threshold_is_inclusive(spark):
    # 9 shared of 11 shingles in all: 81 %; 8 of 10: exactly 80 %; 7 of 9: less.
    rows = []
    for k, shared in enumerate((9, 8, 7)):
        core = [f"g{k}x{i}" for i in range(shared + 4)]
        rows += [(10 * k, " ".join([*core, "p"])), (10 * k + 1, " ".join(["q", *core]))]
    assert found(spark.createDataFrame(rows, SCHEMA)) == wanted(rows)
    assert [c for *_, c in wanted(rows)] == [0, 0, 10, 10, 20, 21]


def test_edge_cases(spark):
    docs = [(None, "a b c d e f"), (7, "A b  c d e f"), (7, "a b c d e f"), (3, None), (4, ""), (5, " \t\n"), (9, "x " * 30000), (2, "x x x x x x"),
            (None, "alone with no id here at all"), (11, "two words"), (8, "Two words"), (12, "é É"), (13, "É É")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], SCHEMA + ", component_id string, n int, t int")
    assert found(df) == wanted(docs)
    assert jc.jaccard_groups(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jc.jaccard_groups(df, percent=0)


def test_a_third_of_all_rows_in_one_group(spark):
    df = spark.range(900).select("id", F.expr("""CASE WHEN id % 3 = 0 THEN concat('the very same long text in all of these rows it is ', id % 9)
        ELSE concat_ws(' ', transform(sequence(1, 40), i -> cast(xxhash64(id, i) AS string))) END""").alias("text"))
    got = jc.jaccard_groups(df, id_col="id").collect()
    assert len(got) == 900 and len({r.component_id for r in got}) == 601


def test_sketch_is_a_lower_bound():
    rng = random.Random(4)
    import numpy as np

    for _ in range(50):
        a = np.array(rng.sample(range(-10 ** 9, 10 ** 9), 80), dtype=np.int64) * 7919
        b = np.concatenate([a[:rng.randrange(80)], np.array(rng.sample(range(10 ** 9), 20), dtype=np.int64) * 104729])
        flips = sum((x ^ y) % (1 << 64) and ((x ^ y) % (1 << 64)).bit_count() for x, y in zip(jc.sketch(a), jc.sketch(b)))
        assert flips <= len(set(a.tolist()) ^ set(b.tolist()))


def test_whole_texts_and_sets_cross_one_shuffle(spark, monkeypatch):
    """Texts are not joined by their ids, nor whole sets to find repeated rows: copies meet where they are grouped."""
    plans, kept = {}, jc.stored

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return kept(df, name)

    monkeypatch.setattr(jc, "stored", noted)
    docs = corpus(6, 60)
    docs += docs[:20] + [(i + 5000, t) for i, t in docs[:20]]
    assert found(spark.createDataFrame(docs, SCHEMA)) == wanted(docs)
    for name in ("jaccard-sets", "jaccard-ordered"):
        assert "LeftSemi" not in plans[name], name
