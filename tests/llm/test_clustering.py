import random

import numpy as np
import pytest

from tests.llm import brute
from usagelens.llm import clustering as cl

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>"


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def check(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", cluster string, v int")
    got = [tuple(r) for r in cl.cluster(df, **kw).collect()]
    stored = [(r.vec_id, r.embedding) for r in df.collect()]   # components as floats
    assert sorted(got, key=key) == sorted(brute.kmeans(stored, **{a: b for a, b in kw.items()}), key=key)
    return got


def test_embeddings(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute.kmeans([(r.vec_id, r.embedding) for r in df.collect()])
    assert sorted(map(tuple, cl.cluster(df).collect())) == sorted(want)


@pytest.mark.parametrize("block", [256, 5])
def test_tight_groups_with_ties(spark, monkeypatch, block):
    """Few distinct values in three dimensions: ties and repeated rows everywhere, boxes that prune."""
    monkeypatch.setattr(cl, "BLOCK", block)
    rng = random.Random(block)
    rows = [(i, [rng.choice([-1.0, 0.0, 3.0]) + rng.choice([0.0, 0.01]) for _ in range(3)]) for i in range(400)]
    rows += [(900, [0.5, 0.5, 0.5])] * 200
    check(spark, rows, dim=3, k=12, rounds=4, scale=100)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, 2.0, 3.0]), (6, [nan, 1.0]), (7, [1.0, inf]), (8, [None, 1.0]),
            (None, [5.0, 5.0]), (9, [-0.3, -1e-9]), (9, [-0.3, -1e-9])]
    assert len(check(spark, rows, dim=2, k=3, rounds=2)) == 4
    assert len(check(spark, rows, dim=2, k=40, rounds=0)) == 4
    assert check(spark, rows[1:4], dim=2, k=3) == []
    assert check(spark, [(1, [0.0, 0.0])], dim=2) and check(spark, [], dim=2) == []
    big = [(1, [3e38, -3e38]), (2, [1e30, 0.0]), (3, [200000.0, -200000.0]), (4, [-262000.0, 262000.0])]
    got = cl.cluster(spark.createDataFrame(big, SCHEMA), dim=2, k=2, rounds=3).collect()
    assert len(got) == 4 and all(r.distance >= 0 for r in got)


def test_bounds_lose_no_centroid():
    rng = np.random.default_rng(3)
    for _ in range(200):
        v = rng.integers(-50, 50, (20, 6)) // rng.integers(1, 20) + rng.integers(-60, 60, 6)
        cents = rng.integers(-80, 80, (15, 6))
        maybe = cl.candidates(v.min(axis=0), v.max(axis=0), cents)
        whole, dist = cl.nearest(v, cents)
        some, less = cl.nearest(v, cents[maybe])
        assert (maybe[some] == whole).all() and (dist == less).all()
        wide, far = cl.nearest(v * (1 << 21), cents * (1 << 21))
        assert (wide == whole).all() and (far == dist * (1 << 42)).all()


def test_hilbert_order_visits_neighbours():
    """Along the curve, consecutive cells differ by one step in one dimension, and every cell occurs once."""
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(np.ndindex(*[1 << bits] * d)))
        keys = cl.hilbert_keys(cells, bits)
        path = cells[np.argsort(np.array(keys, dtype=object))]
        assert len(set(keys)) == len(cells) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_boxes_prune_grouped_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [10.0 * ((i % 8) >> b & 1) + rng.random() for b in range(8)]) for i in range(4000)]
    ints = cl.whole_vectors(spark.createDataFrame(rows, SCHEMA), dim=8)
    blocks = cl.hilbert_blocks(ints, 8, block=64)
    assert cl.candidate_share(blocks, cl.start(ints, 40, dim=8), 8) < 0.6
