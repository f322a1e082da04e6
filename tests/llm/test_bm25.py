import random

import pytest

from tests.llm import brute
from usagelens.llm import bm25
from usagelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def as_dict(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.doc_id, r.score))
    return out


def same(got, want):
    assert got.keys() == {q for q, found in want.items() if found}
    for q, found in got.items():
        assert [s for _, s in found] == pytest.approx([s for _, s in want[q]], abs=1e-8)
        assert [i for i, _ in found] == [i for i, _ in want[q]]


def test_query_matches_brute_force(spark):
    docs = [(d["doc_id"], d["text"]) for d in brute.rows(spark, SF, "documents")]
    same(as_dict(QUERIES["op2_bm25_topk"](spark, SF).collect()), brute.bm25(docs, [d for d in docs if d[0] % 50 == 0]))


@pytest.mark.parametrize("dense", [2, 256])
def test_pruned_search_is_exact(spark, monkeypatch, dense):
    monkeypatch.setattr(bm25, "DENSE", dense)
    monkeypatch.setattr(bm25, "SHARD", 60)
    monkeypatch.setattr(bm25, "BLOCK", 8)
    rng = random.Random(dense)
    vocab = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    docs = [(i, " ".join(rng.choices(vocab, weights, k=rng.randint(1, 60)))) for i in range(400)]
    docs += [(400 + i, docs[7][1]) for i in range(30)]
    queries = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 12)))) for i in range(25)] + [(100, docs[7][1])]
    got = bm25.search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2),
                      spark.createDataFrame(queries, "doc_id bigint, text string"), k=5).collect()
    same(as_dict(got), brute.bm25(docs, queries, k=5))


def test_edge_cases(spark, monkeypatch):
    docs = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "a a a"), (4, "c " * 3000), (5, "!!")]
    df = spark.createDataFrame([(*d, 0.5, 3) for d in docs], "doc_id bigint, text string, score double, rank int")
    queries = spark.createDataFrame([(9, "A zzz"), (9, "c"), (8, None), (None, "a"), (7, "zzz")], "doc_id bigint, text string")
    got = as_dict(bm25.search(df, queries).collect())
    same(got, brute.bm25(docs, [(9, "A zzz"), (9, "c"), (7, "zzz")]))
    monkeypatch.setattr(bm25, "QUERY_BYTES", 60)  # several query blocks
    assert as_dict(bm25.search(df, queries).collect()) == got
    assert bm25.search(df.limit(0), queries).count() == 0 and bm25.search(df, queries.limit(0)).count() == 0


def test_bounds_pass_over_documents():
    """Long and short texts of two topics: most blocks of the other topic are never scored, and nothing is lost."""
    import numpy as np

    rng = random.Random(3)
    vocab = {f"{topic}{i}": 40 * topic_no + i for topic_no, topic in enumerate("ab") for i in range(40)}
    docs = [(i, rng.choices([w for w in vocab if w[0] == ("a" if rng.random() < 0.1 else "b")], k=rng.choice([5, 40]))) for i in range(4000)]
    df = {w: sum(w in ws for _, ws in docs) for w in vocab}
    idf = np.log(1 + (len(docs) - np.array(list(df.values())) + 0.5) / (np.array(list(df.values())) + 0.5))
    mean = sum(len(ws) for _, ws in docs) / len(docs)
    query = np.array([vocab[w] for w in ("a1", "a2", "a3", "b1")], dtype=np.int32)
    block = bm25.QueryBlock([1], [query], vocab, idf, mean)
    counts = [{w: ws.count(w) for w in ws} for _, ws in docs]
    shard = bm25.Shard(block, [i for i, _ in docs], [np.full(len(c), n, dtype=np.int32) for n, c in enumerate(counts)],
                       [np.array([vocab[w] for w in c], dtype=np.int32) for c in counts], [np.array(list(c.values())) for c in counts], [len(ws) for _, ws in docs])
    at, score = shard.search(query, 10, 0.0)
    got = sorted(zip((-np.round(score, 9)).tolist(), shard.ids[at].tolist()))[:10]
    want = brute.bm25([(i, " ".join(ws)) for i, ws in docs], [(1, "a1 a2 a3 b1")])[1]
    assert [i for _, i in got] == [i for i, _ in want]
    assert shard.seen == 4000 and shard.scored < 1000


def block_and_shard(n_docs, n_queries, seed=5):
    """Texts over one vocabulary without any order, whole texts as queries."""
    import numpy as np

    rng = np.random.default_rng(seed)
    weights = 1 / np.arange(1, 3001)
    texts = [rng.choice(3000, rng.integers(50, 400), p=weights / weights.sum()) for _ in range(n_docs)]
    df = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=3000)
    idf, mean = np.log(1 + (n_docs - df + 0.5) / (df + 0.5)), sum(map(len, texts)) / n_docs
    queries = [np.unique(t).astype(np.int32) for t in texts[:n_queries]]
    block = bm25.QueryBlock(np.arange(n_queries), queries, range(3000), idf, mean)
    counted = [np.unique(t, return_counts=True) for t in texts]
    shard = bm25.Shard(block, range(n_docs), [np.full(len(w), i, dtype=np.int32) for i, (w, _) in enumerate(counted)],
                       [w.astype(np.int32) for w, _ in counted], [c.astype(np.int32) for _, c in counted], [len(t) for t in texts])
    return block, shard, texts


def test_whole_texts_as_queries_score_few_documents():
    """Bounds are those of single documents, so hardly more than the k best are scored in full, and these are exact."""
    import numpy as np

    block, shard, texts = block_and_shard(2000, 40)
    best = {i: sorted(zip((-np.round(s, 9)).tolist(), shard.ids[at].tolist()))[:10]
            for i, at, s in shard.search_all(block.terms, 10, np.zeros(40))}
    want = brute.bm25([(i, " ".join(f"w{w}" for w in t)) for i, t in enumerate(texts)],
                      [(i, " ".join(f"w{w}" for w in t)) for i, t in enumerate(texts[:40])])
    same({i: [(d, -s) for s, d in found] for i, found in best.items()}, want)
    assert shard.scored < 0.02 * shard.seen
    before = shard.scored
    assert not list(shard.search_all(block.terms, 10, np.full(40, 1e6))) and shard.scored == before  # a bar out of reach


def test_a_query_has_one_answer_alone_and_among_others():
    import numpy as np

    block, shard, _ = block_and_shard(300, 30)
    bars = np.linspace(0, 60, 30)
    together = {i: (at.tolist(), s.tolist()) for i, at, s in shard.search_all(block.terms, 3, bars)}
    alone = {i: shard.search(block.terms[i], 3, bars[i]) for i in range(30)}
    assert {i: (np.sort(at).tolist(), np.sort(s).tolist()) for i, (at, s) in alone.items() if len(at)} == {
        i: (sorted(at), sorted(s)) for i, (at, s) in together.items()}


def test_texts_are_read_once_for_many_queries(spark, monkeypatch):
    """A block counts what its queries take, places of four bytes, not the length of their words."""
    monkeypatch.setattr(bm25, "QUERY_BYTES", 30000)
    queries = spark.createDataFrame([(i, [f"some longer word {(i + j) % 90}" for j in range(60)]) for i in range(50)], "query_id bigint, terms array<string>")
    df = spark.createDataFrame([(f"some longer word {j}", 1 + j) for j in range(80)], "term string, n bigint")
    blocks = list(bm25._blocks(queries, df, 100, 60.0))
    assert len(blocks) == 1 and sorted(blocks[0].ids.tolist()) == list(range(50))
    assert sorted(q for c in blocks[0].chunks for q in c.tolist()) == list(range(50))
    assert sorted(len(t) for t in blocks[0].terms) == sorted(sum((i + j) % 90 < 80 for j in range(60)) for i in range(50))


def test_words_of_one_hash_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = bm25._hash
    monkeypatch.setattr(bm25, "_hash", lambda word, salt: F.length(word).cast("bigint") if salt == 0 else real(word, salt))
    docs = spark.createDataFrame([(1, "aa bb"), (2, "bb cc"), (3, "dd")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(7, "aa"), (8, "zz"), (9, "dd bb")], "doc_id bigint, text string")
    same(as_dict(bm25.search(docs, queries).collect()),
         brute.bm25([(1, "aa bb"), (2, "bb cc"), (3, "dd")], [(7, "aa"), (8, "zz"), (9, "dd bb")]))
