import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

from tests.llm import brute
from usagelens.llm import bpe
from usagelens.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tiktoken():
    return brute.encoding(PATH, P.PATTERN)


def ids_of(b):
    return np.frombuffer(b, dtype="<u4").tolist()


def test_query_matches_the_library(spark, tiktoken):
    got = {r.doc_id: r for r in QUERIES["op6_byte_bpe"](spark, SF).collect()}
    docs = brute.rows(spark, SF, "documents")
    assert len(got) == len(docs)
    for d in docs:
        want = tiktoken.encode_ordinary(d["text"] or "")
        r = got[d["doc_id"]]
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_edge_cases(spark, tiktoken):
    rng = random.Random(3)
    texts = [None, "", " ", "\n\n  x", "a" * 5000, "<|endoftext|>", "naïve café 😀👩‍👩‍👧 ñ", "it's we'll I'D", "12345 ٣٤ ½", "  x", "\x00\x7f"]
    texts += ["".join(rng.choices("ab e\n'éß中😀1.", k=200)) for _ in range(20)]
    rows = [(i, t, "x", b"y") for i, t in enumerate(texts)] + [(None, "again", "x", b"y")] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, token_ids string, decoded binary")
    vocab = vocabulary(spark)
    got = bpe.tokenize(df, vocab, bpe.frequent_words(df, "text", vocab)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "again" if r.doc_id is None else texts[r.doc_id] or ""
        assert ids_of(r.token_ids) == tiktoken.encode_ordinary(text) and r.n_tokens == len(ids_of(r.token_ids))
        assert bytes(r.decoded) == text.encode()
    assert bpe.tokenize(df.limit(0), vocab).count() == 0 and bpe.frequent_words(df.limit(0), "text", vocab) == {}


def test_words_are_counted_over_all_whole_texts(spark, monkeypatch):
    vocab = vocabulary(spark)
    # the word of the far end of a long text, and of the last of many texts, counts like any other
    texts = ["a " * 30_000 + "farend farend", None, "", *["plain words"] * 600, "farend"]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, n int").repartition(5)
    want = brute.word_counts(texts, P.PATTERN)
    for cache in (bpe.CACHE_WORDS, 2):
        monkeypatch.setattr(bpe, "CACHE_WORDS", cache)
        assert {r.word: r.n for r in bpe.count_words(df, "text", P.PATTERN).collect()} == want
    top = sorted(want, key=lambda w: (-want[w], w.encode()))
    assert " farend" in top[:4] and set(bpe.frequent_words(df, "text", vocab, 4)) == set(top[:4])


def test_higher_order_fold(spark, tiktoken):
    rng = random.Random(4)
    words = {"".join(rng.choices("abcdehinorstu", k=rng.randint(1, 14))) for _ in range(60)} | {" the", "é", "ñandú", "中文", " 12", "...", "", "x" * 40}
    df = spark.createDataFrame([(w, 1) for w in words] + [(None, 2), (" the", 3)], "word string, ids int")
    got = {r.word: r.ids for r in bpe.encode_words(df, "word", vocabulary(spark)).collect()}
    # single words: the library may split them further, so compare by the merge rule
    ranks = vocabulary(spark).ranks
    merges = bpe._merges(ranks)
    assert got == {w: bpe._merge_word([ranks[bytes([b])] for b in w.encode()], merges) for w in words}


def test_long_and_short_merges_agree():
    ranks = brute.encoding(PATH, P.PATTERN)._mergeable_ranks
    merges, rng = bpe._merges(ranks), random.Random(5)
    for _ in range(200):
        ids = [ranks[bytes([b])] for b in "".join(rng.choices("abcdehinorstué ", k=rng.randint(1, 60))).encode()]
        assert bpe._merge_long(list(ids), merges) == bpe._merge_word(list(ids), merges) or len(ids) > 64
