import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from usagelens.llm import simhash as sh
from usagelens.llm.components import components

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_fingerprint_matches_definition():
    texts = [None, "", "  \t\n", "one", "One two", "a b c", "a b c a b c a b c", "é É ß x", "x" * 1000, " lead  and\ttrail "]
    texts += [" ".join(random.Random(i).choices("ab cd ef gh Ij".split(), k=i)) for i in range(1, 60, 7)]
    assert [sh.simhash(t) for t in texts] == [brute.simhash(t) for t in texts]


def test_long_text_in_steps(monkeypatch):
    text = " ".join(str(i % 97) for i in range(5000))
    whole = sh.simhash(text)
    monkeypatch.setattr(sh, "_STEP", 64)
    assert sh.simhash(text) == whole == brute.simhash(text)


def test_groups_on_documents(spark):
    docs = brute.rows(spark, SF, "documents")
    pairs = [(d["doc_id"], brute.simhash(d["text"])) for d in docs]
    want = {i: (f"{f:016x}", c) for (i, f), c in zip(pairs, brute.components(pairs))}
    got = sh.simhash_groups(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_links_lose_nothing(spark, bits):
    rng = random.Random(bits)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for f in list(prints)[:60]:
        for n in range(1, 6):
            prints.add(f ^ sum(1 << b for b in rng.sample(range(64), n)))
    arr = np.array(sorted(prints), dtype=np.uint64)
    want = {(signed(int(a)), signed(int(b))) for i, a in enumerate(arr) for b in arr[:i][np.bitwise_count(arr[:i] ^ a) <= bits]}
    want = {(max(p), min(p)) for p in want}
    df = spark.createDataFrame([(signed(f),) for f in prints], "fp bigint")
    got = [tuple(r) for r in sh.links(df, bits).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_long_chain_and_repeats(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(5, 5), (100, 101), (101, 100), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_edge_cases(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (3, None), (4, ""), (9, "x " * 3000), (None, "lonely text here now")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, fingerprint string, component_id int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id is None, r.component_id or 0) for r in sh.simhash_groups(df).collect())
    assert got == [(False, 3, False, 3), (False, 4, False, 3), (False, 7, False, 7), (False, 7, False, 7), (False, 9, False, 9),
                   (True, 0, False, 7), (True, 0, True, 0)]
    kept = sh.simhash_dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 7, 9]
    assert sh.simhash_groups(df.limit(0)).count() == 0 and sh.simhash_dedup(df.limit(0)).count() == 0


def test_a_third_of_all_rows_in_one_group(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same words in all of these")
                                 .otherwise(F.concat_ws(" ", *[F.xxhash64("id", F.lit(i)).cast("string") for i in range(30)])).alias("text"))
    assert sh.simhash_dedup(df).count() == 201
