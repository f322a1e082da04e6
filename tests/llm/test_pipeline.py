import corpus_pipeline
from tests.llm import brute
from usagelens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "byte_bpe"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES) and "pipeline" in QUERIES and corpus_pipeline.ORACLE_SQL is None


def test_stages_against_brute_force(spark):
    import hashlib

    import public_tokenizers as P

    docs = brute.rows(spark, SF, "documents")
    docs = [d for d in docs if any(c.isalpha() for c in d["text"] or "")]
    pairs = [(d["doc_id"], brute.simhash(d["text"])) for d in docs]
    docs = [d for d, c in zip(docs, brute.components(pairs)) if d["doc_id"] == c]
    items = [(r["item_id"], r["text"]) for r in brute.rows(spark, SF, "benchmark")]
    hit = {r[0] for r in brute.contamination([(d["doc_id"], d["text"]) for d in docs], items) if r[-1]}
    docs = [d for d in docs if d["doc_id"] not in hit]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == {d["doc_id"] for d in docs} and hit
    tik = brute.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    redacted = 0
    for d in docs:
        decoded = tik.decode_bytes(list(__import__("numpy").frombuffer(got[d["doc_id"]].token_ids, dtype="<u4")))
        assert hashlib.sha256(decoded).hexdigest() == got[d["doc_id"]].decoded_sha256
        if spans := brute.base_spans(d["text"]):
            redacted += 1
            assert not any(d["text"][a:b] in decoded.decode() for a, _, b in spans)
        else:
            assert decoded.decode() == d["text"]
    assert redacted


def test_stages_keep_columns_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
