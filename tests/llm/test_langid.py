from tests.llm import brute
from usagelens.llm import langid
from usagelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {d["doc_id"]: d for d in brute.rows(spark, SF, "documents")}
    got = QUERIES["op7_language_id"](spark, SF).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (brute.fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and docs[r.doc_id]["lang"]]
    right = sum(r.lang_pred == docs[r.doc_id]["lang"] for r in held)
    assert len(held) > 150 and right >= 0.97 * len(held)


def test_presence_and_long_texts(monkeypatch):
    text = "Äpfel und Birnen 123 " * 500
    whole = langid.presence(text)
    monkeypatch.setattr(langid, "_STEP", 50)
    assert (langid.presence(text) == whole).all()
    assert not langid.has_letter("12 .. __") and not langid.has_letter(None) and langid.has_letter("1ñ")


def test_edge_cases(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(20)] + [(i + 20, "der Hund und die Katze", "de") for i in range(20)]
    rows += [(None, "the dog", "en"), (50, None, "en"), (51, "", "de"), (52, "123 !!", "en"), (53, "und der Hund", None), (53, "und der Hund", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, score int")
    model = langid.train(df)
    got = langid.identify(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[50] == by[51] == by[52] == "und" and by[53] == "de" and by[None] == "en" and by[0] == "en"
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert langid.train(df.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_only_letters_have_a_language(spark):
    rows = [(1, "½ ²"), (2, "①②③"), (3, "Ⅷ ⅷ"), (4, "½ ² a"), (5, "Ⅷ字"), (6, "ʰ"), (7, "٣٤"), (8, "_9_")]
    assert [langid.has_letter(t) for _, t in rows] == [False, False, False, True, True, True, False, False]
    train = [(i, "the cat and the dog" if i % 2 else "der Hund und die Katze", "en" if i % 2 else "de") for i in range(100, 140)]
    model = langid.train(spark.createDataFrame(train, "doc_id bigint, text string, lang string"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in langid.identify(df, model).collect() if r.lang_pred == "und"} == {1, 2, 3, 7, 8}
    assert sorted(r.doc_id for r in langid.keep_identified(df, model).collect()) == [4, 5, 6]


def test_every_language_is_learned(spark, monkeypatch):
    """250 languages and a sample that allows 4 texts and 2 landmarks of each."""
    import random

    monkeypatch.setattr(langid, "SAMPLE", 1000)
    monkeypatch.setattr(langid, "LANDMARKS", 500)
    rows = []
    for k in range(250):
        rng = random.Random(k)
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(8)]
        rows += [(k * 100 + i, " ".join(rng.choices(words, k=25)), f"l{k}") for i in range(12 + (k == 0) * 80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(df)
    assert len(model.langs) == 250 and len(model.landmarks) <= 500
    lang = {r[0]: r[2] for r in rows}
    got = [(lang[r.doc_id], r.lang_pred) for r in langid.identify(df, model).collect() if r.held_out]
    assert {p for _, p in got} == {g for g, _ in got} and sum(g == p for g, p in got) >= 0.98 * len(got)
