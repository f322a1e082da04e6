import random

from tests.llm import brute
from usagelens.llm import pii
from usagelens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ALPHABET = ["a", "B", "7", "12", "255", "256", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 010-9999", "+", "(", ")", "-", ".", " ",
            "@", "x@y.z", "%", "_", "é", "😀", "\n", "10.0.0.1", "1.2.3.4.5.6.7.8", "a@b@c.d", "00001.2.3.004", "[at]"]


def fuzz(n):
    rng = random.Random(5)
    return [(i, "".join(rng.choices(ALPHABET, k=rng.randint(0, 40)))) for i in range(n)]


def base_of(df):
    return [(r.doc_id, [tuple(s) for s in r.base]) for r in df.collect()]


def test_query_matches_brute_force(spark):
    docs = brute.rows(spark, SF, "documents")
    got = {r.doc_id: r for r in QUERIES["op5_pii"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        want, r = brute.base_spans(d["text"]), got[d["doc_id"]]
        assert r.base_sha256 == brute.sha(brute.written(want))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in want) for i in range(4))
        assert set(brute.written(want).split(",")) - {""} <= set(r.spans.split(","))
    assert any(r.spans for r in got.values())


def test_rules_on_hostile_texts(spark):
    docs = fuzz(400) + [(1000, "9" * 30000), (1001, "a" * 30000 + "@"), (1002, "+1" * 5000), (1003, "1." * 5000), (1004, "1 " * 9 + "x" * 20000)]
    got = dict(base_of(pii.find_pii(spark.createDataFrame(docs, "doc_id bigint, text string"))))
    assert got == {i: brute.base_spans(t) for i, t in docs}


ROWS = [(1, "mail me: joe.x+y@mail.example.com or +1 (555) 010-9999."), (1, "mail me: joe.x+y@mail.example.com or +1 (555) 010-9999."),
        (2, None), (3, ""), (None, "ip 10.0.0.1, 10.0.0.256"), (4, "é😀 4111 1111 1111 1111 é"), (5, "nothing here, 12 34"),
        (6, "phone: 555-010-9999 or joe [at] mail.example.com")]


def test_edge_cases_and_redaction(spark):
    df = spark.createDataFrame([(*r, 1, "k") for r in ROWS], "doc_id bigint, text string, row int, `key` string")
    assert sorted(base_of(pii.find_pii(df)), key=str) == sorted([(i, brute.base_spans(t)) for i, t in ROWS], key=str)
    done = pii.redact(df)
    assert done.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in done.collect() if r.doc_id != 6), key=str)
    assert got == sorted([(1, "mail me: [EMAIL] or [PHONE]."), (1, "mail me: [EMAIL] or [PHONE]."), (2, None), (3, ""),
                          (None, "ip [IP], 10.0.0.256"), (4, "é😀 [CARD] é"), (5, "nothing here, 12 34")], key=str)
    assert pii.find_pii(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0


def test_boosting_adds_loose_spans_only_beside_base(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        num = lambda n: "".join(rng.choices("0123456789", k=n))
        rows.append((i, f"call +1 ({num(3)}) 555-{num(4)} now, card {num(16)} and ip {rng.randint(0, 400)}.2.3.4 or j{num(2)}@mail.example.com"))
    rows.append((1000, "write to joe [at] mail.example.com please, or ip 10[.]20[.]30[.]40"))
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [tuple(s) for s in got[1000].base] == []
    assert {tuple(s) for s in got[1000].spans} == {(9, 0, 34), (49, 1, 66)}
    for i, t in rows[:400]:
        assert [tuple(s) for s in got[i].base] == brute.base_spans(t)


LOOSE = [(1000, "write to joe [at] mail.example.com please"), (1001, "ip 10[dot]20[dot]30[dot]40"),
         (1002, "ip 10[dot]20[dot]30[dot]400 or joe [at] 12"), (1003, "card 4111/1111/1111/1111 here"),
         (1004, "version 10[dot]20[dot]30[dot]40, order 555-010-9999, serial 4111/1111/1111/1111"), (1005, "call 555-010-9999 now")]
CLEAN = [(1000, "write to [EMAIL] please"), (1001, "ip [IP]"), LOOSE[2], (1003, "card [CARD] here"), LOOSE[4], (1005, "call [PHONE] now")]


def test_one_rule_at_every_size(spark):
    def redacted(rows):
        return sorted((r.doc_id, r.text) for r in pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).where("doc_id >= 1000").collect())
    assert redacted(LOOSE) == CLEAN                                                    # no rule match at all
    assert redacted(LOOSE + [(i, f"a{i}@mail.example.com") for i in range(5)]) == CLEAN   # few of one kind, none of the others
    rules = [(i, f"a{i}@mail.example.com at 10.0.0.{i} or 10.0.0.{i + 200}, +1 (555) 010-{1000 + i}, 4111 1111 1111 {1000 + i}") for i in range(400)]
    for n in (20, 400):
        assert redacted(LOOSE + rules[:n]) == CLEAN


def luhn_end(digits):
    """``digits`` and the one that makes them pass."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return digits + str(-total % 10)


def planted(rng, kind, right):
    """A span in a spelling of its own and a text around it, not those the operator is taught with."""
    num = lambda n: "".join(rng.choices("123456789", k=n))
    word = lambda: "".join(rng.choices("abcdefghklmnoprstu", k=rng.randint(4, 8)))
    at, dot, sep = rng.choice([" [at] ", "(at)", " {at} "]), rng.choice([".", "[dot]", " (dot) "]), rng.choice("./_")
    if kind == 0:
        span = f"{word()}{at}{word()}{dot}{word()}{dot}" + (rng.choice(["com", "org", "net"]) if right else num(2))
    elif kind == 1:
        hide = rng.choice(["[.]", "(.)", "[dot]"])
        span = hide.join(str(rng.randint(1, 255)) for _ in range(3)) + hide + str(rng.randint(1, 255) if right else rng.randint(256, 999))
    elif kind == 2:
        n = luhn_end(num(15))
        n = n if right else n[:-1] + str((int(n[-1]) + rng.randint(1, 9)) % 10)
        span = sep.join(n[i:i + 4] for i in range(0, 16, 4))
    else:
        span = rng.choice([f"(0{num(3)}) {num(4)} {num(4)}", f"00 {num(2)} {num(3)} {num(4)}", f"0{num(3)}-{num(3)}-{num(4)}"]) if right \
            else f"{num(4)}-{num(2)}-{num(2)}"
    before = rng.choice(["", f"{word()} {word()} ", f"{word()}, "]) + rng.choice(["", pii.CUES[kind].split("|")[0] + " ", "is "])
    return before, span, rng.choice(["", f" {word()}", f", {word()} {word()}."])


def test_added_spans_on_planted_texts(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for i in range(800):
        kind, right = i % 4, i % 8 < 4
        before, span, after = planted(rng, kind, right)
        rows.append((i, before + span + after))
        want[i] = {(len(before), kind, len(before) + len(span))} if right else set()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: {tuple(s) for s in r.spans} for r in pii.find_pii(docs).collect()}
    for kind in range(4):
        ids = [i for i in want if i % 4 == kind]
        hits, wanted, found = (sum(len(x) for x in xs) for xs in (
            [got[i] & want[i] for i in ids], [want[i] for i in ids], [got[i] for i in ids]))
        assert hits >= 0.9 * wanted and hits >= 0.95 * found, (kind, hits, wanted, found)


def test_threshold_selection_by_brute_force(spark):
    """Added spans are the loose candidates whose trees reach the threshold, less those that overlap others."""
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(pii.examples())], "doc_id bigint, text string")
    cands = pii.stored(pii.candidates(df), "pii-test")
    trees, thresholds = pii.train(cands)
    assert sorted(thresholds) == [0, 1, 2, 3]
    rows = [r for r in cands.collect() if r.kind >= 0]
    got = {r.doc_id: {tuple(s) for s in r.spans} for r in pii.find_pii(df).collect()}
    for i in got:
        spans = sorted((r.start, r.kind, r.end) for r in rows if r.id == i and r.base and r.accepted)
        for r in sorted((r for r in rows if r.id == i and not r.base), key=lambda r: (r.start, r.end, r.kind)):
            x = pii.np.array([[r.features >> b & 1 for b in range(len(pii.FEATURES))]], dtype=bool)
            if pii._raw(x, trees)[0] >= thresholds[r.kind] and all(e <= r.start or r.end <= s for s, _, e in spans):
                spans.append((r.start, r.kind, r.end))
        assert got[i] == set(spans)


def test_a_kind_that_is_wrong_too_often_adds_nothing(spark, monkeypatch):
    wrong = [(t, k, False, held) if k == 1 else (t, k, good, held) for t, k, good, held in pii.examples()]
    monkeypatch.setattr(pii, "examples", lambda: wrong)
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert sorted(pii.train(pii.candidates(none))[1]) == [0, 2, 3]


def test_main_path_is_native(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    plan = pii.candidates(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
