"""Personal data: candidate gradient boosting. DataFrame functions only.

1. Generators propose spans: one rule per kind whose validated matches are the
   *base* spans, and looser ones for spellings the rules miss. Positions come
   from the lengths of the pieces between matches.
2. Format and context give every candidate a few yes/no features. Spark counts
   the feature patterns of the rule matches by outcome (validated or not), at
   most 2 ** len(FEATURES) patterns whatever the corpus size.
   Rule matches hold no looser spelling and few wrong ones, so worked examples
   (``examples``: looser spellings and decoys in telling contexts) are run
   through the same generators and counted beside them.
3. Boosted depth-two trees are fitted to those counts on the driver, thresholds
   are calibrated on a held-out part, and the trees are applied to all
   candidates as column expressions. Both kinds of evidence weigh the same
   whatever the table's size, so no rule changes with it.
4. Base spans always stay; a looser candidate is added if its score reaches the
   threshold of its kind and it overlaps no base span.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens.llm.common import col, fresh, remainder, stored

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 24          # characters of context on either side
ROUNDS, RATE, L2 = 40, 0.4, 1.0
PRECISION = 0.95      # wanted of added spans on the calibration fold
CALIBRATION = 5       # one fold in so many is held out for the thresholds

# The four rules, written so that the engine never rescans a run it has failed on: possessive, and a
# match may only start where a run starts or the last match ended.
RULES = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("@",)),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", (".",)),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", ()),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", ("+",)),
)
LOOSE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)++", ("at",)),
    ("ip", r"(?<![0-9])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]) ?[0-9]{1,3}){3}(?![0-9])", (".", "[dot]")),
    ("card", r"(?<![0-9])[0-9]{4}(?:[./_]|  )[0-9]{4}(?:[./_]|  )[0-9]{4}(?:[./_]|  )[0-9]{1,7}(?![0-9])", ()),
    ("phone", r"(?<![0-9A-Za-z+])(?:(?:\([0-9]{2,4}\) ?|00 ?)[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}|[0-9]{2,4}(?:[ .-][0-9]{2,4}){2,4})(?![0-9A-Za-z])", ()),
)
FEATURES = ("left_edge", "right_edge", "cue", "count_fits", "check_passes", "grouped", "one_digit", "is_email", "is_ip", "is_card",
            "loose", "decoy")
# Words just before a span that speak for its kind (in the order of KINDS), and against any.
CUES = ("mail|contact|address|write to", "ip|host|server|address", "card|visa|credit|debit", "contact|tel|telephone|phone|call|fax|mobile|dial")
DECOYS = "version|release|build|order|invoice|ticket|article|serial|part|section|page|date|score|isbn"
# Worked examples by kind: right spellings, right ones only behind a cue, wrong ones.
SPELLED = (
    (("joe [at] mail.example.com", "anna.b(at)example(dot)org", "kim_1 {at} host.example.net", "lee[at]example [dot] com"), (),
     ("room [at] 12.30", "two(at)a.1", "seat {at} 7.b.2", "x[at]9.9")),
    (("10[.]20[.]30[.]40", "192 (.) 168 (.) 1 (.) 9", "172[dot]16[dot]0[dot]254", "8(.)8(.)4(.)4"), (),
     ("300[.]2[.]3[.]4", "10(.)20(.)30(.)999", "1[dot]2[dot]3[dot]256", "700 [.] 1 [.] 1 [.] 1")),
    (("4111/1111/1111/1111", "5500.0055.5555.5559", "4012_8888_8888_1881", "6011  1111  1111  1117"), (),
     ("4111/1111/1111/1112", "5500.0055.5555.5550", "1234_5678_9012_3456", "2024  1231  2359  5901")),
    (("(030) 1234 5678", "00 49 30 1234 5678", "0171-555-0199", "(0221) 555.019.922"), ("555-010-9999", "212 555 0199", "415.555.0133", "30 12 34 56 78"),
     ("2024-01-02", "12 34 56", "1990 1991 1992 1993 1994", "10.20.30")),
)
# (before, after, whether it speaks for or against a span; {} is a cue of the kind)
CONTEXTS = (("", "", "open"), ("and then ", " please", "open"), ("they have ", ".", "open"), ("see (", ")", "open"),
            ("{}: ", ", thanks", "cue"), ("my {} ", " now", "cue"), ("{} = ", "", "cue"), ("the {} is: ", "", "open"),
            ("version ", ".", "against"), ("order: ", " came", "against"), ("invoice #", "", "against"), ("serial ", ", new", "against"),
            ("@", "", "against"), ("say @", " so", "against"), ("", "@x", "against"), ("use ", "_y", "against"))
# A number up to 255, leading zeros allowed.
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _matches(docs: DataFrame, text: str) -> DataFrame:
    """(row, id, key, gen, i, gap, value, before, after): every match of every
    generator, and for each document one mark with gen -1."""
    gens = RULES + LOOSE
    digit = F.col(text).rlike("[0-9]")
    found = docs
    for g, (kind, pattern, signs) in enumerate(gens):
        gate = F.lit(not signs)
        for sign in signs:
            gate = gate | F.contains(F.col(text), F.lit(sign))
        if kind != "email":
            gate = gate & digit
        none = F.array().cast("array<string>")
        found = found.withColumn(f"m{g}", F.when(gate, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none))
    for g, (_, pattern, _) in enumerate(gens):
        found = found.withColumn(f"g{g}", F.when(F.size(f"m{g}") > 0, F.split(F.col(text), pattern, -1)).otherwise(F.array().cast("array<string>")))

    def item(g):
        gaps = F.col(f"g{g}")
        return F.transform(f"m{g}", lambda m, i: F.struct(
            F.lit(g).alias("gen"), i.alias("i"), F.char_length(gaps[i]).alias("gap"), m.alias("value"),
            F.right(gaps[i], F.lit(CONTEXT)).alias("before"), F.left(gaps[i + 1], F.lit(CONTEXT)).alias("after")))

    mark = F.array(F.struct(F.lit(-1).alias("gen"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit("").alias("value"),
                            F.lit("").alias("before"), F.lit("").alias("after")))
    return (found.withColumn("found", F.concat(mark, *[item(g) for g in range(len(gens))]))
            .select("row", "id", "key", F.inline_outer("found")))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every candidate of every document, one row each: row, id, key, kind (index
    into KINDS; -1: the mark each document brings), base, accepted (null for
    loose candidates), start, end (code points), features (a bit mask)."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), col(docs, id_col).alias("id"),
                        F.coalesce(col(docs, text_col), F.lit("")).alias("text"))
    rows = _matches(texts.withColumn("key", F.xxhash64("text")), "text")
    own = W.partitionBy("row", "gen").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap").cast("bigint") + F.char_length("value")).over(own))
    rows = rows.withColumn("start", F.col("end") - F.char_length("value"))

    gens = RULES + LOOSE
    kind = F.element_at(F.array(*[F.lit(KINDS.index(k)) for k, _, _ in gens]), F.greatest("gen", F.lit(0)) + 1)
    rows = rows.withColumn("kind", F.when(F.col("gen") < 0, F.lit(-1)).otherwise(kind))
    rows = rows.withColumn("digits", _digits(F.col("value"))).withColumn("n", F.length("digits"))
    by_kind = lambda *xs: F.when(F.col("kind") == 0, xs[0]).when(F.col("kind") == 1, xs[1]).when(F.col("kind") == 2, xs[2]).otherwise(xs[3])
    octets = F.regexp_replace(F.regexp_replace("value", r"\[dot\]|[\[\]() ]", "."), r"\.+", ".")
    octets_ok = octets.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    luhn = F.when(F.col("n") <= 19, F.expr("luhn_check(digits)")).otherwise(False)
    accepted = by_kind(F.lit(True), octets_ok, F.col("n").between(14, 19) & luhn, F.col("n").between(10, 15))
    flags = {
        "left_edge": ~F.col("before").rlike("[A-Za-z0-9@_]$"),
        "right_edge": ~F.col("after").rlike("^[A-Za-z0-9@_]"),
        "cue": by_kind(*[F.col("before").rlike(rf"(?i)(?:{words})[^A-Za-z0-9]*$") for words in CUES]),
        "count_fits": by_kind(F.col("value").rlike("[A-Za-z]"), F.col("n").between(4, 12), F.col("n").between(14, 19), F.col("n").between(10, 15)),
        "check_passes": by_kind(F.col("value").rlike("[A-Za-z]{2,24}$"), octets_ok, luhn, F.col("value").rlike(r"^[+(0]")),
        "grouped": F.col("value").rlike("[0-9][ ().-]+[0-9]"),
        "one_digit": F.col("digits").rlike(r"^([0-9])\1*$"),
        "is_email": F.col("kind") == 0, "is_ip": F.col("kind") == 1, "is_card": F.col("kind") == 2,
        "loose": F.col("gen") >= len(RULES), "decoy": F.col("before").rlike(rf"(?i)(?<![A-Za-z])(?:{DECOYS})[^A-Za-z0-9]*$"),
    }
    mask = F.lit(0)
    for b, name in enumerate(FEATURES):
        mask = mask.bitwiseOR(F.when(flags[name], F.lit(1 << b)).otherwise(F.lit(0)))
    base = F.col("gen").between(0, len(RULES) - 1)
    return rows.select("row", "id", "key", "kind", base.alias("base"), F.when(base, accepted).alias("accepted"),
                       F.col("start"), F.col("end"), mask.alias("features"))


def _fit(x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> list[tuple]:
    """Boosted depth-two trees for yes/no features x with outcome counts:
    (feature, (feature, yes, no) if it holds, (feature, yes, no) if not)."""
    score, trees, n = np.zeros(len(x)), [], pos + neg

    def leaf(sel, g, h):
        return g[sel].sum() / (h[sel].sum() + L2)

    def gain(sel, g, h):
        return g[sel].sum() ** 2 / (h[sel].sum() + L2)

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = pos - n * p, n * p * (1 - p)
        best = None
        for f in range(x.shape[1]):
            sides, worth = [], 0.0
            for side in (x[:, f], ~x[:, f]):
                w, k = max(((gain(side & x[:, j], g, h) + gain(side & ~x[:, j], g, h)), -j) for j in range(x.shape[1]))
                sides.append((-k, RATE * leaf(side & x[:, -k], g, h), RATE * leaf(side & ~x[:, -k], g, h)))
                worth += w
            if best is None or worth > best[0] + 1e-12:
                best = (worth, f, *sides)
        trees.append(best[1:])
        score = score + _raw(x, trees[-1:])
    return trees


def _raw(x: np.ndarray, trees: list[tuple]) -> np.ndarray:
    out = np.zeros(len(x))
    for f, (a, yes, no), (b, yes2, no2) in trees:
        out += np.where(x[:, f], np.where(x[:, a], yes, no), np.where(x[:, b], yes2, no2))
    return out


def examples() -> list[tuple[str, int, bool, bool]]:
    """(text, kind, whether its span is one, held out): every spelling of
    ``SPELLED`` in every context, each cue of the kind in turn."""
    out = []
    for k, (right, with_cue, wrong) in enumerate(SPELLED):
        cues = CUES[k].split("|")
        for i, value in enumerate(right + with_cue + wrong):
            for j, (before, after, says) in enumerate(CONTEXTS):
                good = says == "cue" or (says == "open" and value in right)
                out.append((before.replace("{}", cues[(i + j) % len(cues)]) + value + after, k, good and value not in wrong, (i + j) % 2 == 0))
    return out


def _tally(rows, at: dict[int, int]) -> np.ndarray:
    """Counts by (held out, kind, right, pattern)."""
    out = np.zeros((2, len(KINDS), 2, len(at)))
    for r in rows:
        out[int(bool(r["held"])), r["kind"], int(bool(r["accepted"])), at[r["features"]]] += r["count"]
    return out


def train(cands: DataFrame) -> tuple[list[tuple], dict[int, float]]:
    """(trees, threshold by kind) from the rule matches among ``cands`` and the
    worked examples. What reaches the driver is one row per feature pattern,
    kind, outcome and fold. The rule matches of a kind are scaled to weigh as
    much as its examples: a table's size plays no part, only its proportions.
    A kind whose best pattern is wrong too often gets no threshold."""
    by = ["features", "kind", "accepted", "held"]
    rules = cands.where("base").withColumn("held", remainder(F.col("id"), CALIBRATION) == 0).groupBy(by).count().orderBy(by).collect()
    # number, kind, held and right in one id, the only thing that a candidate keeps of its text
    told = json.dumps([{"id": ((n * 4 + k) * 2 + held) * 2 + good, "text": text} for n, (text, k, good, held) in enumerate(examples())])
    told = cands.sparkSession.range(1).select(F.inline(F.from_json(F.lit(told), "array<struct<id bigint, text string>>")))
    shown = candidates(told, "id", "text").where("not base and kind >= 0")
    meant = F.shiftright("id", 2).bitwiseAND(F.lit(3)) == F.col("kind")
    shown = (shown.withColumn("accepted", meant & (F.col("id").bitwiseAND(F.lit(1)) == 1))
             .withColumn("held", F.col("id").bitwiseAND(F.lit(2)) == 2).groupBy(by).count().orderBy(by).collect())
    codes = sorted({r["features"] for r in [*rules, *shown]})
    x = np.array([[c >> b & 1 for b in range(len(FEATURES))] for c in codes], dtype=bool)
    at = {c: i for i, c in enumerate(codes)}
    seen, made = _tally(rules, at), _tally(shown, at)
    for k in range(len(KINDS)):
        for held in (0, 1):
            if seen[held, k].sum():
                seen[held, k] *= made[held, k].sum() / seen[held, k].sum()
    both = seen + made
    trees = _fit(x, both[0, :, 1].sum(0), both[0, :, 0].sum(0))
    score = _raw(x, trees)
    thresholds = {}
    for k in range(len(KINDS)):
        own = made[:, k].sum((0, 1)) > 0     # patterns of looser spellings: those a threshold decides about
        for s in sorted(set(score[own]), reverse=True):
            good, bad = made[1, k, 1, score >= s].sum(), made[1, k, 0, score >= s].sum()
            if good and good >= PRECISION * (good + bad):
                thresholds[k] = float(s)
    return trees, thresholds


def _score(trees: list[tuple]) -> Column:
    has = lambda f: F.col("features").bitwiseAND(F.lit(1 << f)) != 0
    total = F.lit(0.0)
    for f, (a, yes, no), (b, yes2, no2) in trees:
        total = total + F.when(has(f), F.when(has(a), float(yes)).otherwise(float(no))).otherwise(
            F.when(has(b), float(yes2)).otherwise(float(no2)))
    return total


def _selected(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Marks, base spans and added spans: row, id, key, kind, base, start, end."""
    cands = stored(candidates(docs, id_col, text_col).where("kind < 0 or not base or accepted is not null"), "pii")
    trees, thresholds = train(cands)
    rules = cands.where("kind < 0 or accepted")
    if not thresholds:
        return rules.drop("accepted", "features")
    limit = F.lit(None).cast("double")
    for k, t in thresholds.items():
        limit = F.when(F.col("kind") == k, F.lit(t)).otherwise(limit)
    added = cands.where(~F.col("base") & (F.col("kind") >= 0)).where(F.coalesce(_score(trees) >= limit, F.lit(False)))
    both = rules.unionByName(added)
    before = W.partitionBy("row").orderBy("start").rangeBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("row").orderBy("start").rangeBetween(0, W.unboundedFollowing)
    earlier = W.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(W.unboundedPreceding, -1)
    extra = (F.col("kind") >= 0) & ~F.col("base")
    clear = (both.withColumn("reach", F.max(F.when(F.col("base"), F.col("end"))).over(before))
             .withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(after))
             .where(~extra | ((F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end"))))))
    return (clear.withColumn("reach", F.max(F.when(extra, F.col("end"))).over(earlier))
            .where(~extra | F.col("reach").isNull() | (F.col("reach") <= F.col("start")))
            .drop("reach", "next", "accepted", "features"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base and spans, arrays of (start, kind, end)
    sorted by start, then kind (an index into KINDS); ends are exclusive, in code
    points. Null texts count as empty; equal rows come back as often as they
    occur; null ids are kept; an empty table gives an empty result."""
    span = F.struct("start", "kind", "end")
    return (_selected(docs, id_col, text_col).groupBy("row", "id", "key")
            .agg(F.array_sort(F.collect_list(F.when((F.col("kind") >= 0) & F.col("base"), span))).alias("base"),
                 F.array_sort(F.collect_list(F.when(F.col("kind") >= 0, span))).alias("spans"))
            .select(F.col("id").alias("doc_id"), "base", "spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (all its columns) with every selected span replaced by ``[KIND]``;
    overlapping spans are replaced together under the kind that starts first.
    Documents without personal data stay as they are, nulls included."""
    spans = _selected(docs, id_col, text_col).where("kind >= 0")
    order = W.partitionBy("row").orderBy("start", "kind", "end")
    new = F.col("start") >= F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = spans.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("row", "id", "key", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "kind"))["kind"].alias("kind"))
    cuts = (runs.groupBy("row", "id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))
            .groupBy("id", "key").agg(F.min("cuts").alias("cuts")))  # equal rows have equal cuts
    cuts = cuts.select(F.col("id").alias("cut_id"), F.col("key").alias("cut_key"), "cuts")
    key = fresh(docs, "pii_key")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(col(docs, text_col), F.lit(""))))
    joined = keyed.join(cuts, col(keyed, id_col).eqNullSafe(cuts.cut_id) & (col(keyed, key) == cuts.cut_key), "left")
    text = col(keyed, text_col)
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    piece = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    done = F.transform(cuts.cuts, lambda s, i: F.concat(
        piece(F.when(i > 0, cuts.cuts[i - 1]["end"]).otherwise(F.lit(0)), s["start"]), F.element_at(tags, s["kind"] + 1)))
    rest = piece(F.element_at(cuts.cuts, -1)["end"], F.char_length(text))
    clean = F.when(cuts.cuts.isNull(), text).otherwise(F.concat(F.array_join(done, ""), rest))
    return joined.select(*[clean.alias(c) if c == text_col else col(keyed, c) for c in docs.columns])
