"""N-gram Jaccard join with several global token orders.

Two texts link when the Jaccard similarity of their sets of word shingles
reaches a threshold. If all sets are sorted by one global token order, two
similar sets must share a token within their first tokens (prefixes); that
holds for *every* order, so a candidate pair has to pass all of these:

* order 0, by token hash: prefixes longer by l tokens share at least l, so a
  text whose longer prefix holds fewer tokens that occur elsewhere has no
  partner. It needs no counts and only a third of the tokens, and drops most
  texts before any candidate is formed;
* order 1, rarest token first: an inverted index of these prefixes proposes
  the pairs;
* order 2, rarest first with other tie-breaks, and order 3, commonest first:
  the pair's prefixes must meet in them too.

Only then are whole sets intersected. Equal sets are one class from the start.
Candidates come in two rounds: every index list against one member, and then,
between the components this leaves, all pairs of the lists that still hold more
than one component. A large group of near copies thus costs a
comparison each instead of all its pairs, and no link between components is
lost. Long lists are dealt out in salted pieces.

Tokens are 64-bit hashes of shingles: two different shingles of a pair of
texts count as one with a probability of about 1e-14 for texts of 300 words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import col, stored
from usagelens.llm.components import components

WORDS = 5
PERCENT = 80
# Tokens added to the prefix of order 0, in percent of a set's size.
EXTRA = 10
# Bits, at most, of the map of texts read a second time.
MARKS = 1 << 26
# Words of the parity sketch; members of an index list handled in one piece.
SKETCH = 4
PIECE = 512
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes (signed). Fewer words than a shingle has:
    the whole sequence is one; none, or null: empty."""
    found = text.encode("utf-8").lower().split() if text else []
    if not found:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    k = min(words, len(found))
    total = np.full(len(found) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total = _mix(total + h[i:i + len(total)])
    return np.unique(total.view(np.int64))


def sketch(tokens: np.ndarray) -> list[int]:
    """Parities of the tokens in 64 * SKETCH cells, as signed words: two sets
    differ in at least as many tokens as their sketches differ in bits."""
    cells = np.bincount((tokens.view(np.uint64) >> np.uint64(7)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").view("<i8").tolist()


def _need(n, percent: int):
    """Tokens a set of n must share with any partner (numbers or SQL columns)."""
    return (n * percent + 99) // 100 if isinstance(n, int) else F.floor((n * percent + 99) / 100).cast("int")


def _extra(n, percent: int):
    share = min(EXTRA, percent // 2)
    return max(1, n * share // 100) if isinstance(n, int) else F.greatest(F.lit(1), F.floor(n * share / 100).cast("int"))


def _sets(docs: DataFrame, words: int, percent: int, whole: bool) -> DataFrame:
    """docs (id, text) -> id, n, k1, k2 (128-bit identity of the set), tokens (the
    prefix of order 0, or the ``whole`` set, then with its sketch)."""
    kind = docs.schema["id"].dataType.simpleString()
    fields = ["k1 bigint", "k2 bigint", "n int", "tokens array<bigint>"] + [f"s{i} bigint" for i in range(SKETCH if whole else 0)]

    def run(batches):
        for batch in batches:
            rows = [shingles(t, words) for t in batch.column(1).to_pylist()]
            keys = np.array([xxhash.xxh3_128_digest(r.tobytes()) for r in rows], dtype="V16").view("<i8").reshape(-1, 2)
            kept = rows if whole else [r[:len(r) - _need(len(r), percent) + _extra(len(r), percent)] for r in rows]
            ends = np.cumsum([0] + [len(r) for r in kept])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *kept])))
            out = [batch.column(0), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([len(r) for r in rows], pa.int32()), lists]
            if whole:
                bits = np.array([sketch(r) for r in rows], dtype=np.int64).reshape(-1, SKETCH)
                out += [pa.array(bits[:, i]) for i in range(SKETCH)]
            yield pa.RecordBatch.from_arrays(out, names=["id"] + [f.split()[0] for f in fields])

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, " + ", ".join(fields))


def _survivors(sets: DataFrame, percent: int) -> DataFrame:
    """Texts (row) that may have a partner, or a copy, by order 0: enough tokens
    of the longer prefix occur in another text. A token of one text only is
    counted for its owner, so common tokens are combined before the shuffle."""
    flat = sets.select("row", F.explode("tokens").alias("t"))
    single = (flat.groupBy("t").agg(F.count("*").alias("c"), F.min("row").alias("row")).where("c = 1")
              .groupBy("row").agg(F.count("*").alias("single")))
    return (sets.where("n > 0").select("row", "n", F.size("tokens").alias("m"), "id", "k1", "k2").join(single, "row", "left")
            .where(F.col("m") - F.coalesce("single", F.lit(0)) >= _extra(_need(F.col("n"), percent), percent))
            .select("row", "n", "id", "k1", "k2"))


def _mark(ids: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(ids), F.lit(bits))


def _marked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of docs whose id may be among ``wanted``: a bit map of 16 to 32 bits
    for each of them, MARKS at most, passes through the driver, whatever the size
    of the tables. It only spares the join after it most of the texts."""
    marks = min(MARKS, max(64, 1 << (16 * wanted.count()).bit_length()))
    words = wanted.select(_mark(F.col("id"), marks).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits")).toArrow()
    bits = np.zeros(marks // 64, dtype=np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    packed = bits.tobytes()

    def run(batches):
        there = np.frombuffer(packed, dtype=np.int64)
        for batch in batches:
            at = batch.column(2).to_numpy()
            keep = there[at >> 6] >> (at & 63) & 1 == 1
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["id", "text"])

    return docs.select("id", "text", _mark(F.col("id"), marks).alias("at")).mapInArrow(run, docs.schema)


def _ordered(full: DataFrame, percent: int) -> DataFrame:
    """Sets with their shared tokens (``core``) and the tokens' frequencies
    (``df``), rarest first. Tokens of one set only lead the rarest-first orders,
    so they shorten the prefix; sets with too few shared tokens have no partner."""
    flat = full.select("row", F.explode("tokens").alias("t"))
    df = flat.groupBy("t").agg(F.count("*").alias("df")).where("df > 1").select("t", F.col("df").cast("int").alias("df"))
    by_df = flat.join(df, "t").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("by_df"))
    return (full.drop("tokens").join(by_df, "row").withColumn("c", F.size("by_df")).where(F.col("c") >= _need(F.col("n"), percent))
            .select("row", "n", "c", *[f"s{i}" for i in range(SKETCH)], F.col("by_df")["t"].alias("core"), F.col("by_df")["df"].alias("df")))


def _prefix(order: int, percent: int, n: Column | None = None, core: Column | None = None) -> Column:
    """A set's shared tokens among the first n - need + 1 of its order."""
    n, core = F.col("n") if n is None else n, F.col("core") if core is None else core
    c = F.size(core)
    ahead = c - _need(n, percent) + 1
    if order == 1:
        return F.slice(core, F.lit(1), ahead)
    if order == 3:
        return F.slice(F.reverse(core), F.lit(1), F.least(c, n - _need(n, percent) + 1))
    other = F.array_sort(F.zip_with(F.col("df"), core, lambda d, t: F.struct(d.alias("d"), F.xxhash64(t).alias("h"), t.alias("t"))))
    return F.slice(other, F.lit(1), ahead)["t"]


def _overlap(a: Column, b: Column, percent: int) -> Column:
    """Shared tokens that sets of these sizes need to link."""
    return F.ceil((a + b) * percent / F.lit(100 + percent)).cast("int")


def _possible(x: str, y: str, percent: int) -> Column:
    """Whether sizes and shared tokens allow a link."""
    return F.least(F.col(f"{x}.c"), F.col(f"{y}.c")) >= _overlap(F.col(f"{x}.n"), F.col(f"{y}.n"), percent)


def _alike(x: str, y: str, percent: int) -> Column:
    """Whether the sketches allow a link."""
    bits = sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(SKETCH)), F.lit(0))
    n = F.col(f"{x}.n") + F.col(f"{y}.n")
    return bits <= n - 2 * _overlap(F.col(f"{x}.n"), F.col(f"{y}.n"), percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose prefixes meet in the orders 2 and 3 as well and whose
    whole sets are similar enough."""
    what = sets.select("row", "n", "core", _prefix(2, percent).alias("o2"))
    a, b = (what.select(F.col("row").alias(r), *[F.col(c).alias(f"{r}_{c}") for c in ("n", "core", "o2")]) for r in "uv")
    both = pairs.join(a, "u").join(b, "v")
    # order 3 is the core read backwards: it need not travel
    u, v = (_prefix(3, percent, both[f"{r}_n"], both[f"{r}_core"]) for r in "uv")
    both = both.where(F.arrays_overlap("u_o2", "v_o2") & F.arrays_overlap(u, v))
    return both.where(F.size(F.array_intersect("u_core", "v_core")) >= _overlap(F.col("u_n"), F.col("v_n"), percent)).select("u", "v")


def _first_round(index: DataFrame, percent: int) -> DataFrame:
    """Every index list against the member with the fewest tokens of its own: in
    a group of edited copies that is the one closest to all others."""
    alone = (F.col("n") - F.col("c")).alias("alone")
    lead = index.groupBy("t").agg(F.min(F.struct(alone, "row", "n", "c")).alias("lead"), F.count("*").alias("m")).where("m > 1").select("t", "lead.*")
    x, y = index.alias("x"), lead.alias("y")
    return x.join(y, F.col("x.t") == F.col("y.t")).where((F.col("x.row") != F.col("y.row")) & _possible("x", "y", percent)).select(
        F.greatest("x.row", "y.row").alias("u"), F.least("x.row", "y.row").alias("v")).distinct()


def _second_round(index: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components within the lists that hold several,
    in pieces of about PIECE members against the list."""
    placed = sets.drop("core", "df").join(roots, sets.row == roots.node, "left").withColumn("root", F.coalesce("root", "row")).drop("node")
    lists = index.select("row", "t").join(placed.select("row", "root"), "row")
    open_ = lists.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where(
        "lo <> hi").select("t", F.ceil(F.col("m") / PIECE).cast("int").alias("pieces"))
    left = stored(index.select("row", "t").join(open_, "t").join(placed, "row"), "jaccard-open")
    x = left.withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int")).alias("x")
    y = left.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).alias("y")
    return x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.piece") == F.col("y.piece")) & (F.col("x.root") != F.col("y.root"))
                  & (F.col("x.row") > F.col("y.row")) & _possible("x", "y", percent) & _alike("x", "y", percent)).select(
        F.col("x.row").alias("u"), F.col("y.row").alias("v")).distinct()


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                   percent: int = PERCENT) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id).

    Words are runs without ASCII white space, A-Z in lower case; a set holds the
    distinct shingles of ``words`` words (fewer words: the whole sequence). Two
    documents link when 100 * intersection >= ``percent`` * union; component_id
    is the smallest id reachable. Null, empty and blank texts have no shingle,
    link with nothing and keep their own id. Equal texts always link; repeated
    rows come back as often as they occur; null ids stay null and never name a
    component (null only if the whole component has none). Texts of any length
    are used whole: a text's set lies in one row, nothing else does. Other
    columns are ignored, whatever their names. An empty table gives an empty
    result."""
    if not 1 <= percent <= 100 or words < 1:
        raise ValueError("percent must lie between 1 and 100, words be positive")
    plain = docs.select(col(docs, id_col).alias("id"), col(docs, text_col).alias("text"))
    sets = stored(_sets(plain, words, percent, False).withColumn("row", F.monotonically_increasing_id()), "jaccard-prefix")
    classes = stored(sets.where("n > 0").groupBy("k1", "k2").agg(
        F.min("row").alias("row"), F.min("id").alias("id"), F.count("*").alias("copies")), "jaccard-classes")
    hold = _survivors(sets, percent).join(classes.select("row"), "row", "left_semi")
    hold = stored(hold, "jaccard-hold")
    # A class is found again by its least id; the identity decides. Its copies meet in one shuffle.
    again = _sets(_marked(plain, hold), words, percent, True)
    whole = again.groupBy("k1", "k2").agg(F.first(F.struct("n", "tokens", *[f"s{i}" for i in range(SKETCH)])).alias("set"))
    full = stored(whole.join(hold.select("k1", "k2", "row"), ["k1", "k2"]).select("row", "set.*"), "jaccard-sets")
    ordered = stored(_ordered(full, percent), "jaccard-ordered")
    index = stored(ordered.select("row", "n", "c", F.explode(_prefix(1, percent)).alias("t")), "jaccard-index")
    edges = stored(_verified(_first_round(index, percent), ordered, percent), "jaccard-links")
    roots = stored(components(edges), "jaccard-roots")
    more = stored(_verified(_second_round(index, ordered, roots, percent), ordered, percent), "jaccard-links")
    roots = stored(components(edges.union(more)), "jaccard-roots")
    linked = classes.join(roots, classes.row == roots.node, "left").select(
        "k1", "k2", "copies", "id", F.coalesce("root", "row").alias("root"), F.col("root").isNotNull().alias("linked"))
    low = linked.where("linked").groupBy("root").agg(F.min("id").alias("low"))
    best = linked.join(low, "root", "left").where("linked or copies > 1").select(
        "k1", "k2", F.lit(True).alias("grouped"), F.when(F.col("linked"), F.col("low")).otherwise(F.col("id")).alias("best"))
    own = F.when(F.col("grouped"), F.col("best")).otherwise(F.col("id"))
    return sets.select("id", "n", "k1", "k2").join(best, ["k1", "k2"], "left").select(
        F.col("id").alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"), own.alias("component_id"))
