"""Quality classifier: a factorisation machine.

Inputs of a text: hashed words (tf, unit length), structure statistics and
metadata (the recorded length). The score is

    sigma(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

so all pairwise interactions cost time linear in the words. The model is fitted
on a bounded sample (``TRAIN_ROWS`` labelled rows outside the held-out fold,
those with the smallest hashes); every text is scored whole, where it lies.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import col, remainder

WORD_BITS = 11
TRAIN_ROWS = 4_000
RANK, EPOCHS, RATE, L2, SEED = 8, 120, 0.03, 1e-4, 7
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
STATS = 14
_WORDS = 1 << WORD_BITS
DIMS = _WORDS + STATS


def _statistics(text: str, words: list[str], counts: Counter, n_chars) -> np.ndarray:
    """Structure statistics and metadata, each roughly between 0 and 1."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    size, n = max(len(raw), 1), max(len(words), 1)
    tally = np.bincount(raw, minlength=256)
    upper, lower, digits = tally[65:91].sum(), tally[97:123].sum(), tally[48:58].sum()
    symbols = tally[33:48].sum() + tally[58:65].sum() + tally[91:97].sum() + tally[123:127].sum()
    lines = [s for s in text.split("\n") if s.strip()]
    same = sum(a == b for a, b in zip(words, words[1:]))
    known = 0.0 if n_chars is None or n_chars != n_chars else min(np.log1p(max(float(n_chars), 0.0)) / 12, 1.5)
    return np.array([
        np.log1p(size) / 12, np.log1p(n) / 10, min(size / n / 12, 2.0), upper / max(upper + lower, 1), digits / size,
        symbols / size * 4, (tally[44] + tally[46]) / n, tally[10] / size * 20, tally[124] / n,
        len(counts) / n, max(counts.values(), default=0) / n, same / n,
        1 - len(set(lines)) / max(len(lines), 1), known], dtype=np.float32)


def features(text: str | None, n_chars=None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of one text; null counts as empty. Words come first,
    hashed to 2 ** WORD_BITS places, then the statistics."""
    text = text or ""
    words = text.lower().split()
    counts = Counter(words)
    at = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) & (_WORDS - 1) for w in counts), dtype=np.int64, count=len(counts))
    tf = np.bincount(at, weights=np.fromiter(counts.values(), dtype=np.float64, count=len(counts)), minlength=_WORDS) \
        if len(at) else np.zeros(_WORDS)
    at = np.flatnonzero(tf)
    values = tf[at] / max(np.sqrt((tf[at] ** 2).sum()), 1e-9)
    return (np.concatenate((at, np.arange(_WORDS, DIMS))),
            np.concatenate((values, _statistics(text, words, counts, n_chars))).astype(np.float32))


class Model:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.v[at]
        s = x @ v
        z = self.w0 + x @ self.w[at] + 0.5 * float(s @ s - (x * x) @ (v * v).sum(axis=1))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Full-batch Adam on the log loss (dense x: a bounded sample)."""
    rng = np.random.default_rng(SEED)
    x2 = x * x
    p = [np.zeros(1, dtype=np.float32), np.zeros(x.shape[1], dtype=np.float32),
         rng.normal(0, 0.05, (x.shape[1], RANK)).astype(np.float32)]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, EPOCHS + 1):
        xv = x @ p[2]
        z = p[0] + x @ p[1] + 0.5 * ((xv ** 2).sum(axis=1) - x2 @ (p[2] ** 2).sum(axis=1))
        e = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y).astype(np.float32) / len(y)
        grads = [e.sum(keepdims=True), x.T @ e + L2 * p[1], x.T @ (e[:, None] * xv) - (x2.T @ e)[:, None] * p[2] + L2 * p[2]]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.999 * s[i] + 0.001 * g * g
            p[i] = p[i] - RATE * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(s[i] / (1 - 0.999 ** t)) + 1e-8)
    return Model(float(p[0][0]), p[1], p[2])


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, length_col: str | None) -> DataFrame:
    """(quality, at, x): features of at most TRAIN_ROWS labelled texts (ids are
    labelled by the mean of their labels; null ids and labels teach nothing,
    labels of no document take no place in the sample)."""
    own = labels.select(col(labels, id_col).alias("label_id"), col(labels, label_col).cast("double").alias("quality"))
    own = own.where("label_id is not null and quality is not null").where(remainder(F.col("label_id"), FOLDS) != HELD_OUT)
    own = own.groupBy("label_id").agg((F.avg("quality") >= 0.5).cast("double").alias("quality"))
    own = own.join(docs.select(col(docs, id_col).alias("there")), F.col("label_id") == F.col("there"), "left_semi")
    own = own.orderBy(F.xxhash64("label_id"), "label_id").limit(TRAIN_ROWS)
    length = col(docs, length_col).cast("double") if length_col else F.lit(None).cast("double")
    texts = docs.select(col(docs, id_col).alias("id"), col(docs, text_col).alias("text"), length.alias("n"))

    @F.pandas_udf("at array<int>, x array<float>")
    def extract(text: pd.Series, n: pd.Series) -> pd.DataFrame:
        got = [features(t, k) for t, k in zip(text, n)]
        return pd.DataFrame({"at": [g[0] for g in got], "x": [g[1] for g in got]})

    # at most TRAIN_ROWS ids, so the broadcast is bounded
    rows = texts.join(F.broadcast(own), F.col("id") == F.col("label_id"))
    return rows.select("id", "quality", extract("text", "n").alias("f")).select("id", "quality", "f.at", "f.x")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          length_col: str | None = "n_chars") -> Model:
    """The model; without labelled rows one that scores 0.5 everywhere. Rows with
    one id share a label; at most TRAIN_ROWS of them are used."""
    rows = sample(docs, labels, id_col, text_col, label_col, length_col).orderBy("id", F.xxhash64("x")).limit(TRAIN_ROWS).collect()
    if not rows:
        return Model(0.0, np.zeros(DIMS, dtype=np.float32), np.zeros((DIMS, RANK), dtype=np.float32))
    x = np.zeros((len(rows), DIMS), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["x"]
    return fit(x, np.array([r["quality"] for r in rows], dtype=np.float32))


def score(text: Column, length: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lengths in batches:
            yield pd.Series([model.score(*features(t, n)) for t, n in zip(texts, lengths)], dtype="float64")

    return run(text, length)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             length_col: str | None = "n_chars") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if the score
    reaches THRESHOLD). Null counts as the empty text and is scored like any
    other; ids may be null (not held out) or repeat; other columns are never
    read; an empty table gives an empty result."""
    length = col(docs, length_col).cast("double") if length_col else F.lit(None).cast("double")
    rows = docs.select(col(docs, id_col).alias("doc_id"), score(col(docs, text_col), length, model).alias("score"))
    return rows.select("doc_id", F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
                       "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
