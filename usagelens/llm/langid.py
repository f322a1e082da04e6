"""Language identification by string kernels.

A text is the set of its hashed character 1- to 3-grams (blended spectrum,
presence only). The kernel of two texts is the size of the intersection over
the geometric mean of the sizes. A Nystrom map over ``LANDMARKS_PER_LANG``
training texts of each language turns kernel rows into features, and one ridge
regression per language (one against the rest) is fitted on them. A batch of
texts is scored by two matrix products.

Only presence bit sets of a bounded sample reach the driver: ``PER_LANG`` texts
of each language, fewer where there are so many languages that this would be
more than ``SAMPLE`` texts (or ``LANDMARKS`` landmarks), yet at least one. Every
language that occurs is learned, and every text is scored whole, where it lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.llm.common import col, fresh, remainder

ORDERS = (1, 2, 3)
BITS = 14
PER_LANG = 300
SAMPLE = 24_000
LANDMARKS_PER_LANG, LANDMARKS = 16, 1_600
RIDGE = 1e-3
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_STEP = 1 << 18


def has_letter(text: str | None) -> bool:
    """Whether a character of a Unicode letter category (L*) occurs; numerals
    like a half or a Roman eight are none."""
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def presence(text: str) -> np.ndarray:
    """Which of the 2 ** BITS gram buckets occur in the lower-cased text, runs
    of other characters counting as one space."""
    seen = np.zeros(1 << BITS, dtype=bool)
    codes = np.frombuffer((" " + _NOT_LETTER.sub(" ", text.lower()) + " ").encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    for lo in range(0, len(codes), _STEP):
        part = codes[lo:lo + _STEP + ORDERS[-1] - 1]
        gram = np.zeros(len(part), dtype=np.uint64)
        for n in ORDERS:
            gram = gram[:len(part) - n + 1] * np.uint64(0x110001) + part[n - 1:]
            h = (gram + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            seen[h >> np.uint64(64 - BITS)] = True
    return seen


@F.pandas_udf(T.BinaryType())
def _presence_bits(texts: pd.Series) -> pd.Series:
    return pd.Series([np.packbits(presence(t)).tobytes() if has_letter(t) else None for t in texts])


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, bits): a bounded number of texts of each language outside the
    held-out fold, those with the smallest hashes of id and text. One row per
    distinct language passes through the driver."""
    rows = docs.select(col(docs, id_col).alias("id"), col(docs, lang_col).alias("lang"), col(docs, text_col).alias("text"))
    rows = rows.where("lang is not null and text is not null").where(
        F.coalesce(remainder(F.col("id"), FOLDS), F.lit(HELD_OUT)) != HELD_OUT)
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return rows.select("lang", F.lit(None).cast("binary").alias("bits")).limit(0)
    each = max(1, min(PER_LANG, SAMPLE // len(counts)))
    # A hash threshold per language leaves a few times its share, whatever the table's size; only they are ranked.
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (4.0 * each + 12) / r["count"])) for r in counts], "lang string, rate double")
    rows = rows.join(F.broadcast(rates), "lang").withColumn("h", F.xxhash64("id", F.lit("langid")))
    rows = rows.where(F.shiftrightunsigned("h", 11) / float(1 << 53) < F.col("rate")).drop("rate")
    best = W.partitionBy("lang").orderBy("h", F.xxhash64("text"))
    picked = rows.withColumn("k", F.row_number().over(best)).where(F.col("k") <= each)
    return picked.select("lang", "k", _presence_bits("text").alias("bits")).where("bits is not null")


class Model:
    """langs (sorted), landmarks (packed bits), weights (landmarks x langs)."""

    def __init__(self, langs: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.langs, self.landmarks, self.weights = langs, landmarks, weights


def _kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    nx, ny = x.sum(axis=1), y.sum(axis=1)
    return (x @ y.T) / np.sqrt(np.maximum(nx, 1)[:, None] * np.maximum(ny, 1)[None, :])


def _unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, axis=1).astype(np.float32)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The model; None if there is nothing to learn from."""
    rows = sorted((r["lang"], r["k"], bytes(r["bits"])) for r in sample(docs, id_col, text_col, lang_col).collect()) \
        if docs.columns else []
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    bits = np.array([np.frombuffer(r[2], dtype=np.uint8) for r in rows])
    y = np.array([[1.0 if r[0] == g else -1.0 for g in langs] for r in rows])
    seen: dict[str, int] = {}
    marks, most = [], max(1, min(LANDMARKS_PER_LANG, LANDMARKS // len(langs)))
    for i, (lang, _, _) in enumerate(rows):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= most:
            marks.append(i)
    y0 = _unpacked(bits[marks])
    own = _kernel(y0, y0).astype(np.float64)
    values, vectors = np.linalg.eigh(own)
    values = np.maximum(values, 1e-6 * values.max())
    root = vectors / np.sqrt(values) @ vectors.T
    phi = np.vstack([_kernel(_unpacked(bits[i:i + 128]), y0) for i in range(0, len(rows), 128)]).astype(np.float64) @ root
    weight = 1.0 / np.array([seen[r[0]] for r in rows])  # languages count alike
    a = (phi * weight[:, None]).T @ phi + RIDGE * np.eye(len(marks))
    w = np.linalg.solve(a, (phi * weight[:, None]).T @ y)
    return Model(langs, bits[marks], (root @ w).astype(np.float32))


def predict(text: Column, model: Model | None) -> Column:
    """struct(lang_pred, score)."""
    kind = "lang_pred string, score double"
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    langs, packed, weights = model.langs, model.landmarks, model.weights

    @F.pandas_udf(kind)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        y = _unpacked(packed)
        for texts in batches:
            pred, best = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if has_letter(t)]
            if known:
                x = np.empty((len(known), 1 << BITS), dtype=np.float32)
                for k, i in enumerate(known):
                    x[k] = presence(texts.iloc[i])
                s = _kernel(x, y) @ weights
                top = s.argmax(axis=1)
                pred[known] = np.array(langs, dtype=object)[top]
                best[known] = np.clip((s[np.arange(len(known)), top] + 1) / 2, 0, 1)
            yield pd.DataFrame({"lang_pred": pred, "score": best})

    return score(text)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    ``und`` with score 0 where the text is null or has no letter (or nothing
    could be learned); texts of any length are read whole, though very long ones
    fill most of the gram buckets and tell less apart; ties go to the first language in alphabetical order; ids
    may be null or repeat (a null id is not held out); other columns, whatever
    their names, are ignored; an empty table gives an empty result."""
    rows = docs.select(col(docs, id_col).alias("doc_id"), predict(col(docs, text_col), model).alias("p"))
    return rows.select("doc_id", F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
                       "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose language is unknown; columns unchanged."""
    name = fresh(docs, "langid")
    return (docs.withColumn(name, predict(col(docs, text_col), model))
            .where(F.col(f"`{name}`.lang_pred") != UNKNOWN).drop(name))
