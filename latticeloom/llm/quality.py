"""Document quality: a naive Bayes support vector machine over n-grams.

Each document is the set of its byte n-grams (lengths 1 to ``MAX_N``, letters A-Z lowered) and of its repetition n-grams,
hashed into ``2**BITS`` features. A repetition n-gram is an n-gram of the distances from each word to its last occurrence
among the ``BACK`` words before it (0: none), so runs and loops of words have features of their own. An indicator is scaled by the feature's class log-count ratio, every document vector is brought to length one, and a linear
hinge-loss model is fitted by dual coordinate descent. The model is fitted on a bounded sample of labelled rows
(``fit_rows``); every row of the table is scored, whole texts included.

Defined cases: a null or empty text has no features, so its score is that of the bias alone. Rows are scored one by one:
repeated rows get equal scores. Labels that are null, or rows without a text, are not learned from. Without any label,
or with one class only, the model is a constant (0.5 without a label, else the class that was seen). Other columns pass
through; ``score`` and ``predicted`` are replaced if present.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
MAX_N = 4
BACK = 3
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B))


@dataclass(frozen=True)
class QualityModel:
    """``weights`` already hold the ratio of each feature; ``ratios`` give the length of a document vector."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float


def _hashed_grams(codes: np.ndarray, kind: int, bits: int, max_n: int) -> list[np.ndarray]:
    parts, rolled = [], codes
    for n in range(1, max_n + 1):
        if n > 1:
            rolled = rolled[:-1] * _MIX[0] + codes[n - 1:]
        if not len(rolled):
            break
        mixed = (rolled ^ (rolled >> np.uint32(15))) * _MIX[1] + np.uint32(16 * kind + n)
        parts.append((mixed ^ (mixed >> np.uint32(13))) >> np.uint32(32 - bits))
    return parts


def repetition(words: list[bytes], back: int = BACK) -> np.ndarray:
    """For each word, how many words ago it stood last (1 to ``back``), or 0."""
    codes = np.zeros(len(words), dtype=np.uint32)
    for d in range(min(back, len(words) - 1), 0, -1):
        codes[d:][np.fromiter(map(bytes.__eq__, words[d:], words), dtype=bool, count=len(words) - d)] = d
    return codes


def features(text: bytes, bits: int = BITS, max_n: int = MAX_N) -> np.ndarray:
    """The distinct hashed n-grams of a text, in no particular order."""
    low = text.lower()
    parts = _hashed_grams(np.frombuffer(low, dtype=np.uint8).astype(np.uint32) + np.uint32(1), 0, bits, max_n)
    parts += _hashed_grams(repetition(low.split()) + np.uint32(1), 1, bits, max_n)
    if not parts:
        return np.empty(0, dtype=np.uint32)
    found = np.concatenate(parts)
    last = np.empty(1 << bits, dtype=np.int32)
    order = np.arange(len(found), dtype=np.int32)
    last[found] = order                          # one place survives for each feature
    return found[last[found] == order]


def log_count_ratios(docs: list[np.ndarray], good: np.ndarray, bits: int = BITS, alpha: float = 1.0) -> np.ndarray:
    """Smoothed class log-count ratio of every feature; features that no document has get zero."""
    sums = [np.full(1 << bits, alpha), np.full(1 << bits, alpha)]
    for found, label in zip(docs, good):
        sums[int(label)][found] += 1.0
    seen = (sums[0] > alpha) | (sums[1] > alpha)
    ratio = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    return np.where(seen, ratio, 0.0)


def fit_hinge(docs: list[np.ndarray], good: np.ndarray, ratios: np.ndarray, cost: float = 1.0, epochs: int = 20,
              seed: int = 7, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the linear hinge-loss machine; returns (weights, bias)."""
    y = np.where(good, 1.0, -1.0)
    rows = []
    for found in docs:
        x = ratios[found].astype(np.float32)
        length = np.sqrt(float(x @ x))
        rows.append(x / np.float32(length) if length > 0 else x)
    share = np.array([np.mean(y < 0), np.mean(y > 0)])
    upper = cost * 0.5 / np.maximum(share[(y > 0).astype(int)], 1e-9)      # both classes weigh the same
    square = np.array([float(x @ x) for x in rows]) + 1.0
    alpha, weights, bias = np.zeros(len(y)), np.zeros(len(ratios)), 0.0
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(y)):
            gradient = y[i] * (float(weights[docs[i]] @ rows[i]) + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                weights[docs[i]] += step * rows[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < tolerance:
            break
    return weights, bias


def margin(found: np.ndarray, model: QualityModel) -> float:
    r = model.ratios[found]
    length = float(np.sqrt(r @ r))
    return (float(model.weights[found] @ r) / length if length > 0 else 0.0) + model.bias


def training_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, fit_rows: int) -> DataFrame:
    """At most ``fit_rows`` labelled rows ``(text, good)``, the same ones on every run.

    The ids are bounded before the join, so the broadcast side has at most ``fit_rows`` rows; the rows are bounded again
    after it, in case an id is held by many documents.
    """
    order = F.xxhash64(F.col("doc_id"))
    wanted = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(train)
              .groupBy("doc_id").agg((F.max(label) > 0).alias("_good"))
              .orderBy(order, "doc_id").limit(fit_rows))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("_text"))
    return (texts.join(F.broadcast(wanted), "doc_id").orderBy(order, F.xxhash64("_text")).limit(fit_rows)
            .select("_text", "_good"))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None,
                fit_rows: int = 6_000, cost: float = 1.0, epochs: int = 20) -> QualityModel:
    """Fit on at most ``fit_rows`` labelled documents; ``train`` is a condition on ``doc_id`` that chooses them."""
    sample = training_sample(docs, labels, label, F.lit(True) if train is None else train, fit_rows)

    @F.pandas_udf("binary")
    def grams(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t).tobytes())

    got = sample.select(grams("_text").alias("f"), "_good").toPandas()
    found = [np.frombuffer(f, dtype=np.uint32) for f in got["f"]]
    good = got["_good"].to_numpy(dtype=bool)
    if not len(good) or good.all() or not good.any():
        zero = np.zeros(1 << BITS)
        return QualityModel(zero, zero, 0.0 if not len(good) else 4.0 if good.all() else -4.0)
    ratios = log_count_ratios(found, good)
    weights, bias = fit_hinge(found, good, ratios, cost, epochs)
    return QualityModel(weights, ratios, bias)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to every row; reads ``text`` only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for texts in batches:
            margins = np.array([margin(features(t), known) for t in texts], dtype=float)
            yield pd.Series(1.0 / (1.0 + np.exp(-4.0 * np.clip(margins, -100.0, 100.0))))

    out = docs.withColumn("score", scored(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
