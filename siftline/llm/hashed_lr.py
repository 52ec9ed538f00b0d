"""Logistic regression on hashed n-grams, shared by the quality rules, the mixing and the URL filters.

A text's features are the square roots of the relative frequencies of its hashed grams, so each group
of grams (words, characters of each kind) has length one whatever the length of the text. Fitting is
exact Newton (iteratively reweighted least squares) on the Gram matrix of the bounded training sample;
probabilities are calibrated by a logistic curve through out-of-fold scores. Scoring is one product of
each batch's feature matrix and the weights.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U64, code_points, mix, span_hashes, utf8, words

ROWS = 256
WORD_BITS = 13
CHAR_BITS = 14
ORDERS = (2, 3, 4)
RIDGE = 0.05
FOLDS = 3
_ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)


class Model(NamedTuple):
    weights: np.ndarray  # (features, classes)
    bias: np.ndarray
    slope: np.ndarray  # of the calibration, by class
    shift: np.ndarray


def _counts(row: np.ndarray, bucket: np.ndarray, n: int, size: int) -> np.ndarray:
    return np.bincount(row * size + bucket.astype(np.int64), minlength=n * size).reshape(n, size).astype(np.float32)


def _unit(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1))


def char_counts(texts: pa.Array, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """(texts, 2 ** bits) numbers of the hashed n-grams of code points."""
    points, bounds = code_points(*utf8(texts))
    n = len(bounds) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds))
    total, flat = np.zeros(len(points), np.uint32), np.zeros(n << bits, np.int64)
    for order in range(1, max(orders) + 1):
        m = len(points) - order + 1
        if m <= 0:
            break
        total = (total[:m] ^ (total[:m] >> np.uint32(13))) * np.uint32(_ODD[0]) + points[order - 1 :] * np.uint32(_ODD[order - 1])
        if order in orders:
            bucket = ((total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)
            inside = row[order - 1 :] == row[:m]
            flat += np.bincount(((row[:m] << bits) + bucket)[inside], minlength=n << bits)
    return flat.reshape(n, 1 << bits).astype(np.float32)


def text_features(texts: pa.Array, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """((texts, features), number of words): words in lower case (and pairs of words that follow each other), and n-grams of characters as they are."""
    data, offsets = utf8(texts, lower=True)
    starts, ends, row = words(data, offsets)
    hashes, n = span_hashes(data, starts, ends), len(offsets) - 1
    by_word = _counts(row, hashes >> U64(64 - WORD_BITS), n, 1 << WORD_BITS)
    groups = [_unit(by_word)]
    if pairs:
        both = row[1:] == row[:-1]
        bucket = mix(hashes[:-1][both] * U64(0x9E3779B97F4A7C15) + hashes[1:][both]) >> U64(64 - WORD_BITS)
        groups.append(_unit(_counts(row[1:][both], bucket, n, 1 << WORD_BITS)))
    return np.concatenate([*groups, _unit(char_counts(texts, ORDERS, CHAR_BITS))], 1), by_word.sum(1).astype(np.int64)


def features_of(texts: list[str], pairs: bool = False) -> np.ndarray:
    """(texts, features) of a training sample, in one array that is filled part by part."""
    out = np.zeros((len(texts), ((2 if pairs else 1) << WORD_BITS) + (1 << CHAR_BITS)), np.float32)
    for at in range(0, len(texts), ROWS // 4):
        out[at : at + ROWS // 4] = text_features(pa.array(texts[at : at + ROWS // 4], pa.string()), pairs)[0]
    return out


def _newton(gram: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Dual coefficients: the weights are the training rows' sum by these."""
    a, n = np.zeros(len(y)), len(y)
    for _ in range(25):
        z = gram @ a
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-5)
        new = np.linalg.solve(gram + np.diag(ridge / w), z + (y - p) / w)
        done = np.abs(new - a).max() < 1e-4 * max(1.0, np.abs(a).max())
        a = new
        if done or n == 0:
            break
    return a


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve from scores to probabilities, with Platt's smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, theta = np.stack([score, np.ones(len(y))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - target))
        theta = theta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def fit(x: np.ndarray, y: np.ndarray, classes: int, ridge: float = RIDGE) -> Model:
    """One-versus-rest logistic regressions of the rows ``x`` with classes ``y``, each calibrated out of fold.

    With two classes or fewer, one regression for class 1.
    """
    targets = range(1, classes) if classes <= 2 else range(classes)
    gram = (x @ x.T).astype(float) + 1.0  # 1: the bias, penalized as any weight
    fold = np.arange(len(y)) % FOLDS
    duals, slopes, shifts = [], [], []
    for k in targets:
        t = (y == k).astype(float)
        out = np.zeros(len(y))
        for f in range(FOLDS):
            inside, held = fold != f, fold == f
            if held.any() and inside.any():
                out[held] = gram[np.ix_(held, inside)] @ _newton(gram[np.ix_(inside, inside)], t[inside], ridge)
        slope, shift = _platt(out, t) if 0 < t.sum() < len(t) else (1.0, 0.0)
        duals.append(_newton(gram, t, ridge) if len(t) else np.zeros(0))
        slopes.append(slope)
        shifts.append(shift)
    dual = np.stack(duals, 1)
    return Model(x.T @ dual.astype(x.dtype), dual.sum(0), np.array(slopes), np.array(shifts))


def probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    """(rows, regressions) of calibrated probabilities."""
    z = (x @ model.weights + model.bias) * model.slope + model.shift
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """At most ``most`` rows {id, label, text}, one for each id that both ``docs`` and ``labels`` (id, label) have, by the least hashes of ids.

    Ids of any type are compared as strings. Several labels of an id count as the greatest; of several
    texts of an id the one with the least hash counts, chosen before anything is collected; null texts are left out.
    """
    text = lambda c: F.col(c).cast("string")
    labels = labels.select(text("id").alias("id"), "label").where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    chosen = labels.withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(most)
    rows = docs.select(text(id_col).alias("id"), text(text_col).alias("text")).where("text is not null")
    got = rows.join(F.broadcast(chosen), "id").groupBy("place", "id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return sorted(got.toArrow().to_pylist(), key=lambda r: (r["place"], r["id"]))
