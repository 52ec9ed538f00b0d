"""Language identification by string kernels.

A text is lower-cased, every run of characters that aren't letters becomes a blank, and its blended
spectrum is the set of its character n-grams of orders 1 to ``MOST_N``, hashed to ``BUCKETS``
buckets. The kernel of two texts is the number of grams present in both, divided by the geometric
mean of their own numbers. Some labelled texts are Nystrom landmarks: kernel values against them,
whitened, are the features of one-versus-rest kernel ridge regressions, whose weights fold into one
matrix, so a batch is scored by two matrix products.

Fitting uses at most ``PER_LABEL`` labelled texts of each language (the least hashes of doc_id),
``LANDMARKS`` of them as landmarks. Scoring covers every row and the whole of each text.

Defined cases: texts that are null or have no letters get a null language and are rejected; rows with
a null label or id aren't fitted on; repeated rows each give a row, and one of them is fitted on; with no labelled text at all every text
is rejected; equal scores go to the language first in the alphabet; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import code_points, pieces, utf8

MOST_N = 3
BUCKETS = 1 << 15
PER_LABEL = 200
LANDMARKS = 64
RIDGE = 0.1
#: A text is rejected if its best score is under LEAST_SCORE, or leads by less than LEAST_LEAD.
LEAST_SCORE = -0.5
LEAST_LEAD = 0.1
_ROWS = 256
_ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


class Model(NamedTuple):
    labels: list[str]
    columns: np.ndarray  # the buckets that some landmark has
    landmarks: np.ndarray  # (columns, landmarks), 0 or 1 over the root of the landmark's own number
    weights: np.ndarray  # (landmarks, labels)


@cache
def _letters() -> np.ndarray:
    import regex

    table = np.zeros(0x110000, bool)
    for m in regex.finditer(r"[\p{L}\p{M}]+", np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")]).tobytes().decode("utf-32-le")):
        table[ord(m[0][0]) : ord(m[0][-1]) + 1] = True
    table[0xD800:0xE000] = False
    return table


def spectra(texts: pa.Array) -> np.ndarray:
    """(texts, BUCKETS) of 0 and 1: the n-grams present."""
    points, bounds = code_points(*utf8(texts, lower=True))
    n = len(bounds) - 1
    present = np.zeros((n, BUCKETS), np.uint8)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    keep[first] = letter[first]
    kept = np.concatenate([[0], np.cumsum(keep)])
    points, bounds = np.where(letter, points, 32)[keep].astype(np.uint32), kept[bounds]
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds))
    flat = present.reshape(-1)
    total = np.zeros(len(points), np.uint32)
    for order in range(1, MOST_N + 1):
        m = len(points) - order + 1
        if m <= 0:
            break
        total = total[:m] + points[order - 1 :] * np.uint32(_ODD[order - 1])
        bucket = ((total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
        inside = row[order - 1 :] == row[:m]
        flat[(row[:m] * BUCKETS + bucket)[inside]] = 1
    return present


def _kernel(present: np.ndarray, columns: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    own = np.maximum(present.sum(1, dtype=np.float32), 1)
    return (present[:, columns].astype(np.float32) @ landmarks) / np.sqrt(own)[:, None]


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The model of labelled texts; the first ``landmarks`` texts of each label are its landmarks."""
    names, x = sorted(set(labels)), spectra(pa.array(texts, pa.string()))
    which = np.array([names.index(y) for y in labels], int)
    marks = np.concatenate([np.flatnonzero(which == k)[:landmarks] for k in range(len(names))]) if names else np.zeros(0, int)
    columns = np.flatnonzero(x[marks].any(0)) if len(marks) else np.zeros(0, int)
    z = x[marks][:, columns].astype(np.float32)
    z = (z / np.sqrt(np.maximum(x[marks].sum(1), 1))[:, None]).T.astype(np.float32)
    if not names:
        return Model([], columns, z, np.zeros((0, 0), np.float32))
    k = _kernel(x, columns, z).astype(float)
    values, vectors = np.linalg.eigh(k[marks])
    good = values > 1e-6 * values.max()
    white = vectors[:, good] / np.sqrt(values[good])
    phi = k @ white
    target = np.where(which[:, None] == np.arange(len(names)), 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ target)
    return Model(names, columns, z, (white @ w).astype(np.float32))


def scores(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """((texts, labels) scores, which texts have letters)."""
    present = spectra(texts)
    return _kernel(present, model.columns, model.landmarks) @ model.weights, present.any(1)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = PER_LABEL) -> Model:
    """The model of at most ``per_label`` texts of each label, one for each id; only ids and labels are read to choose them.

    A text goes with the label of its own row; of several texts of an id and label the one with the least hash counts.
    """
    by = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    text = lambda c: F.col(c).cast("string")
    ids = docs.select(text(id_col).alias("id"), text(label_col).alias("label")).where("id is not null and label is not null").distinct().withColumn("n", F.row_number().over(by)).where(F.col("n") <= per_label)
    rows = docs.select(text(id_col).alias("id"), text(label_col).alias("label"), text(text_col).alias("text")).where("text is not null")
    got = rows.join(F.broadcast(ids), ["id", "label"]).groupBy("label", "n").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).toArrow().to_pylist()
    got.sort(key=lambda r: (r["label"], r["n"]))
    return fit([r["text"] for r in got], [r["label"] for r in got])


def _score_batches(model, keep: list[str], least_score: float, least_lead: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            for piece in pieces(batch, "__text"):
                for at in range(0, piece.num_rows, _ROWS):
                    part = piece.slice(at, _ROWS)
                    n = part.num_rows
                    if m.labels:
                        s, known = scores(m, part.column("__text"))
                        best = s.argmax(1)
                        top = s[np.arange(n), best].astype(float)
                        lead = top - np.sort(s, axis=1)[:, -2] if len(m.labels) > 1 else np.full(n, np.inf)
                        names = np.array(m.labels, object)[best]
                    else:
                        known, top, lead, names = np.zeros(n, bool), np.zeros(n), np.zeros(n), np.full(n, None)
                    ok = known & (top >= least_score) & (lead >= least_lead)
                    columns = [pa.array(names, pa.string(), mask=~known), pa.array(top, mask=~known), pa.array(lead.astype(float), mask=~known), pa.array(ok)]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], [*keep, "__lang", "__score", "__lead", "__ok"])

    return run


def _scored(docs: DataFrame, model: Model, text_col: str, keep: list[str], least_score: float, least_lead: float) -> DataFrame:
    """The columns ``keep``, by position as __k0, __k1 ..., and the four of the decision."""
    rows = docs.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)), F.col(text_col).cast("string").alias("__text"))
    names = [f"__k{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"), "__lang string, __score double, __lead double, __ok boolean"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score_batches(shared, names, least_score, least_lead), schema)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE, least_lead: float = LEAST_LEAD) -> DataFrame:
    """(doc_id, language, score, lead, accepted) for each row."""
    return _scored(docs, model, text_col, [id_col], least_score, least_lead).toDF("doc_id", "language", "score", "lead", "accepted")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = LEAST_SCORE, least_lead: float = LEAST_LEAD) -> DataFrame:
    """The accepted rows of ``docs`` with all their columns."""
    got = _scored(docs, model, text_col, docs.columns, least_score, least_lead).where("__ok")
    return got.select(*(F.col(f"__k{i}").alias(c) for i, c in enumerate(docs.columns)))
