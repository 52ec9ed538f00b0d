"""Quality rules: a calibrated logistic regression on hashed n-grams of words (one and two) and characters.

Trained on at most ``MOST_ROWS`` labelled documents (quality 1 or 0), it gives each document the
probability of being good, held against two fixed thresholds: under ``REJECT`` it is rejected, from
``ACCEPT`` on accepted, in between to be reviewed. Texts are scored whole, in Arrow batches.

Defined cases: null texts and texts without any character are rejected with a null probability;
labels that are null or belong to no document are not used; of a labelled doc_id that is repeated one text
is fitted on; without two kinds of labels every other text is to be reviewed, with a null probability;
repeated rows and null doc_ids each give a row; doc_ids may be of any type; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashed_lr as lr
from .shared import pieces

MOST_ROWS = 1500
REJECT = 0.2
ACCEPT = 0.5


def features(texts: list[str]) -> np.ndarray:
    return lr.features_of(texts, pairs=True)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, label_col: str = "quality") -> lr.Model | None:
    """The model, or None without labelled documents of both kinds."""
    rows = lr.sample(docs, labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("label")), most)
    y = np.array([r["label"] for r in rows], int)
    if len(set(y)) < 2:
        return None
    return lr.fit(features([r["text"] for r in rows]), y, 2)


def _batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                for at in range(0, piece.num_rows, lr.ROWS):
                    part = piece.slice(at, lr.ROWS)
                    blank = pc.equal(pc.fill_null(pc.binary_length(part.column("text")), 0), 0).to_numpy(zero_copy_only=False)
                    p = np.zeros(part.num_rows) if model is None else lr.probabilities(model, lr.text_features(part.column("text"), pairs=True)[0])[:, 0]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, mask=blank | (model is None)), pa.array(blank)], ["doc_id", "p_good", "blank"])

    return run


def judge(docs: DataFrame, model: lr.Model | None, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, p_good, verdict): 'accept', 'review' or 'reject' for each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_batches(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, p_good double, blank boolean")
    verdict = F.when(F.col("blank") | (F.col("p_good") < reject), "reject").when(F.col("p_good") >= accept, "accept").otherwise("review")
    return scored.select("doc_id", "p_good", verdict.alias("verdict"))
