"""URL filters: logistic regression on hashed character n-grams of host and path.

Trained from the small labelled table of ``url_labels`` (or one given); a URL whose calibrated probability
of being unwanted reaches ``DROP`` is dropped. The scheme, user, port, query and fragment don't count.

Defined cases: null and empty URLs, and those without a host, are kept with a null probability; a URL
without a scheme has a host if what stands first holds a dot; repeated rows each give a row; a table of one
class only gives null probabilities and keeps all; an empty table gives none; page ids may be null or of any
type; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashed_lr as lr
from . import url_labels

DROP = 0.5
ORDERS = (3, 4, 5)
BITS = 14
RIDGE = 0.1
#: A path says less of a URL than its host.
PATH_WEIGHT = 0.3
ROWS = 128
#: With or without a scheme; without one, the host must have a dot.
_HOST = r"^(?:(?:[a-z][a-z0-9+.-]*:)?//)?(?:[^/?#@]*@)?(?P<host>[^/?#:@\s]*\.[^/?#:@\s]+)(?:[:/?#].*)?$"
_BARE = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?P<host>[^/?#:]+)"
_PATH = r"^(?:(?:[a-z][a-z0-9+.-]*:)?//)?[^/?#]*(?P<path>[^?#]*)"

LABELLED: list[tuple[str, int]] = url_labels.labelled()


def features(hosts: pa.Array, paths: pa.Array) -> np.ndarray:
    return np.concatenate([lr._unit(lr.char_counts(hosts, ORDERS, BITS)), PATH_WEIGHT * lr._unit(lr.char_counts(paths, ORDERS, BITS))], 1, dtype=np.float32)


def _split(urls: pa.Array) -> tuple[pa.Array, pa.Array]:
    urls = pc.utf8_lower(pc.fill_null(urls.cast(pa.string()), ""))
    take = lambda expression: pc.fill_null(pc.struct_field(pc.extract_regex(urls, expression), 0), "")
    hosts = take(_HOST)
    hosts = pc.if_else(pc.equal(hosts, ""), take(_BARE), hosts)
    return hosts, pc.if_else(pc.equal(hosts, ""), "", take(_PATH))


def train(labelled: list[tuple[str, int]] | None = None) -> lr.Model | None:
    """The model of a labelled table, 1 for unwanted; None without both classes."""
    rows = sorted(LABELLED if labelled is None else labelled, key=lambda r: hash_of(r[0]))
    y = np.array([c for _, c in rows], int)
    if len(set(y)) < 2:
        return None
    hosts, paths = _split(pa.array([u for u, _ in rows], pa.string()))
    return lr.fit(np.concatenate([features(hosts[i : i + ROWS], paths[i : i + ROWS]) for i in range(0, len(rows), ROWS)]), y, 2, RIDGE)


def hash_of(url: str) -> int:
    """A fixed order that mixes the classes."""
    return zlib.crc32(url.encode())


def _batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                hosts, paths = _split(batch.column("url"))
                none = pc.equal(pc.binary_length(hosts), 0).to_numpy(zero_copy_only=False) | (model is None)
                p = np.zeros(batch.num_rows) if model is None else lr.probabilities(model, features(hosts, paths))[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(p, mask=none), pa.array(none | (p < DROP))], ["page_id", "url", "p_unwanted", "keep"])

    return run


def judge(pages: DataFrame, model: lr.Model | None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, p_unwanted, keep) for each row."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(_batches(pages.sparkSession.sparkContext.broadcast(model)), f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, p_unwanted double, keep boolean")
