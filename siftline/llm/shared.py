"""What the operators here share: durable intermediate tables, size-checked joins, and text as NumPy arrays.

Texts are handled as the UTF-8 bytes of Arrow batches. A batch is cut into pieces of about
``PIECE_BYTES`` of whole texts (a longer text is a piece by itself), so the temporary arrays stay
near the CPU caches and memory doesn't depend on how Spark cut its batches.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 20
#: A side of a join with at most so many rows of a few numbers is broadcast (16 MB or so).
BROADCAST_ROWS = 1_000_000

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


# ---------------------------------------------------------------- durable intermediate tables
def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder of this machine, in local mode only (as in tests); elsewhere it is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if not (at := spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="siftline-")
        atexit.register(shutil.rmtree, at, True)
        spark.sparkContext.setCheckpointDir(at)
    return at


def durable(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder; later reads survive the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/siftline-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """As ``durable``, but as compressed Parquet, for wider tables. ``clear`` removes them."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes every table that this application has ``written``; to be called when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_side(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A durable ``small`` of a few numeric columns, hinted for broadcast if its counted rows allow it."""
    return F.broadcast(small) if small.count() <= rows else small


def modest_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lets the session's Arrow batches grow to ``most`` bytes, unless it has a limit of its own (Spark's is 64 MB, for each worker and task)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64MB", "67108864"):
        spark.conf.set(key, f"{most}b")


# ---------------------------------------------------------------- texts as arrays
def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of the batch with about ``most`` bytes of ``column``, one row at least."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype("f8")))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def utf8(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text index) of the maximal runs of ASCII letters, ASCII digits and non-ASCII bytes."""
    inside = _WORD[data]
    edge = np.empty(len(data) + 1, bool)
    edge[:1], edge[-1:] = False, False
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(s, offsets)))


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE_BYTES), base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 4 * PIECE_BYTES:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finalizer of SplitMix64)."""
    x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span lies."""
    if not len(starts):
        return np.zeros(0, U64)
    n = len(data)
    sums = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * _power("up", _P, n), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power("down", _P_INV, n + 1)[starts]
    return mix(raw ^ ((ends - starts).astype(U64) << U64(48)))


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets in code points)."""
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), heads[offsets]
