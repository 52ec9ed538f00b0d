"""Byte-pair encoding through a table of distinct words, and decoding through the table of pieces.

``encode`` splits every text into words (the pieces that the vocabulary's pattern gives), encodes each
distinct word of the corpus once, and joins the ids back to the words' positions. ``decode`` joins each
id to its piece and glues the pieces.

The table of distinct words has two parts, at every size of the corpus:

- the head, at most ``HEAD_WORDS`` words that are met most often (some 35 MB), is broadcast;
- every other word is shuffled: each block of rows (about 1 MB of whole texts) asks once for each of its
  distinct words, the requests are sorted by word, each word is encoded once, and the answers are sent to
  the block, where they meet its rows, which are shuffled as one compressed blob.

Words are told apart by their bytes; hashes only narrow the search in the head. The head only decides
which way a word's ids come; any choice of it gives the same result.

The splitting is done for a whole block at once on arrays of character classes; it gives what
``PATTERN`` gives.

Defined cases: a null text gives null ids and a null count, an empty one no ids and 0; repeated rows
and null or repeated ids of documents each give a row of their own; special tokens' strings are ordinary
text; columns that aren't in ``keep`` are never read, and kept ones called ``token_ids`` or ``n_tokens``
give way to the new ones. Requests and blobs are made in two passes over the rows: rows whose plan has a
shuffle are written first, and a block whose passes differ all the same is an error, never a wrong result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import code_points, modest_batches, pieces, span_hashes, utf8, written

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HEAD_WORDS = 1 << 20
#: Words are counted over so many pieces before those met fewer than LEAST_MET times are left to the tail.
WINDOW = 32
LEAST_MET = 2
OTHER, LETTER, NUMBER, SPACE = range(4)


@cache
def _classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    everything = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")]).tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            table[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each word, with the end of the last one appended; number of words before each text)."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    points, bounds = code_points(data, offsets)
    n = len(points)
    kind = _classes()[points]
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    begins = np.zeros(n + 1, bool)
    begins[bounds] = True
    start |= begins
    # white space before something else: its last character is joined to it if it's a blank, else alone
    after = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~begins[1:n]) + 1
    start[after - 1] = True
    start[after] = points[after - 1] != 32
    # 's and its kind, where a word begins with the apostrophe
    quotes = np.flatnonzero((points[:-1] == 39) & (kind[1:] == LETTER) & start[:-2] & ~begins[1:n])
    for i in quotes:
        tail = "".join(map(chr, points[i + 1 : i + 3])) if not begins[i + 2] else chr(points[i + 1])
        length = 1 if tail[0] in "stmd" else 2 if tail in ("re", "ve", "ll") else 0
        if length:
            start[i + 1 : i + 1 + length] = False
            start[i + 1 + length] = True
    at = np.flatnonzero(start)
    counts = np.searchsorted(at, bounds)
    if n != len(data):
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[at]
    return at, counts


def tiles(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The words that ``split`` cuts the bytes into, dictionary-encoded by their bytes."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()


@cache
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _flat(offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the elements of the chosen lists, end of each list among them)."""
    counts = offsets[which + 1] - offsets[which]
    ends = np.cumsum(counts)
    return np.repeat(offsets[which] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0), ends


def _bounds(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _hashes(words: pa.Array) -> np.ndarray:
    data, offsets = utf8(words)
    return span_hashes(data, offsets[:-1], offsets[1:])


# ---------------------------------------------------------------- the head
class Head(NamedTuple):
    hashes: np.ndarray  # sorted, each once
    words: pa.Array
    offsets: np.ndarray  # of each word's ids in ``ids``
    ids: np.ndarray

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word, -1 for words that aren't in the head."""
        out = np.full(len(words), -1)
        if len(self.hashes) and len(words):
            hashes = _hashes(words)
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            maybe = np.flatnonzero(self.hashes[at] == hashes)
            same = pc.equal(words.take(pa.array(maybe)), self.words.take(pa.array(at[maybe]))).to_numpy(zero_copy_only=False)
            out[maybe[same]] = at[maybe[same]]
        return out


def head_of(words: pa.Array, lists: pa.Array) -> Head:
    """Of words with the same hash one is in the head, the others are left to the tail."""
    hashes, first = np.unique(_hashes(words), return_index=True)
    lists = lists.take(pa.array(first))
    ids = lists.flatten().to_numpy()
    kind = np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.int32
    return Head(hashes, words.take(pa.array(first)), _bounds(pc.list_value_length(lists).to_numpy(zero_copy_only=False)), ids.astype(kind))


def _met_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def counted() -> pa.RecordBatch:
        got = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
        got = got.filter(pc.greater_equal(got.column("n_sum"), LEAST_MET)).combine_chunks()
        held.clear()
        return pa.RecordBatch.from_arrays([got.column(c).combine_chunks() if got.num_rows else pa.array([], t) for c, t in (("word", pa.binary()), ("n_sum", pa.int64()))], ["word", "n"])

    for batch in batches:
        for piece in pieces(batch, "text"):
            data, offsets = utf8(piece.column("text"))
            words = tiles(data, split(data, offsets)[0])
            held.append(pa.table({"word": words.dictionary, "n": np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))}))
            if len(held) == WINDOW:
                yield counted()
    if held:
        yield counted()


def _encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for batch in batches:
            ids = pa.array([encode(w.decode()) for w in batch.column("word").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), ids], ["word", "ids"])

    return run


def head_table(texts: DataFrame, path: str, most: int = HEAD_WORDS) -> DataFrame:
    """(word, ids): the words of the column ``text`` that are met most often, each encoded once; ``most`` rows at most."""
    met = texts.mapInArrow(_met_batches, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return met.orderBy(F.desc("n"), "word").limit(most).select("word").mapInArrow(_encode_batches(path), "word binary, ids array<int>")


# ---------------------------------------------------------------- the tail
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The pieces of a partition, numbered; the same for every pass over the same rows."""
    number = 0
    for batch in batches:
        for piece in pieces(batch, "text"):
            yield (piece.column("part")[0].as_py() << 32) + number, piece
            number += 1


def _request_batches(head):
    """A row for each distinct word of a block that the head lacks, and one of rank -1 with the checksum of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, piece in _blocks(batches):
            data, offsets = utf8(piece.column("text"))
            words = tiles(data, split(data, offsets)[0]).dictionary
            words = words.filter(pa.array(head.value.find(words) < 0))
            asked = pa.concat_arrays([pa.array([zlib.crc32(data).to_bytes(4, "big")], pa.binary()), words])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asked), block)), pa.array(np.arange(-1, len(asked) - 1, dtype=np.int32)), asked], ["block", "rank", "word"])

    return run


def _answer_batches(path: str):
    """Rows sorted by word: each distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, known = _encoder(path).encode_ordinary, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            special = batch.column("rank").to_numpy() < 0
            found = batch.column("word").filter(pa.array(~special)).dictionary_encode()
            ids = []
            for word in found.dictionary.to_pylist():
                if word != last:
                    known, last = np.array(encode(word.decode()), "<i4").tobytes(), word
                ids.append(known)
            at = np.empty(len(special), np.int64)
            at[~special], at[special] = found.indices.to_numpy(), len(ids) + np.arange(special.sum())
            ids += batch.column("word").filter(pa.array(special)).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("rank"), pa.array(ids, pa.binary()).take(pa.array(at))], ["block", "rank", "data"])

    return run


def _blob_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: its rows, compressed."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    for block, piece in _blocks(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, piece.schema, options=options) as out:
            out.write_batch(piece)
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-2], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rank", "data"])


class RowsDiffer(RuntimeError):
    """Two passes over the rows gave different blocks."""


def _lists(bounds: np.ndarray, values: np.ndarray, texts: pa.Array) -> pa.Array:
    offsets = pa.array(bounds.astype(np.int32), mask=np.append(pc.is_null(texts).to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(offsets, pa.array(values))


def placed(piece: pa.RecordBatch, head: Head, answers: pa.Array) -> pa.Array:
    """The ids of each text: the head's, and those of the other distinct words (packed) in the order in which they first occur."""
    data, offsets = utf8(piece.column("text"))
    at, counts = split(data, offsets)
    words = tiles(data, at)
    where = head.find(words.dictionary)
    other = np.flatnonzero(where < 0)
    if len(other) != len(answers):
        raise RowsDiffer("the rows were read in another order or number; write them to a table first")
    where[other] = len(head.offsets) - 1 + np.arange(len(other))
    bounds = np.concatenate([head.offsets, head.offsets[-1] + np.cumsum(pc.binary_length(answers).to_numpy(zero_copy_only=False) // 4, dtype=np.int64)])
    own, ends = _flat(bounds, where)  # the ids of the piece's distinct words, in the head and then in the answers
    pool, inside = np.empty(len(own), np.int32), own < len(head.ids)
    pool[inside], pool[~inside] = head.ids[own[inside]], np.frombuffer(b"".join(answers.to_pylist()), "<i4")[own[~inside] - len(head.ids)]
    own, bounds = pool, np.concatenate([[0], ends])
    positions, ends = _flat(bounds, words.indices.to_numpy())
    return _lists(np.concatenate([[0], ends])[counts], own[positions], piece.column("text"))


def _assemble_batches(head, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, check, answers, now = None, None, [], None

        def flush() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            if blob is None or check is None:
                raise RowsDiffer("a block lacks its rows or its requests; write the rows to a table first")
            for piece in pa.ipc.open_stream(blob):
                if zlib.crc32(utf8(piece.column("text"))[0]).to_bytes(4, "big") != check:
                    raise RowsDiffer("the rows were read in another order; write them to a table first")
                ids = placed(piece, head.value, pa.concat_arrays(answers) if answers else pa.array([], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), ids], [*keep, "token_ids"])
            pa.default_memory_pool().release_unused()

        for batch in batches:
            if not batch.num_rows:
                continue
            block, rank = batch.column("block").to_numpy(), batch.column("rank").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            for a, b in zip(first, [*first[1:], len(block)]):
                if block[a] != now:
                    yield from flush()
                    blob, check, answers, now = None, None, [], block[a]
                special = int(np.searchsorted(rank[a:b], 0))
                for i in range(a, a + special):
                    if rank[i] == -2:
                        blob = batch.column("data")[i].as_buffer()
                    else:
                        check = batch.column("data")[i].as_py()
                if a + special < b:
                    answers.append(batch.column("data").slice(a + special, b - a - special))
        yield from flush()

    return run


def encode(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}", head_words: int = HEAD_WORDS) -> DataFrame:
    """The columns ``keep`` of each row, ``token_ids`` and ``n_tokens``."""
    modest_batches(docs.sparkSession)
    keep = tuple(c for c in keep if c not in ("token_ids", "n_tokens"))
    names = [f"__k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col(text_col).cast("string").alias("text"))
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = written(rows)
    got = head_table(rows.select("text"), vocabulary, head_words).toArrow()
    rows = rows.withColumn("part", F.spark_partition_id())  # of the rows' own plan, also within a union
    head = docs.sparkSession.sparkContext.broadcast(head_of(*(pa.concat_arrays(got.column(c).chunks) if got.num_rows else pa.array([], t) for c, t in (("word", pa.binary()), ("ids", pa.list_(pa.int32()))))))
    asked = rows.mapInArrow(_request_batches(head), "block long, rank int, word binary")
    answers = asked.repartition("word").sortWithinPartitions("word").mapInArrow(_answer_batches(vocabulary), "block long, rank int, data binary")
    blobs = rows.mapInArrow(_blob_batches, "block long, rank int, data binary")
    both = answers.unionByName(blobs).repartition("block").sortWithinPartitions("block", "rank")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names), "token_ids array<int>"])
    out = both.mapInArrow(_assemble_batches(head, names), schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), "token_ids", F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).alias("n_tokens"))


# ---------------------------------------------------------------- decoding
@cache
def _piece_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    with open(path, "rb") as f:
        by_id = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    return np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), np.frombuffer(b"".join(parts), np.uint8)


def _decode_batches(ids_at: int, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets, flat = _piece_table(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                lists = batch.column(ids_at)
                ids = pc.fill_null(lists.flatten(), -1).to_numpy()
                known = (ids >= 0) & (ids < len(offsets) - 1)
                positions, ends = _flat(offsets, np.where(known, ids, 0)[known])
                ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(known)])]
                bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
                data, cuts = flat[positions], ends[bounds]
                texts = [None if gone else data[a:b].tobytes().decode("utf-8", "replace") for gone, a, b in zip(pc.is_null(lists).to_pylist(), cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, ids_col: str = "token_ids", vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """``encoded`` with ``decoded``: each id joined to its piece, glued in order.

    The table of pieces has the size of the vocabulary, whatever the corpus, so each batch joins it in
    place. Null ids and ids that the vocabulary lacks give nothing; a null list gives null; bytes that
    aren't UTF-8 give U+FFFD; a column that is called ``decoded`` gives way to the new one.
    """
    modest_batches(encoded.sparkSession)
    encoded = encoded.select(*(F.col(f"`{c}`") for c in encoded.columns if c != "decoded"))
    names = encoded.columns
    flat = encoded.toDF(*(f"__k{i}" for i in range(len(names))))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema), "decoded string"])
    return flat.mapInArrow(_decode_batches(names.index(ids_col), vocabulary), schema).toDF(*names, "decoded")
