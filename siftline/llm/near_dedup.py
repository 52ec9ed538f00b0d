"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming distance, groups.

A text's fingerprint has 128 bits: the signs of the summed random signs of its distinct lower-case
words, each weighted ``1 + ln(count)``. Two texts are close if their fingerprints differ in at most
``MOST_BITS`` bits; a group is a connected component of close texts.

Candidates: the 128 bits are cut into six blocks of 21 or 22 bits (more blocks where ``most_bits`` is
above 17). Of two fingerprints within 17 bits, one block at least differs in two bits or fewer, by the
pigeonhole principle. Each fingerprint is sent to its own value of each block and to every value one
bit away (134 keys in all), where two blocks that differ in two bits meet halfway: **no close pair is
missed**. Every pair of fingerprints within a key is decided by its Hamming distance: no candidate is
capped. Of the close pairs only edges that connect the same nodes are emitted, which gives the same
groups as all pairs would, so a group of n copies costs O(n) edges.
Blocks, edges and components are of distinct fingerprints; documents meet them at the very end, so a
text that a third of all rows share is one node without an edge of its own.

Defined cases: a null or blank text is alone in its group; a text without words is close to texts
that equal it only (texts whose whole bytes hash alike count as equal); ids that are null or no whole
numbers of 64 bits are left out of the groups (and always kept by ``keep_one``); repeated rows of a doc_id
fall into one group, joined through their doc_id if their texts aren't close; an empty table gives an empty
result. Other columns are never read by ``near_groups``; ``keep_one`` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import U64, durable, mix, pieces, small_side, span_hashes, utf8, words

BITS = 128
MOST_BITS = 16
#: Keys with at most so many rows are compared side by side, larger ones by a search from row to row.
_SIDE_BY_SIDE = 256
#: Rows of keys that a task sorts, about (some 40 MB); in at most so many tasks, of which larger ones spill.
_TASK_ROWS, _MOST_TASKS = 300_000, 20_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((n, 2) 64-bit halves, which texts have a fingerprint) of lower-case texts."""
    n = len(offsets) - 1
    starts, ends, text = words(data, offsets)
    bare = np.setdiff1d(np.arange(n), text)
    if len(bare):  # the whole text, stripped, stands for its words
        filled = np.flatnonzero(~_SPACE[data])
        first, last = np.searchsorted(filled, offsets[bare]), np.searchsorted(filled, offsets[bare + 1])
        bare, first, last = bare[last > first], first[last > first], last[last > first]
        starts, ends, text = np.concatenate([starts, filled[first]]), np.concatenate([ends, filled[last - 1] + 1]), np.concatenate([text, bare])
    hashes = span_hashes(data, starts, ends)
    feature, count = np.unique((text.astype(U64) << U64(43)) | (hashes >> U64(21)), return_counts=True)
    text, feature = (feature >> U64(43)).astype(np.int64), feature & U64((1 << 43) - 1)
    weight = (1 + np.log(count)).astype(np.float32)
    out, has = np.zeros((n, 2), U64), np.zeros(n, bool)
    for at in range(0, len(feature), 1 << 15):
        part = slice(at, min(at + (1 << 15), len(feature)))
        which, first = np.unique(text[part], return_index=True)
        halves = np.stack([mix(feature[part], 1), mix(feature[part], 2)], 1)
        signs = np.unpackbits(halves.view(np.uint8), axis=1).astype(np.float32)
        signs *= weight[part, None]
        sums, total = np.add.reduceat(signs, first), np.add.reduceat(weight[part], first)
        if at == 0:
            state = np.zeros((n, BITS), np.float32)
        state[which] += 2 * sums - total[:, None]
        has[which] = True
    if has.any():
        out[has] = np.packbits(state[has] > 0, axis=1).view(U64)
    return out, has


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            halves, has = fingerprints(*utf8(piece.column("text"), lower=True))
            halves = halves[has].view(np.int64)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").filter(pa.array(has)), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "hi", "lo"])


def _ids(c: str) -> Column:
    return F.col(c).try_cast("long")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hi, lo): the 128 bits of each text that isn't blank and whose doc_id isn't null."""
    rows = docs.select(_ids(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, hi long, lo long")


def block_widths(most: int) -> list[int]:
    """Widths of the blocks of which one differs in two bits at most between any fingerprints within ``most`` bits."""
    n = max(6, min(most, BITS) // 3 + 1)  # three differing bits in each block are more than ``most``
    return [BITS // n + (k < BITS % n) for k in range(n)]


def _block_batches(most: int):
    widths = block_widths(most)
    copies = sum(widths) + len(widths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                hi, lo, node = (batch.column(c).to_numpy() for c in ("hi", "lo", "node"))
                bits = np.unpackbits(np.stack([hi, lo], 1).view(np.uint8), axis=1).astype(np.int64)
                keys, at_bit = [], 0
                for k, width in enumerate(widths):
                    own = (k << 24) | (bits[:, at_bit : at_bit + width] @ (1 << np.arange(width)))
                    keys += [own, *(own ^ (1 << i) for i in range(width))]
                    at_bit += width
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(pa.array(np.tile(x, copies)) for x in (node, hi, lo))], ["key", "node", "hi", "lo"])

    return run


def _forest(node: np.ndarray, hi: np.ndarray, lo: np.ndarray, most: int) -> list[np.ndarray]:
    """Edges of a spanning forest of the close pairs within one key."""
    edges, left, queue = [], np.arange(len(node)), []
    while len(left):
        if queue:
            at = queue.pop()
        else:
            at, left = left[0], left[1:]
        near = np.bitwise_count(hi[left] ^ hi[at]) + np.bitwise_count(lo[left] ^ lo[at]) <= most
        if near.any():
            found = left[near]
            edges.append(np.stack([np.full(len(found), node[at]), node[found]], 1))
            queue.extend(found)
            left = left[~near]
    return edges


def edges_of_keys(key: np.ndarray, node: np.ndarray, hi: np.ndarray, lo: np.ndarray, most: int) -> np.ndarray:
    """Edges that connect the nodes which the close pairs of all keys connect; rows are sorted by key."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    out = [np.zeros((0, 2), np.int64)]
    after = np.repeat(first + size, size) - np.arange(len(key))  # rows of the key from this one on
    a, step = np.flatnonzero(np.repeat(size <= _SIDE_BY_SIDE, size)), 1
    while len(a := a[after[a] > step]):
        b = a + step
        near = np.bitwise_count(hi[a] ^ hi[b]) + np.bitwise_count(lo[a] ^ lo[b]) <= most
        out.append(np.stack([node[a[near]], node[b[near]]], 1))
        step += 1
    for at, n in zip(first[size > _SIDE_BY_SIDE], size[size > _SIDE_BY_SIDE]):
        out += _forest(node[at : at + n], hi[at : at + n], lo[at : at + n], most)
    return _star_edges(np.concatenate(out))


def _star_edges(edges: np.ndarray) -> np.ndarray:
    """(least node, node) for each other node of each connected component."""
    names, at = np.unique(edges, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(names))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    tied = np.flatnonzero(root != np.arange(len(names)))
    return np.stack([names[root[tied]], names[tied]], 1)


def _edge_batches(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []

        def done(columns: list[np.ndarray]) -> pa.RecordBatch:
            edges = edges_of_keys(columns[0], columns[1], columns[2].view(U64), columns[3].view(U64), most)
            return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(c).to_numpy() for c in ("key", "node", "hi", "lo")]
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on in the next batch
            if cut:
                yield done([np.concatenate([*(k[i] for k in kept), x[:cut]]) for i, x in enumerate(now)])
                kept = []
            kept.append([x[cut:] for x in now])
        if kept:
            yield done([np.concatenate([k[i] for k in kept]) for i in range(4)])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of an edge list (a, b): root is the least node of the connected component.

    Alternating large-star and small-star steps; each state is a durable table, so lineage stays short. A
    hub's least neighbour is aggregated before the shuffle and joined to its edges, where adaptive execution
    splits what is skewed.
    """
    edges = durable(edges.where("a <> b").select("a", "b").distinct())
    last = None
    while True:
        both = edges.selectExpr("a as u", "b as v").unionByName(edges.selectExpr("b as u", "a as v"))
        large = both.join(_least(both), "u").where("v > u").selectExpr("v as u", "m as v").distinct()
        small = large.selectExpr("greatest(u, v) as u", "least(u, v) as v").where("u <> v")
        small = small.join(_least(small), "u")
        edges = durable(small.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.selectExpr("a as node", "b as root")
        last = now


def _least(both: DataFrame) -> DataFrame:
    """(u, m): the least of each node and its neighbours; summed up before the shuffle, so a hub is no burden."""
    return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, group_id, stays): the group of each doc_id, named by its least doc_id, which stays.

    One row for each distinct doc_id that isn't null.
    """
    ids = docs.select(_ids(id_col).alias("doc_id")).where("doc_id is not null").distinct()
    fp = durable(fingerprint(docs, id_col, text_col))
    nodes = fp.groupBy("hi", "lo").agg(F.min("doc_id").alias("node"))
    keys = nodes.mapInArrow(_block_batches(most_bits), "key long, node long, hi long, lo long")
    n_rows = fp.count() * (BITS + len(block_widths(most_bits)))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, min(n_rows // _TASK_ROWS, _MOST_TASKS))
    close = keys.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_edge_batches(most_bits), "a long, b long")
    of = durable(fp.join(nodes, ["hi", "lo"]).groupBy("doc_id").agg(F.min("node").alias("node"), F.max("node").alias("other")))
    # texts of one doc_id belong together, however they differ; of three or more, all are tied to the least
    again = of.where("node <> other").select("doc_id", F.col("node").alias("b"))
    several = fp.join(again, "doc_id").join(nodes, ["hi", "lo"]).selectExpr("node as a", "b").where("a <> b").distinct()
    roots = components(several.unionByName(close))
    grouped = of.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("group_id"))
    return ids.join(grouped, "doc_id", "left").selectExpr("doc_id", "coalesce(group_id, doc_id) as group_id", "doc_id = coalesce(group_id, doc_id) as stays")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``docs`` without those whose group has a lesser doc_id; of rows that are alike in doc_id and text one stays.

    All columns are kept. Rows with a null doc_id, or one that is no whole number, stay.
    """
    names = docs.columns
    flat = docs.toDF(*(f"k{i}" for i in range(len(names))))
    id_at, text_at = f"k{names.index(id_col)}", f"k{names.index(text_col)}"
    goes = durable(near_groups(flat, id_at, text_at, most_bits).where("not stays").selectExpr("doc_id as goes"))
    again = durable(flat.groupBy(F.col(id_at).alias("again")).count().where("count > 1 and again is not null").select("again"))
    left = flat.join(small_side(goes), _ids(id_at) == F.col("goes"), "left_anti")
    if not again.isEmpty():
        again = small_side(again)
        once = left.join(again, F.col(id_at) == F.col("again"), "left_anti")
        left = once.unionByName(left.join(again, F.col(id_at) == F.col("again"), "left_semi").dropDuplicates([id_at, text_at]))
    return left.toDF(*names)
