"""Findings of round 2, each with a test that failed before."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.llm import near_dedup
from siftline.llm.shared import U64, utf8


def pairs_at(distances, per_distance, seed=5):
    """(halves, distance of each pair): rows 2i and 2i + 1 differ in so many random bits, all others in some 64."""
    r = np.random.default_rng(seed)
    distances = np.repeat(distances, per_distance)
    base = r.integers(0, 256, (len(distances), 16), dtype=np.uint8)
    flips = np.zeros((len(distances), near_dedup.BITS), np.uint8)
    for row, d in zip(flips, distances):
        row[r.permutation(near_dedup.BITS)[:d]] = 1
    both = np.stack([base, base ^ np.packbits(flips, axis=1)], 1).reshape(-1, 16)
    return both.view(np.int64), distances


@pytest.fixture
def given_fingerprints(monkeypatch):
    """Takes columns hi and lo for the fingerprint of the texts."""
    monkeypatch.setattr(near_dedup, "fingerprint", lambda docs, id_col="doc_id", text_col="text": docs.select(F.col(id_col).alias("doc_id"), "hi", "lo"))


# ---------------------------------------------------------------- F1
@pytest.mark.parametrize("most", [3, 16, 17, 24])
def test_every_pair_within_the_threshold_is_linked(spark, given_fingerprints, most):
    halves, distances = pairs_at(np.arange(max(0, most - 6), most + 3), 60)
    docs = spark.createDataFrame([(i, "x", int(hi), int(lo)) for i, (hi, lo) in enumerate(halves)], "doc_id long, text string, hi long, lo long")
    got = {r.doc_id: r.group_id for r in near_dedup.near_groups(docs, most_bits=most).collect()}
    assert got == {i: i - i % 2 if distances[i // 2] <= most else i for i in range(len(halves))}


@pytest.mark.parametrize("n", [2, 9, 200, 300, 700])
def test_keys_of_any_size_connect_what_all_pairs_connect(n):
    r = np.random.default_rng(n)
    base = r.integers(0, 1 << 63, (max(1, n // 12), 2)).astype(U64)
    rows = base[r.integers(0, len(base), n)]
    for _ in range(7):  # chains: some of a base's rows are near through others only
        rows[:, 0] ^= U64(1) << r.integers(0, 64, n).astype(U64)
    near = np.bitwise_count(rows[:, None] ^ rows[None]).sum(2) <= 11
    root = np.arange(n)
    while (root != (up := np.where(near, root[None], n).min(1))).any():
        root = up
    edges = near_dedup.edges_of_keys(np.zeros(n, np.int64), np.arange(n), rows[:, 0], rows[:, 1], 11)
    assert len(edges) == n - len(np.unique(root)) and (root[edges[:, 0]] == root[edges[:, 1]]).all()


# ---------------------------------------------------------------- F2
def test_the_pipeline_keeps_one_of_every_close_pair_of_texts(spark):
    import corpus_pipeline

    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(3000)]
    texts = []
    for _ in range(500):
        base = [r.choice(words) for _ in range(120)]
        changed = [r.choice(words) if r.random() < 0.055 else w for w in base]
        texts += [" ".join(base), " ".join(changed)]
    halves, has = near_dedup.fingerprints(*utf8(pa.array(texts), lower=True))
    near = np.bitwise_count(halves[:, None] ^ halves[None]).sum(2) <= near_dedup.MOST_BITS
    alone = [i for i in range(len(texts)) if not near[i, :i].any()]
    assert has.all() and near.sum() == len(texts) + 2 * (len(texts) - len(alone)) and 550 < len(alone) < 900  # pairs only
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    assert sorted(x.doc_id for x in kept.collect()) == alone
