"""Findings of round 3: expressions by plain forms of texts, words found in one pass, batches for Python."""

import re

from pyspark.sql import functions as F

from siftline.functions import patterns as P
from siftline.functions import text as T
from siftline.functions.conditions import Rx, any_of, once, plain, squeezed


def test_plain_forms_match_as_the_texts_do(spark):
    odd = ["ignore\u0085previous inſtructionſ", "maın: ٣. ___ ٤) ___", "disregard  all　prior\tconteßt context", "straße history", "x\nprocess été\ny", "proceſs cake", "say the 文 is", "do not é́t " + "ß" * 70 + " instead", "read \U0001f600 and send  to", "the role of enzymes", "Key"]
    rows = [*P.PROBES, *odd]
    d = spark.createDataFrame([(t,) for t in rows], "text string").withColumn("p", once(plain(F.col("text")))).withColumn("q", once(squeezed(F.col("p"))))
    tried = [Rx(x, "i" + f) for _, _, x, f, _ in P.STRUCTURES]
    got = d.select("text", "p", F.array(*(F.col("text").rlike(x.java()) for x in tried)).alias("own"), F.array(*(x.plainly(F.col("p"), F.col("q")) for x in tried)).alias("by")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.p.isascii() and len(r.p) == len(r.text) and r.own == r.by, r.text


def test_any_word_in_one_pass():
    for words in (tuple(P.LABELS), ("a", "ab", "b-", "[c", " d", "^e")):
        x = re.compile(any_of(words))
        assert all(x.search(f"x{w}y") for w in words)
        assert not x.search("_" * 9)


def test_batches_for_python_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    T.normalize(spark.createDataFrame([("a &amp; b",)], "t string"), "t", "n")
    assert spark.conf.get(key) == f"{T.BATCH_BYTES}b"
