import itertools
import random
from collections import defaultdict

import numpy as np

from pyspark.sql import functions as F

from readqc.llm.packing import boundaries, pack


def padding(counts, ends):
    return sum(c * (min(e for e in ends if e >= n) - n) for n, c in enumerate(counts) if n and c)


def test_boundaries_are_optimal():
    r = random.Random(2)
    for _ in range(60):
        counts = np.array([0] + [r.choice([0, 0, 1, 5, 40]) for _ in range(9)])
        lengths = [n for n in range(1, 10) if counts[n]]
        for k in (1, 2, 3, 20):
            ends = boundaries(counts, k)
            if not lengths:
                assert ends == []
                continue
            assert len(ends) <= k and ends[-1] == lengths[-1]
            best = min(padding(counts, (*c, lengths[-1])) for m in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], m))
            assert padding(counts, ends) == best


def test_pack_keeps_everything(spark):
    r = random.Random(4)
    sizes = [r.choice([0, 1, 3, 7, 40, 64, 65, 128, 500]) for _ in range(300)]
    rows = [(i, " \t".join(["w"] * n)) for i, n in enumerate(sizes)] + [(None, "a b"), (5, None), (7, "x y"), (7, "x y")]
    frame = spark.createDataFrame([(*x, "b", 1) for x in rows], "doc_id long, text string, bucket_len string, rank int")
    got = pack(frame, max_len=64, buckets=3, budget=200).collect()
    want = defaultdict(int)
    for d, t in rows:
        want[d] += len((t or "").split())
    have = defaultdict(int)
    for x in got:
        have[x.doc_id] += x.n_tokens
        assert x.n_tokens <= 64 and x.padding == ((x.bucket_len - x.n_tokens) if x.n_tokens else 0)
    assert have == want
    batches = defaultdict(list)
    for x in got:
        if x.n_tokens:
            batches[x.batch_id].append(x)
    per = defaultdict(list)
    for b, xs in batches.items():
        assert sorted(x.slot for x in xs) == list(range(len(xs)))
        assert sum(x.bucket_len for x in xs) <= 200
        per[xs[0].bucket_len].append(len(xs))
    assert len(per) <= 3
    for end, fills in per.items():  # only the last batch of a bucket may have room
        assert sum(n < 200 // end for n in fills) <= 1


def test_ties_and_order_are_repeatable(spark):
    """Rows of one doc_id with different texts, and many copies: the same result from any partitioning."""
    r = random.Random(9)
    rows = [(d, "w " * r.randrange(1, 200), s) for d in [7] * 40 + [None] * 20 + list(range(200)) for s in [0 if d is None else d % 2]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source int")
    for order in (None, F.xxhash64("doc_id")):
        got = [sorted(map(str, pack(frame.repartition(n, "text" if n == 3 else "doc_id"), max_len=64, buckets=3, budget=640, order=order).collect())) for n in (2, 3)]
        assert got[0] == got[1]
    # by a hash, every batch holds both sources; by doc_id, a stretch of ids
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    by_batch = defaultdict(list)
    for x in pack(many, max_len=8, buckets=1, budget=300, order=F.xxhash64("doc_id")).collect():
        by_batch[x.batch_id].append(x.doc_id < 2000)
    assert len(by_batch) == 40 and all(0.3 < sum(b) / len(b) < 0.7 for b in by_batch.values())


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
