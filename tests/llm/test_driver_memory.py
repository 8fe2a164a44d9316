"""What passes through the driver stays small however often rows are sent to many parts."""

from contextlib import contextmanager

import numpy as np
from pyspark.sql import functions as F

from tallyhouse.llm import hard_negatives, mips

VECTORS = "vec_id long, embedding array<double>, label int"


@contextmanager
def small_broadcasts(spark, size, parts):
    """Inside, a broadcast of more than ``size`` fails, and rows are dealt to ``parts``."""
    new = {"spark.sql.maxBroadcastTableSize": size, "spark.sql.shuffle.partitions": str(parts)}
    old = {k: spark.conf.get(k) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def alike(n, dim=8, seed=0):
    """Vectors of about one length, so that bounds by length leave nothing out."""
    v = np.random.default_rng(seed).normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1)[:, None]


def test_queries_for_many_blocks_are_not_broadcast(spark):
    v = alike(3000)
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], VECTORS)
    with small_broadcasts(spark, "100k", 48):
        got = sorted(map(tuple, mips.top_k(df, F.col("vec_id") % 10 == 0, block=32, query_block=16).collect()))
    q = np.floor(256 * v).astype(int)
    want = []
    for i in range(0, 3000, 10):
        scores = q @ q[i]
        first = np.lexsort((np.arange(3000), -scores))
        want += [(i, k + 1, int(j), int(scores[j])) for k, j in enumerate(first[first != i][:5])]
    assert got == want


def test_thresholds_follow_from_block_to_block():
    """The best of two blocks, one after the other, are those of both; what can't be among them is not kept."""
    need = np.array([3, -mips.END], np.int64)
    one = (np.array([0, 0, 1]), np.array([7, 5, 9]), np.array([4, 4, 2]))
    best = mips._merged((np.zeros(0, np.int64),) * 3, one, need, 2)
    assert need.tolist() == [4, -mips.END] and best[1].tolist() == [5, 7, 9]
    best = mips._merged(best, (np.array([0, 1, 1]), np.array([6, 8, 3]), np.array([4, 2, 1])), need, 2)
    assert [x.tolist() for x in best] == [[0, 0, 1, 1], [5, 6, 8, 9], [4, 4, 2, 2]] and need.tolist() == [4, 2]


def test_anchors_for_many_parts_are_not_broadcast(spark):
    v = alike(2000, seed=1)
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, VECTORS)
    with small_broadcasts(spark, "1500k", 64):  # the least that Spark takes for a join by one number is 1,032 KB
        found = hard_negatives.hard_negatives(df, F.col("vec_id") % 5 == 0, positives=2, k=3, block=32, anchor_block=16)  # both searches are done here
    got = sorted(map(tuple, found.collect()))
    q, own = np.floor(256 * v).astype(int), np.arange(2000)
    want = []
    for i in range(0, 2000, 5):
        scores = q @ q[i]
        order = np.lexsort((own, -scores))
        same, others = order[(order % 3 == i % 3) & (order != i)], order[order % 3 != i % 3]
        for p in same[:2]:
            fits = others[(30 * scores[p] <= 100 * scores[others]) & (100 * scores[others] <= 90 * scores[p])]
            want += [(i, int(p), k + 1, int(j), int(scores[p]), int(scores[j])) for k, j in enumerate(fits[:3])]
    assert got == sorted(want)


def test_the_sample_is_the_same_and_little_is_collected_for_it(spark):
    rows = spark.range(40_000, numPartitions=8).withColumnRenamed("id", "row")
    sample = hard_negatives._sample(rows, 40_000)
    plainly = rows.orderBy(F.xxhash64("row"), "row").limit(hard_negatives.SAMPLE)
    assert sample.collect() == plainly.collect()
    bound = -(1 << 63) + (4 * hard_negatives.SAMPLE << 64) // 40_000
    assert f"< {bound}" in sample._jdf.queryExecution().optimizedPlan().toString()
    assert hard_negatives.SAMPLE < rows.where(F.xxhash64("row") < bound).count() < 5 * hard_negatives.SAMPLE
    assert hard_negatives._sample(rows.limit(9), 9).count() == 9
    assert hard_negatives._sample(rows.limit(0), 0).count() == 0
