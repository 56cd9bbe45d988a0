from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import heavy_hitters as H


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 300), st.integers(1, 9)), min_size=1, max_size=80), min_size=1, max_size=6))
def test_sketch_never_estimates_too_low(batches):
    s, true = H.Sketch(width_bits=5), Counter()
    for b in batches:
        keys, n = H._totals(np.array([k for k, _ in b], np.int64), np.array([w for _, w in b]))
        s.add(keys, n)
        for k, w in zip(keys.tolist(), n.tolist()):
            true[k] += w
    keys = np.array(list(true), np.int64)
    assert (s.estimate(keys) >= np.array([true[k] for k in keys.tolist()])).all()


def test_sketch_is_exact_when_it_has_room():
    s = H.Sketch()
    keys = np.arange(500, dtype=np.int64) * 7919
    s.add(keys, keys % 13 + 1)
    assert (s.estimate(keys) == keys % 13 + 1).all()


def test_heap_keeps_the_largest():
    c = H.Candidates(3)
    for k in range(100):
        c.offer(np.array([k, 1000]), np.array([k % 50, 40 + k]))
    assert 1000 in c.keys and len(c.keys) == 3 and c.floor <= c.estimates.min()


def brute(rows, share, least):
    ids = {i for i, v in rows if v is not None}
    pairs = {(i, v) for i, v in rows if v is not None}
    n = Counter(v for _, v in pairs)
    return {v: k for v, k in n.items() if k >= max(least, share * len(pairs))}


def test_equals_brute_force_with_a_hot_value_and_repeats(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), "hot" if rng.random() < 0.34 else f"v{int(rng.zipf(1.3)) % 3000}") for i in range(8000)]
    rows += rows[:2000] + [(9001, None), (9002, ""), (9003, ""), (None, "hot")]
    df = spark.createDataFrame(rows, "id long, v string").withColumn("h", F.lit("clash")).withColumn("n_rows", F.lit(0))
    for share, least in ((0.01, 1), (0.002, 10), (0.3, 1)):
        got = {r.value: r for r in H.frequent_values(df, "v", "id", share, least).collect()}
        assert {v: r.n_rows for v, r in got.items()} == brute(rows, share, least)
        assert all(r.n_estimate >= r.n_rows for r in got.values())


def test_ties_empty_tables_and_long_values(spark):
    df = spark.createDataFrame([(k, "x" * 200_000 if k % 2 else "y") for k in range(20)], "id long, v string")
    assert {len(r.value) for r in H.frequent_values(df, "v", "id", 0.5).collect()} == {1, 200_000}
    assert H.frequent_values(df.limit(0), "v", "id", 0.5, 10).count() == 0
    assert H.frequent_values(df.withColumn("v", F.lit(None).cast("string")), "v", "id", 0.5).count() == 0


@pytest.mark.parametrize("heap", [2, 16])
def test_a_heap_that_is_too_small_grows_whatever_columns_are_read(spark, heap):
    df = spark.range(4000).select("id", (F.col("id") % 1000).cast("string").alias("v"))
    found = H.frequent_values(df, "v", "id", 0.0005, heap=heap)
    assert found.select("value").count() == 1000
    assert {r.value for r in found.select("value").collect()} == {str(k) for k in range(1000)}
