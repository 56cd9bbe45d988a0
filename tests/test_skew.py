from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from strandloom.operators import ordinals, skew


def test_totals_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k) if k else None, int(i), float(v) if rng.random() > 0.1 else None) for k, i, v in zip(rng.zipf(1.6, 3000) % 50, rng.integers(0, 1500, 3000), rng.random(3000))]
    rows += [(1, 7, float("nan")), (1, 7, 5.0), (1, None, 1.0), (1, None, 2.0)]
    df = spark.createDataFrame(rows, "k int, id int, v double").withColumn("n_rows", F.lit("clash")).withColumn("__salt", F.lit(1))
    best = defaultdict(dict)
    for k, i, v in rows:
        v = None if v is None or v != v else v
        old = best[k].get(i)
        best[k][i] = max((x for x in (old, v) if x is not None), default=None)
    want = {k: (len(d), sum(x for x in d.values() if x is not None)) for k, d in best.items()}
    got = {r.k: (r.n_rows, r.sum_v) for r in skew.two_stage_totals(df, "k", ["id"], ["v"], share=0.05).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_heavy_keys_are_spread_and_bounded(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 1).otherwise(F.col("id")).alias("k"), "id")
    heavy = skew.heavy_keys(df, "k", 0.01).collect()
    assert [(r["__key"], r["__salts"]) for r in heavy] == [(1, 40)]
    per = skew.salted(df, "k", ["id"], 0.01).filter("k = 1").groupBy("__salt").count().collect()
    assert len(per) == 40 and max(r["count"] for r in per) < 30


def test_ties_at_the_share_and_empty_table(spark):
    t = skew.two_stage_totals(spark.range(10).select((F.col("id") % 2).alias("k"), "id"), "k", ["id"])
    assert {r.k for r in skew.keys_above(t, "k", 0.5).collect()} == {0, 1}
    none = skew.two_stage_totals(spark.range(0).select(F.col("id").alias("k"), "id"), "k", ["id"])
    assert none.count() == 0 and skew.keys_above(none, "k", 0.02).count() == 0


def test_numbers_within_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(None if g == 4 else int(g), int(v)) for g, v in zip(rng.choice(5, 3000, p=[0.6, 0.2, 0.1, 0.05, 0.05]), rng.permutation(3000))]
    df = spark.createDataFrame(rows, "g int, v int").repartition(5)
    got = ordinals.number_rows(df, ["g"], ["v"]).collect()
    want = {}
    for g in {g for g, _ in rows}:
        for k, v in enumerate(sorted(v for h, v in rows if h == g), 1):
            want[g, v] = k
    assert {(r.g, r.v): r.ordinal for r in got} == want and len(got) == 3000
    assert ordinals.number_rows(df.limit(0), ["g"], ["v"]).count() == 0


def test_a_key_below_half_a_percent_is_split_where_tasks_are_many(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        df = spark.range(200_000).select(F.when(F.col("id") < 800, -1).otherwise(F.col("id")).alias("k"), "id")
        heavy = skew.heavy_keys(df, "k").collect()
        assert [(r["__key"], r["__salts"]) for r in heavy] == [(-1, 32)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
