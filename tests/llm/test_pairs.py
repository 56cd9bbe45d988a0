import itertools
import math
from collections import Counter

import numpy as np

from strandloom.llm import pairs


def brute(rows):
    best = {}
    for i, refs, n in rows:
        if refs and n is not None and n > 0:
            items = tuple(sorted({r for r in refs if r is not None}))
            if items:
                best[i] = max(best.get(i, (0, ())), (n, items))
    N, w, wab, k = 0, Counter(), Counter(), Counter()
    for n, items in best.values():
        N += n
        for x in items:
            w[x] += n
        for p in itertools.combinations(items, 2):
            wab[p] += n
            k[p] += 1
    return N, w, wab, k


ROWS = [(1, [3, 1, 1, 2], 5), (1, [3, 1, 1, 2], 5), (2, [], 4), (3, None, 4), (4, [1, 2], None), (5, [1, 2], 0), (6, [1, 2], -1), (7, [2, 1, None], 2), (8, [None], 3), (None, [1, 9], 1), (9, [4], 10)]


def test_small_table_with_every_kind_of_dirt(spark):
    df = spark.createDataFrame(ROWS, "class_id long, refs array<int>, n long").selectExpr("*", "1 as id", "2 as items", "3 as w_ab")
    N, w, wab, k = brute(ROWS)
    got = {(r.a, r.b): r for r in pairs.lift_table(pairs.baskets(df, "class_id", "refs", "n")).collect()}
    assert {p: (r.w_ab, r.k_ab) for p, r in got.items()} == {p: (wab[p], k[p]) for p in wab}
    assert all(math.isclose(r.lift, wab[p] * N / (w[p[0]] * w[p[1]])) and math.isclose(r.pmi, math.log2(r.lift), abs_tol=1e-12) for p, r in got.items())


def test_large_baskets_go_in_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(k, rng.integers(0, 400, 300).tolist() if k < 3 else rng.integers(0, 40, 4).tolist(), int(rng.integers(1, 9))) for k in range(40)]
    sets = pairs.baskets(spark.createDataFrame(rows, "c long, refs array<int>, n long"), "c", "refs", "n")
    _, _, wab, k = brute(rows)
    got = {(r.a, r.b): (r.w_ab, r.k_ab) for r in pairs.joint_weights(sets).collect()}
    assert got == {p: (wab[p], k[p]) for p in wab}


def test_cuts_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(c, [int(x) for x in rng.zipf(1.3, 5) % 60] + ([100, 101] if c % 40 == 0 else []), int(rng.integers(1, 4))) for c in range(800)]
    sets = pairs.baskets(spark.createDataFrame(rows, "c long, refs array<int>, n long"), "c", "refs", "n")
    N, w, wab, k = brute(rows)
    want = {p for p in wab if wab[p] >= 0.002 * N and wab[p] * N / (w[p[0]] * w[p[1]]) >= 3 and k[p] >= 5}
    assert {(r.a, r.b) for r in pairs.associated(sets, 0.002, 3, 5).collect()} == want and (100, 101) in want


def test_empty_table(spark):
    sets = pairs.baskets(spark.createDataFrame([], "c long, refs array<int>, n long"), "c", "refs", "n")
    assert pairs.lift_table(sets).count() == 0 and pairs.associated(sets, 0.1, 2, 1).count() == 0
