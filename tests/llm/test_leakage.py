import base64
import random

import numpy as np

from strandloom.llm import leakage as L, svd

VOCAB = [f"w{k}" for k in range(600)]
COMMON = ["the", "of", "and", "a", "is", "in", "to", "by"]


def corpus():
    rng = random.Random(4)
    items = [(k, " ".join(rng.choice(COMMON) if rng.random() < 0.35 else rng.choice(VOCAB) for _ in range(60)) + f". Answer: key{k} word{k}.") for k in range(30)]
    items += [(100, items[0][1]), (101, "too short"), (102, None), (None, items[1][1])]
    docs = []
    for d in range(200):
        w = [rng.choice(COMMON) if rng.random() < 0.4 else rng.choice(VOCAB) for _ in range(rng.randint(0, 150))]
        if d % 3 == 0:
            k, n = rng.randrange(30), rng.choice([8, 11, 12, 13, 20, 40])
            s = L.words(items[k][1])
            at = rng.randrange(len(s) - n)
            p = rng.randint(0, len(w))
            w[p:p] = s[at:at + n]
        text = " ".join(w)
        docs.append((d, "S: x\nContent-Transfer-Encoding: base64\n\n" + base64.encodebytes(text.upper().encode()).decode() if d % 2 else "S: x\n\n> " + text.replace(" ", ",\n> ", 3)))
    docs += [(500, None), (501, ""), (None, "x\n\n" + items[0][1]), (502, "x\n\n" + "filler words " * 50_000 + items[3][1]), (502, "x\n\nagain " + items[3][1])]
    return docs, items


def truth(docs, items):
    grams = {}
    for i, t in items:
        if i is not None and t:
            w = L.words(t)
            for k in range(len(w) - 11):
                grams.setdefault(tuple(w[k:k + 12]), set()).add(i)
    out = set()
    for d, t in docs:
        if d is None:
            continue
        for p in L.mail.plain_parts(t):
            w = L.words(p)
            for k in range(len(w) - 11):
                out |= {(d, i) for i in grams.get(tuple(w[k:k + 12]), ())}
    return out


def test_recall_and_precision_against_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as run")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as doc_id")
    rows = L.leaks(d, i, "doc_id", "text", "item_id", "text").collect()
    want = truth(docs, items)
    got = {(r.doc_id, r.item_id) for r in rows if r.run >= 12}
    assert got == want and len(want) > 30 and (502, 3) in want
    assert any(r.answered for r in rows if (r.doc_id, r.item_id) == (502, 3))
    blocks = L.leaks(d, i, "doc_id", "text", "item_id", "text", block=9).collect()
    assert {(r.doc_id, r.item_id) for r in blocks if r.run >= 12} == want


def test_reworded_passages(spark):
    docs, items = corpus()
    w = L.words(items[5][1])[:30]
    for k in (5, 11, 17, 23):
        w[k] = "changed"
    d = spark.createDataFrame([(1, "x\n\n" + " ".join(w))] + docs, "doc_id long, text string")
    rows = L.leaks(d, spark.createDataFrame(items, "item_id long, text string"), "doc_id", "text", "item_id", "text").collect()
    hit = [r for r in rows if (r.doc_id, r.item_id) == (1, 5)]
    assert hit and hit[0].run < 12 and hit[0].common >= 18


def test_empty_sides(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id long, text string")
    assert L.leaks(d, i, "doc_id", "text", "item_id", "text").count() == 0
    assert L.leaks(d, i.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def test_svd_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = (rng.random((80, 30)) * (rng.random((80, 30)) < 0.3)).astype(np.float32)
    x[:, 0] *= 9
    rows = spark.createDataFrame([([int(k) for k in np.flatnonzero(r)], [float(v) for v in r[r > 0]]) for r in x], "features array<int>, weights array<float>").repartition(3)
    b = svd.right_vectors(rows, 30, 6)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(b.T @ b, np.eye(6), atol=1e-4)
    assert np.linalg.norm(x @ b) ** 2 > 0.995 * (s[:6] ** 2).sum()


def test_runs_and_subsequences():
    x = np.array([[1, 2, 3, -1, 4, 5], [7, 7, 7, -1, -1, -1]])
    y = np.array([[9, 1, 2, 3, 4, 5, -2], [7, 7, 8, 7, -2, -2, -2]])
    assert L._longest_run(x, y).tolist() == [3, 2] and L._common_subsequence(x, y).tolist() == [5, 3]
