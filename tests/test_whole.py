"""Queries over whole sequences, alignments and lanes beside brute force on a small fixture."""

import random

import pytest

from strandloom.functions.seq import K
from strandloom.plans import catalog
from strandloom.runtime import ship

QUERIES = catalog.all_queries()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    ship(spark)
    rng, d = random.Random(4), tmp_path_factory.mktemp("whole")
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    head, tail = base(70), base(90)
    seqs = [head + base(60) + tail, head + base(75) + tail, base(200), head + base(30), base(150), base(320)]
    t = [(k, k // 2, 1, len(s), s) for k, s in enumerate(seqs)] + [(6, 1, 1, 100, base(100).lower())]
    reads = [(k, k % 8 + 1, k % 2 + 1, f"n{k // 3}/{k % 2 + 1}") for k in range(40)] + [(40, None, 1, None)]
    aligns = [(1, 1, 0, 0), (2, 1, 2, 0), (3, 2, 3, 1), (4, 2, 4, 2), (5, 3, -1, 0), (6, 3, 5, 5), (7, 4, None, 0)]
    spark.createDataFrame(t, "tid int, gene_id int, chr_id int, len int, seq string").write.parquet(f"{d}/transcripts.parquet")
    spark.createDataFrame(reads + reads[:9], "read_id long, lane int, mate byte, name string").write.parquet(f"{d}/reads.parquet")
    rows = [(i, r, x, 1, 100, e, 1) for i, r, x, e in aligns]
    spark.createDataFrame(rows, "align_id long, read_id long, trans_id int, pos int, f_len int, dis int, ori byte").write.parquet(f"{d}/f_align.parquet")
    return str(d), {r[0]: (r[1], r[4].upper()) for r in t}, reads


def rows(spark, name, d):
    return {tuple(r) for r in QUERIES[name](spark, d).collect()}


def test_edit_distance_sees_whole_sequences(spark, small):
    d, t, _ = small
    want = {(a, b, edits(t[a][1], t[b][1])) for a in t for b in t if a < b and t[a][0] == t[b][0]}
    assert rows(spark, "edit_distance", d) == want


def test_gene_components_take_reads_with_errors(spark, small):
    d, _, _ = small
    assert rows(spark, "gene_components", d) == {(0, 0), (1, 0), (2, 0)}


def test_lanes_union_takes_all_lanes(spark, small):
    d, _, reads = small
    want = {(m, sum(r[2] == m for r in reads), len({r[3][:-2] for r in reads if r[2] == m and r[3]})) for m in (1, 2)}
    assert rows(spark, "lanes_union", d) == want


def test_fusion_halves_take_whole_transcripts(spark, small):
    d, t, _ = small
    want = set()
    for c in range(6):
        s = t[c][1] + t[c + 1][1]
        for half, x in enumerate((s[: len(s) // 2], s[len(s) // 2 :])):
            seeds = [x[i : i + K] for i in range(len(x) - K + 1)]
            hits = {u: [p for k in seeds for p in range(len(y) - K + 1) if y[p : p + K] == k] for u, (_, y) in t.items()}
            n, u = max((len(h), -u) for u, h in hits.items())
            if n:
                want.add((c, half, -u, n, min(hits[-u]), max(hits[-u]) + K))
    got = rows(spark, "fusion_halves", d)
    assert got == want and max(r[3] for r in got) > 80 - K + 1
