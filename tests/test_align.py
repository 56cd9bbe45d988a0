import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from strandloom.operators import align, dp, graph, intervals, kmers
from tests.conftest import revcomp

dna = st.text("ACGT", min_size=1, max_size=25)


def fewest_edits(q, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(q, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def best_score(q, t):
    best, row = 0, [0] * (len(t) + 1)
    for a in q:
        new = [0]
        for j, b in enumerate(t, 1):
            new.append(max(0, row[j - 1] + (1 if a == b else -2), row[j] - 4, new[-1] - 4))
        row = new
        best = max(best, *row)
    return best


def consumes(ops, kinds):
    return sum(o["len"] for o in ops if o["op"] in kinds)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(dna, dna), min_size=1, max_size=6))
def test_kernels_equal_brute_force(pairs):
    q, t = [a for a, _ in pairs], [b for _, b in pairs]
    for r, a, b in zip(dp.global_in_window(q, t), q, t):
        ops = r["cigar"]
        assert consumes(ops, "=XIS") == len(a)
        if not any(o["op"] == "S" for o in ops):
            assert r["err"] == fewest_edits(a, b)
        assert 0 <= r["start"] and r["start"] + consumes(ops, "=XD") <= len(b)
    for r, a, b in zip(dp.local(q, t), q, t):
        assert r["score"] == best_score(a, b)
        assert consumes(r["cigar"], "=XIS") == len(a)
        assert r["start"] + consumes(r["cigar"], "=XD") <= len(b)


def test_kernel_on_empty_and_missing():
    assert dp.global_in_window(["", "ACG"], ["ACG", None]) == [None, None]
    assert dp.local(["", "ACG"], ["ACG", ""]) == [None, None]


def test_reads_with_edits_indels_and_clips_are_mapped(spark):
    rng = np.random.default_rng(3)
    t = {k: "".join(rng.choice(list("ACGT"), 500)) for k in range(4)}
    t[3] = t[0][:200] + t[3][200:]
    reads = {
        1: t[1][100:200],
        2: revcomp(t[2][50:150]),
        3: t[1][100:150] + "A" + t[1][150:199],
        4: t[2][60:110] + t[2][113:160],
        5: t[0][20:120],
        6: "".join(rng.choice(list("ACGT"), 100)),
        7: t[1][:20],
        8: t[2][200:260] + "".join(rng.choice(list("ACGT"), 40)),
    }
    targets = spark.createDataFrame([(k, s) for k, s in t.items()], "tid int, seq string")
    r = spark.createDataFrame(list(reads.items()), "read int, seq string")
    hits = align.map_reads(r, targets, kmers.postings(targets), ["read"]).collect()
    got = {}
    for h in hits:
        got.setdefault(h.read, set()).add((h.tid, h.strand, h.pos))
    assert got[1] == {(1, 0, 100)} and got[2] == {(2, 1, 50)} and got[5] == {(0, 0, 20), (3, 0, 20)}
    assert (1, 0, 100) in got[3] and (2, 0, 60) in got[4] and (2, 0, 200) in got[8]
    assert 6 not in got and 7 not in got
    by = {h.read: h for h in hits}
    assert by[1].err == 0 and by[4].err <= 3 and any(o.op == "S" for o in by[8].cigar)


def test_split_reads_find_the_nearest_segment(spark):
    rng = np.random.default_rng(4)
    g = list("".join(rng.choice(list("ACGT"), 3000)))
    g[2500:2545] = g[1500:1545]
    g = "".join(g)
    contigs = spark.createDataFrame([(0, g)], "tid int, seq string")
    reads = spark.createDataFrame([(1, g[400:460] + g[1500:1545])], "read int, seq string")
    index = kmers.postings(contigs)
    hits = align.map_reads(reads, contigs, index, ["read"])
    s = align.introns(hits, kmers.both_strands(reads), contigs, index, ["read"]).collect()
    assert len(s) == 1 and s[0].side == "end" and s[0].split_pos + s[0].seg_len == 1545 and abs(s[0].gap - 1040) < 4


def test_interval_joins_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    a = [(k, int(c), int(s), int(s + n)) for k, (c, s, n) in enumerate(zip(rng.integers(0, 2, 60), rng.integers(0, 500, 60), rng.integers(0, 90, 60)))]
    x = spark.createDataFrame(a, "i int, c int, s int, e int")
    y = spark.createDataFrame(a, "j int, c int, s2 int, e2 int")
    got = sorted((r.i, r.j) for r in intervals.overlaps(x, y, "c", ("s", "e"), ("s2", "e2"), 64).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in a if p[1] == q[1] and p[2] <= q[3] and q[2] <= p[3])
    got = sorted((r.i, r.j) for r in intervals.band_join(x, y.drop("c", "e2"), "s", "s2", 7).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in a if abs(p[2] - q[2]) <= 7)
    near = sorted((r.i, r.j) for r in intervals.nearest(x, y.drop("e2"), ["i"], "s", "s2", 50, ["c"]).collect())
    assert all((k, k) in near for k in range(60))


def test_chromosome_places(spark):
    c = intervals.chromosome_offsets(spark.createDataFrame([(0, 10), (1, 5)], "chr_id int, len long"), "chr_id", "len")
    p = spark.createDataFrame([(0,), (9,), (10,), (14,), (15,)], "p long")
    want = {(0, 0, 0), (9, 0, 9), (10, 1, 0), (14, 1, 4)}
    for most in (100, 1):
        assert {(r.p, r.chr_id, r.chr_pos) for r in intervals.chromosome_places(p, c, "p", "len", most).collect()} == want


def test_decisions(spark):
    cols = "pair int, a_proper boolean, b_proper boolean, a0 boolean, a1 boolean, b0 boolean, b1 boolean, err_a int, err_b int, a_tx boolean, b_tx boolean"
    T, N = True, False
    rows = [
        (1, T, T, T, T, T, T, 2, 2, T, T), (2, T, T, T, T, T, T, 1, 2, T, T), (3, N, T, T, T, T, T, 0, 5, T, N), (4, N, N, T, T, T, T, 1, 2, T, T), (5, N, N, T, T, T, T, 2, 2, T, T),
        (6, N, N, T, N, T, N, 9, 9, T, T), (7, N, N, N, T, N, T, 9, 9, T, T), (8, N, N, T, N, N, N, 9, 9, T, T), (9, N, N, N, T, N, N, 9, 9, T, T), (10, N, N, N, N, T, N, 9, 9, T, T), (11, N, N, N, N, N, T, 9, 9, T, T), (12, N, N, N, N, N, N, 9, 9, T, T),
    ]
    got = [(r.outcome, r.counted) for r in align.decide(spark.createDataFrame(rows, cols)).orderBy("pair").collect()]
    assert [o for o, _ in got] == ["proper_both", "proper_a", "proper_b", "improper_a", "improper_b", "both_forward", "both_reverse", "single_a0", "single_a1", "single_b0", "single_b1", "unmapped"]
    assert [c for _, c in got[:4]] == [True, True, False, False]


def test_unitigs_and_cleaning(spark):
    rng = np.random.default_rng(9)
    s = "".join(rng.choice(list("ACGT"), 120))
    reads = spark.createDataFrame([(s,), (s[:60],), (s[:50] + ("A" if s[50] != "A" else "C"),)], "seq string")
    e = graph.edges(reads, k=20, strands=False)
    assert e.filter("cover = 1").count() > 0
    clean = graph.without_tips(graph.without_weak(e, 0.5))
    assert [r.contig for r in graph.unitigs(clean, 20).collect()] == [s]
    circle = s[:60] + s[:20]
    c = graph.unitigs(graph.edges(spark.createDataFrame([(circle,)], "seq string"), k=20, strands=False), 20).collect()
    assert len(c) == 1 and len(c[0].contig) == 79 and c[0].contig in s[:60] * 3


def test_bubble_keeps_the_better_way(spark):
    e = spark.createDataFrame([(1, 2, 5), (2, 4, 5), (1, 3, 1), (3, 4, 1)], "src long, dst long, cover long")
    assert {(r.src, r.dst) for r in graph.without_bubbles(e).collect()} == {(1, 2), (2, 4)}


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.group for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(31)) and {got[k] for k in (100, 101, 102)} == {100}


def test_fusion_helpers(spark):
    h1 = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "read int, gene_id int")
    h2 = spark.createDataFrame([(1, 12), (2, 11), (3, 12)], "read int, gene_id int")
    genes = spark.createDataFrame([(10, "c", 0, 50), (11, "c", 40, 90), (12, "d", 0, 50)], "gene_id int, chr string, start int, end int")
    p = graph.gene_pairs(h1, h2, "read", genes)
    assert {(r.read, r.gene_a, r.gene_b) for r in p.collect()} == {(1, 10, 12), (3, 11, 12)}
    assert {r.group for r in graph.grouped_pairs(p).collect()} == {10}
    exons = spark.createDataFrame([(1, 0, 100), (1, 100, 200)], "tid int, lo int, hi int")
    places = spark.createDataFrame([(1, 104), (1, 110), (2, 5)], "tid int, pos int")
    assert {(r.tid, r.pos, r.snapped) for r in graph.snap_to_exons(places, exons).collect()} == {(1, 104, 100), (1, 110, 110), (2, 5, 5)}


def test_lifted_cigars_hold_an_intron_for_each_border(spark):
    exons = [(0, 10, 100), (10, 20, 200), (20, 30, 300)]

    def ops(*x):
        return [{"op": o, "len": n, "ref": r} for n, o, r in x]

    text = lambda r: (r[0], "".join(f"{o['len']}{o['op']}" for o in r[1]))
    assert text(intervals.lift_cigar(5, ops((10, "=", "")), exons)) == (105, "5=90N5=")
    assert text(intervals.lift_cigar(5, ops((2, "S", ""), (5, "=", ""), (2, "I", ""), (12, "=", "")), exons)) == (105, "2S5=2I90N10=90N2=")
    assert text(intervals.lift_cigar(8, ops((4, "D", "ACGT"),), exons)) == (108, "2D90N2D")
    assert text(intervals.lift_cigar(20, ops((10, "=", "")), exons)) == (300, "10=")
    assert intervals.lift_cigar(30, ops((1, "=", "")), exons) is None
    hits = spark.createDataFrame([(1, 7, 5, [("=", 10, "")])], "read int, tid int, pos int, cigar array<struct<op:string,len:int,ref:string>>")
    e = spark.createDataFrame([(7, 0, *x) for x in exons], "tid int, chr_id int, lo int, hi int, start int")
    r = intervals.lift_alignments(hits, e, ["read"]).collect()[0]
    assert r.genome_pos == 105 and [o.op for o in r.genome_cigar] == ["=", "N", "="]


def test_tips_go_layer_by_layer(spark):
    # 1 - 2 - 3 - 4 - 5 with a tip of two edges at 3
    e = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (3, 4, 5), (4, 5, 5), (3, 8, 1), (8, 9, 1), (3, 7, 1)], "src long, dst long, cover long")
    assert {(r.src, r.dst) for r in graph.without_tips(e).collect()} == {(1, 2), (2, 3), (3, 4), (4, 5), (3, 8), (8, 9)}
    twice = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (3, 4, 5), (3, 8, 1), (8, 9, 1), (8, 10, 1)], "src long, dst long, cover long")
    assert {(r.src, r.dst) for r in graph.without_tips(twice, layers=5).collect()} == {(1, 2), (2, 3), (3, 4)}


def test_one_target_with_half_of_the_places_is_spread(spark):
    places = spark.createDataFrame([(k, 0 if k % 2 else k % 40, k % 60) for k in range(4000)], "read int, tid int, __start int")
    rng = np.random.default_rng(6)
    text = {k: "".join(rng.choice(list("ACGT"), 80)) for k in range(40)}
    tiles = align.Tiles(spark.createDataFrame(list(text.items()), "tid int, seq string"), 30)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = tiles.windows(places, "__start", F.lit(20), ["read"]).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == 4000 and all(r["__window"] == text[r.tid][r["__start"]:][:20] for r in got)
    hot = {}
    for r in got:
        if r.tid == 0:
            hot[r.part] = hot.get(r.part, 0) + 1
    assert len(hot) > 8 and max(hot.values()) < 800


def test_nearest_of_another_group_equals_brute_force(spark):
    rng = np.random.default_rng(12)
    rows = [(k, int(c), int(p), int(g)) for k, (c, p, g) in enumerate(zip(rng.integers(0, 2, 150), rng.integers(0, 400, 150), rng.choice(4, 150, p=[0.7, 0.1, 0.1, 0.1])))]
    x = spark.createDataFrame(rows, "i int, c int, p int, g int")
    y = spark.createDataFrame(rows, "j int, c int, q int, h int")
    for width in (5, 30, 1000):
        for differ in (None, ("g", "h")):
            got = {(r.i, r.j, r.dist) for r in intervals.nearest(x, y, ["i"], "p", "q", width, ["c"], differ).collect()}
            want = set()
            for i, c, p, g in rows:
                d = {j: abs(p - q) for j, e, q, h in rows if e == c and (differ is None or g != h) and abs(p - q) <= width}
                want |= {(i, j, n) for j, n in d.items() if n == min(d.values())}
            assert got == want
