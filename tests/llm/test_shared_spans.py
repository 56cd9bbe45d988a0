from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import shared_spans as S


def brute(rows, length, breaks=""):
    where = defaultdict(set)
    for i, t in rows:
        if i is None or t is None:
            continue
        for k in range(len(t) - length + 1):
            w = t[k:k + length]
            if not set(w) & set(breaks):
                where[w].add(i)
    out = set()
    cover = defaultdict(set)
    for i, t in rows:
        if i is None or t is None:
            continue
        for k in range(len(t) - length + 1):
            if len(where.get(t[k:k + length], ())) > 1:
                cover[i].add((k, k + length))
    for i, spans in cover.items():
        a = b = None
        for x, y in sorted(spans):
            if b is not None and x <= b:
                b = max(b, y)
            else:
                if b is not None:
                    out.add((i, a, b))
                a, b = x, y
        out.add((i, a, b))
    return out


def found(spark, rows, length, breaks=""):
    df = spark.createDataFrame(rows, "id long, t string").withColumn("digest", F.lit("clash")).withColumn("a", F.lit(1))
    return {(r.id, r.span_from, r.span_to) for r in S.shared_stretches(df, "id", "t", length, breaks).collect()}


def test_random_records_with_planted_spans(spark):
    rng = np.random.default_rng(3)
    dna = lambda n: "".join(rng.choice(list("ACGT"), n))
    shared = [dna(60), dna(55), dna(50), dna(49)]
    rows = [(k, dna(int(rng.integers(0, 80))) + shared[k % 4] + dna(int(rng.integers(0, 80)))) for k in range(60)]
    rows += [(100 + k, "A" * int(n)) for k, n in enumerate((10, 50, 75, 200))]
    rows += [(200, dna(40) + "N" + shared[0][:50]), (201, shared[0][:30] + "N" + shared[0][30:]), (202, None), (None, shared[0]), (203, ""), (0, rows[0][1]), (204, "ACGT" * 40), (205, "CGTA" * 40)]
    assert found(spark, rows, 50, "N") == brute(rows, 50, "N")


def test_repeats_under_one_id_are_not_shared(spark):
    t = "".join(np.random.default_rng(1).choice(list("ACGT"), 70))
    assert found(spark, [(1, t), (1, t), (2, t[:49])], 50) == set()
    assert found(spark, [(1, t + "x" + t)], 50) == set()
    assert found(spark, [(1, t), (2, t), (2, t)], 50) == {(1, 0, 70), (2, 0, 70)}


def test_other_alphabets_and_long_records(spark):
    rng = np.random.default_rng(2)
    words = ["größe", "naïve", "日本語", "plain", "text", "🙂"]
    text = lambda n: " ".join(rng.choice(words, n))
    core = text(30)
    rows = [(1, text(20) + core + text(9)), (2, core), (3, text(40))]
    assert found(spark, rows, 50) == brute(rows, 50)
    big = "".join(rng.choice(list("abcdefgh"), (1 << S.SLAB_BITS) + 500))
    cut = (1 << S.SLAB_BITS) - 40
    assert found(spark, [(1, big), (2, big[cut:cut + 90])], 50) == {(1, cut, cut + 90), (2, 0, 90)}


def test_empty_table(spark):
    assert found(spark, [], 50) == set()


def test_a_common_end_on_a_third_of_the_records(spark):
    rng = np.random.default_rng(8)
    dna = lambda n: "".join(rng.choice(list("ACGT"), n))
    end = dna(40)
    rows = [(k, dna(int(rng.integers(20, 60))) + (end if k % 3 == 0 else dna(40))) for k in range(600)]
    rows += [(1000 + k, rows[3 * k][1][5:]) for k in range(5)] + [(2000 + k, "A" * 80) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, text string")
    frequent = S.frequent_grams(df, 50)
    assert frequent.has(S._rolled(S._gear(np.frombuffer(end.encode(), np.uint8)), 50)[0]).all()
    assert found(spark, rows, 50) == brute(rows, 50)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=8), st.integers(2, 12), st.booleans())
def test_every_window_is_in_one_chunk_and_equal_windows_cut_alike(texts, length, avoid):
    seen, codes, frequent = defaultdict(set), None, S.Frequent()
    if avoid and len(texts[0]) >= length:
        frequent = S.Frequent(S._rolled(S._gear(np.frombuffer(texts[0].encode(), np.uint8)), length)[0].view(np.int64))
    for t in texts:
        codes = np.frombuffer(t.encode(), np.uint8)
        a, b, cut, _ = S.cut_chunks(codes, np.zeros(len(t), bool), length, frequent)
        windows = [(k, c) for x, y, c in zip(a, b, cut) for k in range(x, y - length + 1)]
        assert sorted(k for k, _ in windows) == list(range(max(0, len(t) - length + 1)))
        for k, c in windows:
            seen[t[k:k + length]].add(int(c))
    assert all(len(c) == 1 for c in seen.values())


@pytest.mark.parametrize("length", [3, 16, 17, 50])
def test_lengths(spark, length):
    rng = np.random.default_rng(length)
    rows = [(k, "".join(rng.choice(list("ab" if length < 17 else "A"), int(rng.integers(0, 80))))) for k in range(25)]
    assert found(spark, rows, length) == brute(rows, length)


def test_large_cut_groups_and_hot_chunks_are_split(spark):
    rng = np.random.default_rng(11)
    dna = lambda n: "".join(rng.choice(list("ACGT"), n))
    hot, core = dna(70), dna(30)
    rows = [(k, hot if k % 3 == 0 else dna(20) + core + dna(30)) for k in range(300)]
    rows += [(1000 + k, rows[3 * k + 1][1]) for k in range(9)]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {(r.id, r.span_from, r.span_to) for r in S.shared_stretches(df, "id", "t", 50, most=20, slot=10).collect()}
    assert got == brute(rows, 50)
    _, frequent = S._counted_cuts(df.select("id", F.col("t").alias("text")), 50, b"", S.Frequent(), 20)
    assert len(frequent.hashes)


def test_bits_never_miss(spark):
    h = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 5000)
    df = spark.createDataFrame([(int(x),) for x in h], "h long").repartition(3)
    assert S.bits_of(df).has(h).all() and S.bits_of(df, 16).has(h).all()
    assert S.bits_of(df).has(h + 1).mean() < 0.1
    assert not S.bits_of(df.limit(0)).has(h).any()


def test_both_digests_tell_texts_apart():
    codes = np.frombuffer("ababcabab".encode(), np.uint8)
    g = S._gear(codes)
    a = np.array([0, 5, 2])
    for second in (False, True):
        d = S.Prefix(g, second).digest(a, a + 4)
        assert d[0] == d[1] != d[2]
    assert S.Prefix(g).digest(a, a + 4)[0] != S.Prefix(g, True).digest(a, a + 4)[0]
