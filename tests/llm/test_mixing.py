import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import mixing, tokens


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, size long").selectExpr("*", "1 as tokens", "2 as h")


def size(docs, keep):
    return docs.select(*keep, F.col("size").alias("tokens"))


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_caps_and_nesting(spark):
    rng = np.random.default_rng(0)
    rows = [(k, ["Big One", "big-one ", "BIG_ONE", "mid", "small", "other", None][int(rng.choice(7, p=[0.2, 0.1, 0.1, 0.3, 0.05, 0.2, 0.05]))], int(rng.integers(0, 200))) for k in range(5000)]
    total = sum(r[2] for r in rows)
    t = [("big_one", 0.3, 1), ("mid", 0.5, 3), ("small", 0.2, 2), ("absent", 0.1, 9), ("unwanted", 0.0, 1)]
    m = mixing.mix(table(spark, rows), targets(spark, t), "doc_id", "source", size)
    used = {}
    for r in m.documents().collect():
        used[r.source] = used.get(r.source, 0) + r.tokens * r.repeats
        assert 1 <= r.repeats <= dict((a, c) for a, _, c in t)[r.source]
    assert abs(used["big_one"] - 0.3 * total) <= 200 and abs(used["mid"] - 0.5 * total) <= 200
    own = sum(n for _, s, n in rows if s == "small")
    assert used["small"] == 2 * own < 0.2 * total
    assert {r.source for r in m.short_sources().collect()} == {"small", "absent"}
    rep = {r.source: r for r in m.report().collect()}
    assert abs(sum(r.mix_share for r in rep.values()) - 1) < 1e-9 and rep["absent"].used_tokens == 0
    less = mixing.mix(table(spark, rows), targets(spark, [("big_one", 0.2, 1)]), "doc_id", "source", size)
    assert {r.doc_id for r in less.documents().collect()} < {r.doc_id for r in m.documents().filter("source = 'big_one'").collect()}


def test_the_boundary_is_refined_to_one_document(spark):
    rows = [(k, "a", 1) for k in range(3000)] + [(9000, "b", 3000)]
    for share in (0.1, 0.25, 0.49):
        m = mixing.mix(table(spark, rows), targets(spark, [("a", share, 1)]), "doc_id", "source", size)
        assert abs(m.documents().count() - share * 6000) <= 1


def test_ties_in_ids_empty_tables_and_bad_targets(spark):
    rows = [(1, "a", 10)] * 4 + [(None, "a", 10)] * 2
    m = mixing.mix(table(spark, rows), targets(spark, [("a", 0.5, 1)]), "doc_id", "source", size)
    assert m.documents().count() in (2, 4, 6)
    none = mixing.mix(table(spark, []), targets(spark, [("a", 0.5, 1)]), "doc_id", "source", size)
    assert none.documents().count() == 0 and none.short_sources().count() == 0
    with pytest.raises(ValueError):
        mixing.read_targets(targets(spark, [("a", 0.5, 1), ("A ", 0.5, 1)]), "source", "target_share", "max_repeats")
    with pytest.raises(ValueError):
        mixing.read_targets(targets(spark, [("a", -0.5, 1)]), "source", "target_share", "max_repeats")
    assert mixing.read_targets(targets(spark, [(None, 0.5, 1)]), "source", "target_share", "max_repeats") == []


def test_tokens_of_whole_texts(spark):
    t = tokens.tokenizer()
    texts = [None, "", "Hello world", "<|endoftext|> ß 日本", "word " * 50_000, "x" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.tokens for r in tokens.with_tokens(df, "text", ["i"]).collect()}
    assert got == {i: len(t.encode_ordinary(x)) if x else 0 for i, x in enumerate(texts)} and got[4] >= 50_000
    assert t.decode(t.encode_ordinary(texts[3])) == texts[3]
