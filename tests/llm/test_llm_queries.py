from collections import defaultdict

import pytest

from strandloom.llm import queries as Q
from strandloom.runtime import ship
from tests.conftest import SMALL
from tests.test_queries import compare

QUERIES, SQL = Q.all_queries(), Q.all_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    compare(spark, duck, name, QUERIES[name], SQL[name])


WITHOUT_SQL = {"p6_found", "p6_leaks", "p7_found", "p7_mix", "p7_shares", "p8_found", "p8_kinds", "p8_clean"}


def test_only_these_go_without_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL


def rows(spark, name, sf=SMALL):
    ship(spark)
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


def test_leaks_equal_brute_force_over_the_tables(spark, duck):
    from strandloom.llm import leakage, mail

    sf = SMALL.replace("sf0.001", "sf0.01")
    grams = defaultdict(set)
    for i, t in duck.sql(f"SELECT item_id, text FROM '{sf}/eval_items.parquet'").fetchall():
        w = leakage.words(t)
        for k in range(len(w) - 11):
            grams[tuple(w[k:k + 12])].add(i)
    want = set()
    for d, t in duck.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall():
        for p in mail.plain_parts(t):
            w = leakage.words(p)
            for k in range(len(w) - 11):
                want |= {(d, i) for i in grams.get(tuple(w[k:k + 12]), ())}
    assert {(r["doc_id"], r["item_id"]) for r in rows(spark, "p6_found", sf)} == want and len(want) > 20
    leaks = {(r["doc_id"], r["item_id"]): r for r in rows(spark, "p6_leaks", sf)}
    assert {k for k, r in leaks.items() if r["run"] >= 12} == want
    assert all(r["common"] >= r["run"] and (r["run"] >= 12 or r["common"] >= 18) for r in leaks.values())


def test_mix_equals_a_count_of_tokens(spark, duck):
    import re

    from strandloom.llm.tokens import tokenizer

    encode = tokenizer().encode_ordinary
    docs = {i: (re.sub(r"[\s_-]+", "_", s.strip().lower()) if s is not None else None, len(encode(t))) for i, s, t in duck.sql("SELECT doc_id, source, text FROM documents").fetchall()}
    total = sum(n for _, n in docs.values())
    targets = {s: (w, m) for s, w, m in duck.sql("SELECT source, target_share, max_repeats FROM mix_targets").fetchall()}
    own = {s: sum(n for d, n in docs.values() if d == s) for s in targets}
    short = {s for s, (w, m) in targets.items() if own[s] * m < w * total}
    assert {r["source"] for r in rows(spark, "p7_found")} == short and short
    used, largest = defaultdict(int), max(n for _, n in docs.values())
    for r in rows(spark, "p7_mix"):
        assert docs[r["doc_id"]] == (r["source"], r["tokens"]) and 1 <= r["repeats"] <= targets[r["source"]][1]
        used[r["source"]] += r["tokens"] * r["repeats"]
    for s, (w, m) in targets.items():
        assert used[s] == own[s] * m if s in short else abs(used[s] - w * total) <= largest
    mix = sum(used.values())
    for r in rows(spark, "p7_shares"):
        assert r["used_tokens"] == used[r["source"]] and r["short"] == (r["source"] in short)
        assert abs(r["mix_share"] - used[r["source"]] / mix) < 1e-9 and abs(r["total_share"] - used[r["source"]] / total) < 1e-9


def test_residue_and_the_rest_make_up_the_table(spark, duck):
    from strandloom.llm import residue

    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    kinds = rows(spark, "p8_kinds")
    found = {r["doc_id"] for r in rows(spark, "p8_found")}
    assert found == {r["doc_id"] for r in kinds} and {r["kind"] for r in kinds} <= {"slot", "filler", "page"}
    rest = rows(spark, "p8_clean")
    assert {r["doc_id"] for r in rest} == set(texts) - found and all(texts[r["doc_id"]] == r["text"] for r in rest)
    # every finding has evidence in its own text, and none of the rest holds a variable without signs of citing
    for r in kinds:
        assert any(k in (r["kind"], "told" if r["kind"] == "slot" else "repeated", "alone") for k, _, _ in residue.evidence(texts[r["doc_id"]]))
    assert not any(k == "slot" for r in rest for k, _, _ in residue.evidence(r["text"]))
