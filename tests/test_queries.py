"""Every query of the core beside its SQL on the smallest tables."""

import math

import pytest

from strandloom.plans import catalog
from strandloom.runtime import ship
from tests.conftest import SMALL, revcomp

QUERIES, SQL = catalog.all_queries(), catalog.all_sql()
WITHOUT_SQL = {"map_reads", "sw_rescue", "unitigs", "em_squarem", "reads_to_abundance", "generative_model"}


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.7g}"
    return str(v)


def compare(spark, duck, name, fn, sql):
    ship(spark)
    df = fn(spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    compare(spark, duck, name, QUERIES[name], SQL[name])


def test_only_these_go_without_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL


@pytest.fixture(scope="module")
def found(spark):
    """Rows of the queries without SQL."""
    ship(spark)
    return {name: [r.asDict() for r in QUERIES[name](spark, SMALL).collect()] for name in sorted(WITHOUT_SQL)}


@pytest.fixture(scope="module")
def reads(duck):
    return dict(duck.sql("SELECT DISTINCT read_id, upper(seq) FROM reads WHERE seq IS NOT NULL").fetchall())


@pytest.fixture(scope="module")
def transcripts(duck):
    return dict(duck.sql("SELECT tid, upper(seq) FROM transcripts").fetchall())


def test_every_alignment_agrees_with_the_bases(found, reads, transcripts):
    from strandloom.sources.bam import parse_cigar
    from tests.test_pipeline import md_of

    assert len({r["read_id"] for r in found["map_reads"]}) > 100
    for r in found["map_reads"]:
        seq = reads[r["read_id"]] if r["strand"] == 0 else revcomp(reads[r["read_id"]])
        text, at, i, pairs, clipped = transcripts[r["tid"]], r["pos"], 0, [], 0
        for n, op in parse_cigar(r["cigar"]):
            for _ in range(n):
                a, b = seq[i] if op in "=XIS" else None, text[at] if op in "=XD" else None
                assert op not in "=X" or (a == b) == (op == "=")
                pairs += [] if op == "S" else [(a, b)]
                clipped += op == "S"
                i, at = i + (a is not None), at + (b is not None)
        assert i == len(seq) and r["nm"] == sum(a != b for a, b in pairs) and r["md"] == md_of(pairs)
        assert r["err"] == r["nm"] + clipped and 2 * r["err"] <= len(seq)
    best = {}
    for r in found["map_reads"]:
        assert best.setdefault(r["read_id"], r["err"]) == r["err"]


def test_rescued_mates_lie_near_their_partner(found, reads):
    assert found["sw_rescue"]
    for r in found["sw_rescue"]:
        n = len(reads[r["pair"] + 1])
        assert 2 * r["err"] <= n and -n <= r["pos"] - r["mate_pos"] + 1000 and r["pos"] - r["mate_pos"] <= 1000 + n


def test_unitigs_equal_a_walk_over_the_graph(found, transcripts):
    cover = {}
    for s in transcripts.values():
        for i in range(len(s) - 30):
            m = s[i:i + 31]
            if set(m) <= set("ACGT"):
                cover[m] = cover.get(m, 0) + 1
    out, into = {}, {}
    for m in cover:
        out[m[:-1]] = out.get(m[:-1], 0) + 1
        into[m[1:]] = into.get(m[1:], 0) + 1
    links = {m[:-1]: m for m in cover if out[m[:-1]] == 1 and into[m[1:]] == 1 and m[:-1] != m[1:]}
    reached = {m[1:] for m in links.values()}
    want = set()
    for start in links.keys() - reached:
        text, node, seen = start, start, []
        while node in links:
            seen.append(cover[links[node]])
            node = links[node][1:]
            text += node[-1]
        want.add((text, len(text), round(sum(seen) / len(seen), 6)))
    got = {(r["contig"], r["len"], r["cover"]) for r in found["unitigs"]}
    assert {x[:2] for x in got} == {x[:2] for x in want} and max(abs(a[2] - b[2]) for a, b in zip(sorted(got), sorted(want))) < 1e-5


def test_abundances_keep_all_reads_and_are_at_rest(found, duck):
    import numpy as np

    from strandloom.operators.quant import Problem

    cls = duck.sql("SELECT refs, sum(n) FROM (SELECT DISTINCT class_id, list_sort(list_distinct(refs)) AS refs, n FROM classes WHERE len(refs) > 0 AND n > 0) GROUP BY 1").fetchall()
    lengths = [n for _, n in duck.sql("SELECT tid, len FROM transcripts ORDER BY tid").fetchall()]
    rate = np.zeros(len(lengths))
    for r in found["em_squarem"]:
        rate[r["tid"]] = r["est_counts"] / r["length"]
    after = Problem(lengths, [np.array(c) for c, _ in cls], [n for _, n in cls]).step(rate)
    assert abs((rate * lengths).sum() - sum(n for _, n in cls)) < 0.5
    big = after > 2e-3
    assert (np.abs(after - rate)[big] <= 0.02 * after[big]).all()
    assert abs(sum(r["tpm"] for r in found["em_squarem"]) - 1e6) < 1


def test_reads_end_up_in_the_abundance(found, reads):
    total = sum(r["est_counts"] for r in found["reads_to_abundance"])
    mapped = {r["read_id"] for r in found["map_reads"]}
    best = {}
    for r in found["map_reads"]:
        best.setdefault(r["read_id"], (r["err"], set()))[1].add(r["tid"])
    assert abs(total - sum(len(t) == 1 or e < 7 for e, t in best.values())) < 0.5 and len(mapped) < len(reads)
    unique = sum(len(t) == 1 for _, t in best.values())
    assert sum(r["unique_map"] for r in found["reads_to_abundance"]) == unique


def test_model_shares_add_up(found, duck):
    n = duck.sql("SELECT count(DISTINCT read_id) FROM reads").fetchall()[0][0]
    assert 0 < sum(r["read_count"] for r in found["generative_model"]) <= n
    assert abs(sum(r["tpm"] for r in found["generative_model"]) - 1e6) < 2e4
