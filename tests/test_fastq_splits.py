import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.sources import reads as R

QUAL = st.text("@+IA", min_size=1, max_size=6)
PIECE = st.one_of(
    QUAL.map(lambda q: ["@r", "ACGTAC"[: len(q)], "+", q]),
    st.integers(1, 14).map(lambda n: [""] * n),
    st.lists(st.sampled_from(["garbage", "+x", "ACGT", "@", "II", "@@"]), min_size=1, max_size=10),
    QUAL.map(lambda q: ["@long", "ACGTAC"[: len(q)], "+", q + "I"]),
    st.just(["@cut", "AC"]),
    st.just(["@digit", "A1", "+", "@I"]),
)


def read(data, split):
    return [r for a in range(0, max(1, len(data)), split) for r in R.fastq_records(io.BytesIO(data), a, min(a + split, len(data)))]


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECE, max_size=30), st.booleans(), st.integers(1, 200))
def test_splits_of_any_size_give_the_records_of_one(pieces, ended, split):
    data = ("\n".join(x for p in pieces for x in p) + ("\n" if ended else "")).encode()
    assert read(data, split) == read(data, len(data) + 1)


@pytest.mark.parametrize("between", ["\n" * 12, "garbage\n" * 9, "@bad\nACGT\n+\nII\n"])
def test_nothing_is_lost_at_a_border_of_splits(between):
    rec = "@r\nACGT\n+\nIIII\n"
    data = (rec * 10 + between + rec * 100).encode()
    for split in (len(rec) * 10 - 2, len(rec) * 10, len(rec) * 10 + 20, 50):
        got = read(data, split)
        assert sum(r[3] is None for r in got) == 110
        assert sum(r[3] is not None for r in got) == {"\n": 0, "g": 9, "@": 1}[between[0]]


def test_malformed_records_keep_their_number_and_leave_the_pairing(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@a1\nAC\n+\nII\nstray\n@a2\nAC\n+\nI\n@a3\nAC\n+\nII\n@a4\nAC\n+\nII\n")
    (tmp_path / "b.fq").write_text("".join(f"@b{k}\nGT\n+\nII\n" for k in (1, 2, 3)))
    a, b = [str(tmp_path / "a.fq")], [str(tmp_path / "b.fq")]
    assert sorted((r.name1, r.name2) for r in R.pairs(spark, a, b).collect()) == [("a1", "b1"), ("a3", "b3")]
    left = R.unpaired(R.zipped(spark, a, b)).collect()
    assert {(r.lane, r.problem1, r.problem2, r.n) for r in left} == {(1, "quality", None, 1), (1, None, "missing", 1)}
