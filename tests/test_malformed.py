import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from strandloom.operators import malformed as M

GOOD = "n1,ACGT,IIII,3,1"
CASES = {
    GOOD: [],
    GOOD + "\r": [],
    GOOD + "\r\r": ["mate"],
    '"n,1",acgtN,"I""I,I",8,2': [],
    '"n1","ACGT","II\nI","3","1"': ["qual"],
    "": ["columns"],
    None: ["columns"],
    "n1,ACGT,IIII,3": ["columns"],
    "n1,ACGT,IIII,3,1,": ["columns"],
    'n1,AC"GT,IIII,3,1': ["quoting"],
    '"n1"x,ACGT,IIII,3,1': ["quoting"],
    '"n1,ACGT,IIII,3,1': ["quoting"],
    "n 1,ACGT,IIII,3,1": ["name"],
    ",,,,": ["name", "seq", "lane", "mate"],
    "n1,ACXT,III,9,3": ["seq", "qual", "lane", "mate"],
    "n1,ACGT,III\x7f,3,1": ["qual"],
    "n1,ACGT,IIII,3,01": ["mate"],
    "n1,ACGT,IIII,٣,1": ["lane"],
    "n1,ACGT,IIII,3,1\n": ["mate"],
    "é,ACGT,IIII,3,1": ["name"],
    '"",ACGT,IIII,3,1': ["name"],
}


def listed(block):
    """Fields and faults of each line as lists."""
    columns, faults = block
    return list(zip(*(c.to_pylist() for c in columns))), faults.to_pylist()


def test_each_kind_of_line():
    for line, faults in CASES.items():
        assert M.diagnose(line)[1] == faults, line
    fields, faults = listed(M.parse_block(pa.array(list(CASES), pa.string())))
    assert faults == list(CASES.values())
    assert list(fields[0]) == ["n1", "ACGT", "IIII", "3", "1"] and list(fields[3]) == ["n,1", "acgtN", 'I"I,I', "8", "2"]


line = st.one_of(st.none(), st.sampled_from(list(CASES)), st.text(alphabet='nACGTN",I\r\n318 é', max_size=24), st.from_regex(r'\A("?)[!-~]{1,4}\1,[ACGT]{2},[!-~]{2},[1-9],[12]\r?\Z'))


@settings(max_examples=150, deadline=None)
@given(st.lists(line, max_size=60))
def test_blocks_agree_with_single_lines(lines):
    fields, faults = listed(M.parse_block(pa.array(lines, pa.string())))
    for x, f, bad in zip(lines, fields, faults):
        want, why = M.diagnose(x)
        assert bad == why
        if not why:
            assert list(f) == want


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(1, "a", GOOD), (2, None, GOOD), (None, "b", None), (4, "c", "x")]
    df = spark.createDataFrame(rows, "raw_id long, faults string, line string").withColumnRenamed("faults", "name")
    got = {(r.id, r.reason) for r in M.fault_rows(M.parse_lines(df)).collect()}
    assert got == {(None, "columns"), (4, "columns")}
    valid = M.valid_rows(M.parse_lines(df)).orderBy("id").collect()
    assert [(r.id, r.name, r.lane, r.mate, r.len) for r in valid] == [(1, "n1", 3, 1, 4), (2, "n1", 3, 1, 4)]
    assert M.parse_lines(df.limit(0)).count() == 0


def test_very_long_line(spark):
    n = 300_000
    df = spark.createDataFrame([(1, f"n,{'A' * n},{'I' * n},1,1"), (2, f"n,{'A' * n},{'I' * (n - 1)},1,1")], "raw_id long, line string")
    assert [tuple(r) for r in M.fault_rows(M.parse_lines(df)).collect()] == [(2, "qual")]


@pytest.mark.parametrize("n", [1, 11, 13, 1000])
def test_one_bad_line_in_a_block(n):
    lines = [GOOD] * n
    lines[n // 2] = 'n1,"A"C,II,1,1'
    _, faults = listed(M.parse_block(pa.array(lines, pa.string())))
    assert [i for i, f in enumerate(faults) if f] == [n // 2] and faults[n // 2] == ["quoting"]
