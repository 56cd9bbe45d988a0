import gzip

import numpy as np
import pytest

from strandloom.sources import bam, files
from strandloom.sources import reads as R

FQ = "@a/1\nACGT\n+\nIIII\n@b\nAC\n+b\n@@\n\n@c\nACG\n+\nII\n@d\n\n+\n\n@e\nAC\n-\nII\n@f\nACGTA\n+\n@+@+@\n"
WANT = [("a/1", "ACGT", None), ("b", "AC", None), ("c", "ACG", "quality"), ("d", "", "sequence"), ("e", "AC", "plus"), ("f", "ACGTA", None)]


@pytest.mark.parametrize("split", [1 << 20, 40])
def test_fastq(spark, tmp_path, split):
    p = tmp_path / "x.fq"
    p.write_text(FQ)
    got = sorted((r.name, r.seq, r.problem) for r in R.scan(spark, str(p), 1 << 20).collect())
    assert got == WANT
    with gzip.open(tmp_path / "x.fq.gz", "wt") as f:
        f.write(FQ)
    got = sorted((r.name, r.seq, r.problem) for r in R.scan(spark, str(tmp_path / "x.fq.gz"), split).collect())
    assert got == WANT


@pytest.mark.parametrize("split", [37, 100, 1000])
def test_splits_lose_and_double_nothing(spark, tmp_path, split):
    rng = np.random.default_rng(split)
    recs = []
    for k in range(60):
        n = int(rng.integers(1, 30))
        recs.append((f"r{k}", "".join(rng.choice(list("ACGTN"), n)), "".join(rng.choice(list("@+I,"), n))))
    (tmp_path / "a.fq").write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in recs))
    got = R.with_ordinals(R.scan(spark, str(tmp_path / "a.fq"), split)).orderBy("ordinal").collect()
    assert [(r.name, r.seq, r.qual) for r in got] == recs and [r.ordinal for r in got] == list(range(60))
    (tmp_path / "a.fa").write_text("".join(f">{n} x\n{s[:7]}\n{s[7:]}\n" for n, s, _ in recs))
    got = R.with_ordinals(R.scan(spark, str(tmp_path / "a.fa"), split)).orderBy("ordinal").collect()
    assert [(r.name, r.seq) for r in got] == [(n + " x", s) for n, s, _ in recs]


def test_pairs_and_their_checks(spark, tmp_path):
    for name, n in (("a", 3), ("b", 2)):
        (tmp_path / f"{name}.fq").write_text("".join(f"@{name}{k}\nAC\n+\nII\n" for k in range(n)))
    a, b = str(tmp_path / "a.fq"), str(tmp_path / "b.fq")
    got = R.pairs(spark, [a], [b]).orderBy("ordinal").collect()
    assert [(r.name1, r.name2, r.lane) for r in got] == [("a0", "b0", 1), ("a1", "b1", 1)]
    with pytest.raises(Exception, match="differ in length"):
        R.pairs(spark, [a], [b], strict=True).collect()
    with pytest.raises(ValueError):
        R.pairs(spark, [a], [a])
    with pytest.raises(ValueError):
        R.pairs(spark, [a, b], [b])
    (tmp_path / "c").write_text("what")
    with pytest.raises(ValueError):
        files.sniff(str(tmp_path / "c"))


def test_bam_and_sam_round_trip(spark, tmp_path):
    cols = bam.SCHEMA
    rows = [
        ("q1", 99, "t1", 5, 70, "3=1X2I4S", "=", 50, 55, "ACGTNACGTA", "IIIIIIIIII", 1, "3A", 3),
        ("q2", 4, "*", 0, 0, "*", "*", 0, 0, "ACG", "*", None, None, None),
        ("q3", 16, "t2", 1, 3, "5M1000000N5M", "t1", 7, -9, "ACGTACGTAC", "!!!!!!!!!~", 0, "10", 10),
    ]
    df = spark.createDataFrame(rows, cols).repartition(2)
    p = str(tmp_path / "x.bam")
    bam.write_bam(df, p, [("t1", 100), ("t2", 2_000_000)], 6, "cmd")
    back = sorted(tuple(r) for r in bam.read_bam(spark, p).collect())
    assert back == rows
    assert bam.references(p) == [("t1", 100), ("t2", 2_000_000)]
    assert (tmp_path / "x.bam").read_bytes().endswith(bam.EOF)
    assert gzip.decompress((tmp_path / "x.bam").read_bytes()).startswith(b"BAM\1")
    bam.sam_lines(df).write.text(str(tmp_path / "sam"))
    assert sorted(tuple(r) for r in bam.read_sam(spark, str(tmp_path / "sam")).collect()) == rows
    bam.write_bam(df.limit(0), p, [])
    assert bam.read_bam(spark, p).count() == 0


def test_large_bam(spark, tmp_path):
    df = spark.range(5000).selectExpr("concat('r', id) qname", "0 flag", "'t' rname", "cast(id + 1 as int) pos", "1 mapq", "'100M' cigar", "'*' rnext", "0 pnext", "0 tlen", "repeat('ACGTA', 20) seq", "repeat('I', 100) qual", "cast(id % 9 as int) nm", "'100' md", "100 score")
    bam.write_bam(df, str(tmp_path / "l.bam"), [("t", 9999)])
    got = bam.read_bam(spark, str(tmp_path / "l.bam"))
    assert got.count() == 5000 and got.exceptAll(df.select(got.columns)).count() == 0


def test_damage_is_noticed(tmp_path):
    block = bytearray(bam.bgzf_block(b"abc" * 100))
    block[30] ^= 255
    with pytest.raises(Exception):
        list(bam.bgzf_read(__import__("io").BytesIO(bytes(block))))


@pytest.mark.parametrize("split", [300, 5000, 70_000, 1 << 20])
def test_bam_splits_lose_and_double_nothing(spark, tmp_path, split):
    rng = np.random.default_rng(split)
    rows = []
    for k in range(3000):
        n = int(rng.integers(1, 120)) if k % 500 else 90_000  # some records span blocks
        rows.append((f"read{k}", int(rng.choice([0, 4, 16])), "t" if k % 7 else "*", int(rng.integers(1, 900)) if k % 7 else 0, 9, f"{n}M", "*", 0, 0, "".join(rng.choice(list("ACGT"), n)), "".join(rng.choice(list("#5I"), n)), k % 5, str(n), n))
    refs = [("t", 1000)] + [(f"other{k}", 5) for k in range(6000)]  # a header of several blocks
    ids = {n: k for k, (n, _) in enumerate(refs)}
    names = [c.split()[0] for c in bam.SCHEMA.split(", ")]
    data = b"".join(bam.encode(dict(zip(names, r)), ids) for r in rows)
    path = tmp_path / "x.bam"
    path.write_bytes(bam.bgzf_blocks(bam.header(refs) + data) + bam.EOF)  # blocks end anywhere in a record
    reader = bam._BamReader({"path": str(path), "split": split})
    parts = reader.partitions()
    assert len(parts) > 1 or split > 70_000
    got = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert got == rows


def test_bam_as_a_folder_of_parts(spark, tmp_path):
    df = spark.range(3000).selectExpr("concat('r', id) qname", "0 flag", "'t' rname", "cast(id + 1 as int) pos", "1 mapq", "'10M' cigar", "'*' rnext", "0 pnext", "0 tlen", "repeat('ACGTA', 2) seq", "repeat('I', 10) qual", "cast(id % 9 as int) nm", "'10' md", "10 score").repartition(3)
    p = f"file://{tmp_path}/parts.bam"
    bam.write_bam(df, p, [("t", 9999)], single=False)
    back = bam.read_bam(spark, p, 4000)
    assert back.rdd.getNumPartitions() > 3 and back.count() == 3000 and back.exceptAll(df.select(back.columns)).count() == 0
    whole = b"".join(f.read_bytes() for f in sorted((tmp_path / "parts.bam").iterdir()))
    assert whole.endswith(bam.EOF) and gzip.decompress(whole).startswith(b"BAM\1") and bam.references(p) == [("t", 9999)]
