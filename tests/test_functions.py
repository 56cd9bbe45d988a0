import numpy as np
import pyspark.sql.functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.functions import sam, seq, stats
from strandloom.operators import kmers
from tests.conftest import revcomp


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_sequence_functions(spark):
    rows = ["ACGTN", "acgtn", "", "TTTT"]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    got = df.select(seq.codes(F.col("s")), seq.reverse_complement(F.col("s"))).collect()
    assert [r[0] for r in got] == ["01234", "01234", "", "3333"] and [r[1] for r in got] == ["NACGT", "nacgt", "", "AAAA"]
    code = one(spark, seq.kmer_code(F.lit("ACGT" * 7 + "ACG")))
    assert code == int("0123" * 7 + "012", 4)
    assert one(spark, seq.kmer_text(F.lit(code))) == "ACGT" * 7 + "ACG"
    assert one(spark, seq.kmer_code(F.lit("ACN"))) is None
    assert one(spark, seq.strip_mate(F.lit("a/1"))) == "a" and one(spark, seq.strip_mate(F.lit("a/b"))) == "a/b"
    assert one(spark, seq.bucket(F.lit(0), F.lit(100))) == 1 and one(spark, seq.bucket(F.lit(99), F.lit(100))) == 64
    assert one(spark, seq.fake_quality(F.lit("ACG"), F.lit(None))) == "AAA"


@settings(max_examples=40, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=60), st.integers(1, 31))
def test_packing_of_kmers(s, k):
    codes = np.frombuffer(s.translate(str.maketrans("ACGT", "\0\1\2\3")).encode(), np.uint8)
    want = [int(s[i:i + k].translate(str.maketrans("ACGT", "0123")), 4) for i in range(len(s) - k + 1)]
    assert kmers.pack(codes, k).tolist() == want


def test_kmers_leave_out_n_and_short_and_null(spark):
    df = spark.createDataFrame([(1, "ACGTNACGT"), (2, "AC"), (3, None), (4, "acgt")], "id int, s string")
    got = {(r.id, r.at) for r in kmers.kmers(df, ["id"], "s", 3).collect()}
    assert got == {(1, 0), (1, 1), (1, 5), (1, 6), (4, 0), (4, 1)}
    last = {(r.id, r.at) for r in kmers.kmers(df, ["id"], "s", 3, stride=4, last=True).collect()}
    assert last == {(1, 0), (1, 6), (4, 0), (4, 1)}


def cigar(*ops):
    return F.array(*[F.struct(F.lit(o).alias("op"), F.lit(n).alias("len"), F.lit(r).alias("ref")) for n, o, r in ops])


def test_cigars(spark):
    c = cigar((3, "=", ""), (0, "I", ""), (2, "=", ""), (1, "X", "A"), (1, "X", "C"), (2, "D", "GT"), (4, "=", ""), (2, "S", ""), (3, "=", ""))
    merged = sam.merge_runs(c)
    assert one(spark, sam.cigar_text(merged)) == "5=2X2D4=5S"
    assert one(spark, sam.md_text(merged)) == "5A0C0^GT4"
    assert one(spark, sam.edit_count(merged)) == 4 and one(spark, sam.match_count(merged)) == 9
    assert one(spark, sam.read_length(merged)) == 16 and one(spark, sam.reference_length(merged)) == 13
    assert one(spark, sam.cigar_text(sam.normalised(merged))) == "7M2D4M5S"
    assert one(spark, sam.cigar_text(sam.merge_runs(cigar((4, "S", ""), (2, "=", ""))))) == "4S2="
    assert one(spark, sam.cigar_text(sam.merge_runs(cigar((0, "=", ""))))) == ""
    assert one(spark, sam.cigar_text(sam.concat_cigars(cigar((2, "=", "")), cigar((3, "=", ""))))) == "5="
    assert one(spark, sam.cigar_text(sam.runs_of(F.lit("==XXX=")))) == "2=3X1="
    assert one(spark, sam.reverse_cigar(cigar((2, "=", ""), (2, "D", "AC"))))[0].ref == "CA"


def test_flags_bins_and_quality(spark):
    t, f = F.lit(True), F.lit(False)
    assert one(spark, sam.flag(paired=t, proper=t, unmapped=f, reverse=t, first=t)) == 1 + 2 + 16 + 64
    assert [one(spark, sam.mapq(F.lit(n))) for n in (0, 1, 2, 3, 10)] == [0, 70, 3, 1, 0]
    assert one(spark, sam.reg2bin(F.lit(0), F.lit(100))) == 4681
    assert one(spark, sam.reg2bin(F.lit(16383), F.lit(16385))) == 585
    assert one(spark, sam.template_length(F.lit(10), F.lit(60), F.lit(100), t, t)) == 150
    assert one(spark, sam.template_length(F.lit(60), F.lit(10), F.lit(100), t, f)) == -150


def test_rates_and_lengths(spark):
    df = spark.createDataFrame([(1, 2.0, 100), (2, 6.0, 300), (3, 0.0, 10)], "tid int, rate double, len int")
    assert {r.tid: r.tpm for r in stats.tpm(df).collect()} == {1: 250000.0, 2: 750000.0, 3: 0.0}
    assert [r.e for r in df.orderBy("tid").select(stats.effective_length(F.col("len"), F.lit(100)).alias("e")).collect()] == [1.0, 201.0, 0.0]
    obs = spark.createDataFrame([(50,)] * 3 + [(150,)], "f int")
    h = stats.histogram(obs, "f")
    assert [(r.f, r.n, r.pdf, r.cdf) for r in h.orderBy("f").collect()] == [(50, 3, 0.75, 0.75), (150, 1, 0.25, 1.0)]
    got = {r.tid: r.eff_length for r in stats.model_effective_length(df, "len", h, "f").collect()}
    assert got == {1: 0.75 * 51, 2: 0.75 * 251 + 0.25 * 151, 3: 0.0}
    s = stats.mean_and_sd(h, "f", F.col("n").cast("double")).first()
    assert s.mean == 75 and abs(s.sd - 43.30127) < 1e-4


def test_reverse_complement_is_its_own_inverse(spark):
    s = "ACGTNacgtn" * 5
    assert one(spark, seq.reverse_complement(seq.reverse_complement(F.lit(s)))) == s
    k = "GATTACA" * 4 + "GAT"
    assert one(spark, seq.kmer_text(seq.reverse_code(seq.kmer_code(F.lit(k))))) == revcomp(k)
