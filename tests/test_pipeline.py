import glob

from strandloom import cli
from strandloom.plans import pipeline
from strandloom.sources import bam, tables


def lines(path):
    return [x for p in sorted(glob.glob(f"{path}/part-*")) for x in open(p).read().splitlines()]


def test_from_files_to_abundance(spark, micro, tmp_path):
    d = micro["dir"]
    index = pipeline.build_index(spark, str(d / "genome.fa"), str(d / "genes.gtf"), str(tmp_path / "index"))
    t = {r.name: r for r in index["transcripts"].collect()}
    assert {n: r.seq for n, r in t.items()} == micro["seqs"]
    g = {r.ensembl_id: r for r in index["genes"].collect()}
    assert g["g3"].strand == "-" and g["g1"].name == "Ng1" and g["g4"].name is None
    assert {r.name: r.offset for r in index["chroms"].collect()} == {"chr1": 0, "chr2": 4000, "chr3": 8000}

    out = str(tmp_path / "quant")
    done = pipeline.quantify_pairs(spark, index, [str(d / "r1.fq")], [str(d / "r2.fq")], out, 2, str(tmp_path / "a.bam"), on_transcripts=True)
    s = done["summary"].first()
    assert s.total == 201 and s.proper >= 198 and s.unmapped >= 1
    est = {r.target_id: r.est_counts for r in done["abundance"].collect()}
    true = {n: sum(t == n for t, _ in micro["truth"]) for n in est}
    genes_true, genes_est = {}, {}
    for n in est:
        genes_true[n[-2:]] = genes_true.get(n[-2:], 0) + true[n]
        genes_est[n[-2:]] = genes_est.get(n[-2:], 0) + est[n]
    assert all(abs(genes_est[k] - genes_true[k]) < 8 for k in genes_true)
    written = lines(f"{out}/abundance.tsv")
    assert written[0] == "#target_id\tunique_map\tlength\teff_length\test_counts\ttpm" and len(written) == 9
    assert written[1].split("\t")[0] == sorted(est)[0] and written[1].split("\t")[4].count(".") == 1
    assert lines(f"{out}/abundance.gene.tsv")[0] == "#gene_id\tgene_name\test_counts\ttpm"
    assert spark.read.parquet(f"{out}/bootstrap/bootstrap").select("bs").distinct().count() == 2

    rows = bam.read_bam(spark, str(tmp_path / "a.bam")).collect()
    primary = [r for r in rows if not r.flag & 256 and not r.flag & 4]
    assert len(primary) == 2 * s.proper
    by = {}
    for r in primary:
        by.setdefault(r.qname, []).append(r)
    seqs, right = micro["seqs"], 0
    for k, (name, at) in enumerate(micro["truth"]):
        hit = [r for r in by.get(f"p{k}", []) if not r.flag & 16]
        right += any(r.rname == name and abs(r.pos - 1 - at) < 4 for r in hit) or any(seqs[r.rname][r.pos - 1:r.pos + 99] == seqs[name][at:at + 100] for r in hit)
    assert right >= 195
    result = cli.model(spark, str(tmp_path / "a.bam"), str(tmp_path / "model"))
    assert abs(sum(r.tpm for r in result.collect()) - 1e6) < 1
    assert tables.load_model(spark, str(tmp_path / "model" / "model.json")).p.sum() > 0.99


def test_single_reads_and_transcript_index(spark, micro, tmp_path):
    fa = tmp_path / "t.fa"
    fa.write_text("".join(f">{n} text\n{s}\n" for n, s in micro["seqs"].items()))
    index = pipeline.index_transcripts(spark, str(fa), str(tmp_path / "i"))
    done = pipeline.quantify_single(spark, index, [str(micro["dir"] / "r1.fq")], str(tmp_path / "q"))
    assert abs(sum(r.est_counts for r in done["abundance"].collect()) - 200) < 3
    assert done["genes"].count() == 4


def test_arguments():
    p = cli.parser()
    a = p.parse_args(["quant", "-1", "a", "b", "-2", "c", "d", "-i", "x", "-b", "3", "-z", "6"])
    assert a.left == ["a", "b"] and a.bootstraps == 3 and a.level == 6


def test_pairs_beside_the_transcriptome_are_found_on_the_genome(spark, micro, tmp_path):
    from tests.conftest import revcomp

    d, chrom = micro["dir"], micro["chroms"]["chr2"]
    pairs = [(k, chrom[2000 + 40 * k:2100 + 40 * k], revcomp(chrom[2150 + 40 * k:2250 + 40 * k])) for k in range(5)]
    index = pipeline.build_index(spark, str(d / "genome.fa"), str(d / "genes.gtf"), str(tmp_path / "index"))
    df = spark.createDataFrame(pairs, "pair long, seq1 string, seq2 string")
    found = pipeline.align_pairs(df, index)
    assert {r.outcome for r in found["outcomes"].collect()} == {"unmapped"}
    contigs = spark.createDataFrame([(k, s) for k, s in enumerate(micro["chroms"].values())], "tid int, seq string")
    got = {(r.pair, r.tid, r.pos1, r.pos2) for r in pipeline.genome_fallback(df, found, contigs).collect()}
    assert got == {(k, 1, 2000 + 40 * k, 2150 + 40 * k) for k in range(5)}


def columns(r, chrom):
    """Read and reference bases of a SAM row side by side, and the place behind it."""
    at, i, out = r.pos - 1, 0, []
    for n, op in bam.parse_cigar(r.cigar):
        if op == "M":
            out += [(r.seq[i + k], chrom[at + k]) for k in range(n)]
        out += [(None, chrom[at + k]) for k in range(n)] if op == "D" else [(r.seq[i + k], None) for k in range(n)] if op == "I" else []
        at, i = at + (n if op in "MDN" else 0), i + (n if op in "MIS" else 0)
    assert i == len(r.seq)
    return out, at


def md_of(pairs):
    text, run, gone = "", 0, False
    for a, b in pairs:
        if b is None:
            continue
        if a is None:
            text, run, gone = text + ("" if gone else f"{run}^") + b, 0, True
        elif a == b:
            run, gone = run + 1, False
        else:
            text, run, gone = f"{text}{run}{b}", 0, False
    return f"{text}{run}"


def check_records(rows, refs):
    """CIGAR, NM, MD and AS of every record agree with the bases; mates name each other."""
    by = {}
    for r in rows:
        by.setdefault((r.qname, bool(r.flag & 256)), []).append(r)
        if r.flag & 4:
            assert (r.rname, r.pos, r.cigar, r.nm, r.md) == ("*", 0, "*", None, None)
            continue
        pairs, _ = columns(r, refs[r.rname])
        assert r.nm == sum(a != b for a, b in pairs) and r.score == sum(a == b for a, b in pairs), r
        assert r.md == md_of(pairs), r
    for (_, second), pair in by.items():
        if second or len(pair) != 2:
            continue
        a, b = pair
        assert (a.pnext, b.pnext) == (b.pos, a.pos) and a.tlen == -b.tlen
        assert bool(a.flag & 8) == bool(b.flag & 4) and bool(a.flag & 32) == bool(b.flag & 16) and (a.flag ^ b.flag) & 192 == 192
        assert a.rnext == ("=" if a.rname == b.rname != "*" else b.rname)


def test_every_outcome_has_its_records(spark, micro, tmp_path):
    """Proper pairs on the genome with introns, rescued mates, discordant pairs, pairs on one strand, single mates, unmapped pairs."""
    from tests.conftest import revcomp

    d, seqs, chroms = micro["dir"], micro["seqs"], micro["chroms"]
    a, c = seqs["g1a:g1"], seqs["g4a:g4"]
    noise = "TTGACCA" * 15
    worn = list(revcomp(a[400:500]))
    for k in range(10, 100, 12):
        worn[k] = "ACGT"["ACGT".index(worn[k]) - 1]
    cases = {
        "proper": (a[200:300], revcomp(a[400:500])),
        "rescued": (a[200:300], "".join(worn)),
        "indel": (a[200:240] + "ACC" + a[240:297], revcomp(a[400:450] + a[453:503])),
        "discordant": (a[200:300], revcomp(c[400:500])),
        "forward": (a[200:300], c[400:500]),
        "reverse": (revcomp(a[200:300]), revcomp(c[400:500])),
        "single": (a[200:300], noise[:100]),
        "unmapped": (noise[:100], noise[3:103]),
        "genome": (chroms["chr2"][2000:2100], revcomp(chroms["chr2"][2150:2250])),
        "split": (chroms["chr2"][2400:2450] + chroms["chr2"][3000:3050], revcomp(chroms["chr2"][3200:3300])),
    }
    for m in (0, 1):
        (tmp_path / f"{m}.fq").write_text("".join(f"@{n}/{m + 1}\n{s[m]}\n+\n{'I' * len(s[m])}\n" for n, s in cases.items()))
    index = pipeline.build_index(spark, str(d / "genome.fa"), str(d / "genes.gtf"), str(tmp_path / "index"), with_genome=True)
    fq = [[str(tmp_path / f"{m}.fq")] for m in (0, 1)]
    done = pipeline.quantify_pairs(spark, index, *fq, str(tmp_path / "out"), 0, str(tmp_path / "g.bam"))
    rows = bam.read_bam(spark, str(tmp_path / "g.bam")).collect()
    assert bam.references(str(tmp_path / "g.bam")) == [(n, 4000) for n in chroms]
    check_records(rows, chroms)
    first = {}
    for r in rows:
        if not r.flag & 256:
            first.setdefault(r.qname, {})[1 if r.flag & 64 else 2] = r
    assert set(first) == set(cases) and all(set(v) == {1, 2} for v in first.values())
    state = {n: (bool(v[1].flag & 2), bool(v[1].flag & 4), bool(v[2].flag & 4)) for n, v in first.items()}
    assert state == {
        "proper": (True, False, False), "rescued": (True, False, False), "indel": (True, False, False), "discordant": (False, False, False), "forward": (False, False, False), "reverse": (False, False, False), "single": (False, False, True),
        "unmapped": (False, True, True), "genome": (True, False, False), "split": (True, False, False),
    }
    assert "150N" in first["proper"][1].cigar + first["proper"][2].cigar  # exons of 250 bases, 400 apart
    gap = [n for n, op in bam.parse_cigar(first["split"][1].cigar) if op == "N"]
    assert len(gap) == 1 and abs(gap[0] - 550) < 4 and first["split"][1].pos == 2401 and first["split"][1].nm < 3
    assert first["rescued"][2].nm > 0 and first["discordant"][1].rnext == "chr3"
    assert {first["forward"][k].flag & 16 for k in (1, 2)} == {0} and {first["reverse"][k].flag & 16 for k in (1, 2)} == {16}
    outcomes = {r.outcome: r["count"] for r in done["outcomes"].groupBy("outcome").count().collect()}
    assert outcomes["unmapped"] == 3 and outcomes["both_forward"] == outcomes["both_reverse"] == 1


def test_single_reads_have_records_and_a_summary(spark, micro, tmp_path):
    from tests.conftest import revcomp

    d, a, g = micro["dir"], micro["seqs"]["g1a:g1"], micro["chroms"]["chr2"]
    reads = {"plus": a[300:400], "minus": revcomp(a[300:400]), "genome": g[2000:2100], "none": "TTGACCA" * 14}
    (tmp_path / "s.fq").write_text("".join(f"@{n}\n{s}\n+\n{'I' * len(s)}\n" for n, s in reads.items()))
    index = pipeline.build_index(spark, str(d / "genome.fa"), str(d / "genes.gtf"), str(tmp_path / "index"))
    done = pipeline.quantify_single(spark, index, [str(tmp_path / "s.fq")], str(tmp_path / "out"), 0, str(tmp_path / "s.bam"), genome=str(d / "genome.fa"))
    rows = bam.read_bam(spark, str(tmp_path / "s.bam")).collect()
    check_records(rows, micro["chroms"])
    flags = {r.qname: r.flag for r in rows if not r.flag & 256}
    assert flags == {"plus": 0, "minus": 16, "genome": 0, "none": 4}
    assert tuple(done["summary"].first()) == (4, 2, 2, 0.5)


def test_command_line_from_genome_to_model(spark, micro, tmp_path):
    from strandloom import runtime

    d = micro["dir"]
    held = list(runtime._WRITTEN)
    runtime._WRITTEN.clear()  # of other tests: main deletes what it wrote
    try:
        assert cli.main(["build", "--fasta", str(d / "genome.fa"), "--gtf", str(d / "genes.gtf"), "--outdir", str(tmp_path / "i"), "--with-genome"]) == 0
        assert cli.main(["quant", "-1", str(d / "r1.fq"), "-2", str(d / "r2.fq"), "-i", str(tmp_path / "i"), "-o", str(tmp_path / "o"), "-w", str(tmp_path / "o.bam"), "-p", "run1.", "--on-transcripts", "-b", "1"]) == 0
        assert cli.main(["model", str(tmp_path / "o.bam"), "-o", str(tmp_path / "m")]) == 0
        assert not runtime._WRITTEN
    finally:
        runtime._WRITTEN.extend(held)
    assert len(lines(tmp_path / "o" / "run1.abundance.tsv")) == 9 and lines(tmp_path / "o" / "run1.abundance.gene.tsv")
    assert lines(tmp_path / "m" / "result.tsv")[0].startswith("#trans_id")
