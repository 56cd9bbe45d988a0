import glob
import os
import sys

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from strandloom.runtime import local_session

    s = local_session(4, 4, "3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def revcomp(s: str) -> str:
    return s[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))


@pytest.fixture(scope="session")
def micro(tmp_path_factory):
    """A genome of 3 chromosomes, 4 genes and 8 transcripts, and 200 read pairs with their true transcripts."""
    rng = np.random.default_rng(5)
    d = tmp_path_factory.mktemp("micro")
    chroms = {f"chr{k}": "".join(rng.choice(list("ACGT"), 4000)) for k in (1, 2, 3)}
    genes = [("g1", "chr1", "+", 200), ("g2", "chr1", "+", 700), ("g3", "chr2", "-", 300), ("g4", "chr3", "+", 100)]
    gtf, seqs = ["#!a comment"], {}
    for g, c, strand, start in genes:
        exons = [(start + k * 400, start + k * 400 + 250) for k in range(3)]
        extra = ' gene_name "N%s";' % g if g != "g4" else ""
        gtf.append(f'{c}\tx\tgene\t{start + 1}\t{exons[-1][1]}\t.\t{strand}\t.\tgene_id "{g}";{extra}')
        for t, use in ((f"{g}a", exons), (f"{g}b", exons[:1] + exons[2:])):
            gtf.append(f'{c}\tx\ttranscript\t{start + 1}\t{exons[-1][1]}\t.\t{strand}\t.\tgene_id "{g}"; transcript_id "{t}";')
            gtf += [f'{c}\tx\texon\t{a + 1}\t{b}\t.\t{strand}\t.\tgene_id "{g}"; transcript_id "{t}";' for a, b in use]
            seqs[f"{t}:{g}"] = "".join(chroms[c][a:b] for a, b in use)
    gtf.append('chrUn\tx\texon\t1\t50\t.\t+\t.\tgene_id "g9"; transcript_id "t9";')
    (d / "genome.fa").write_text("".join(f">{n} some text\n" + "\n".join(s[k:k + 60] for k in range(0, len(s), 60)) + "\n" for n, s in chroms.items()))
    (d / "genes.gtf").write_text("\n".join(gtf) + "\n")
    names = sorted(seqs)
    truth, r1, r2 = [], [], []
    for k in range(200):
        t = names[k % 3 * 2]
        s = seqs[t]
        at = int(rng.integers(0, len(s) - 260))
        frag = list(s[at:at + 250])
        for _ in range(int(rng.integers(0, 3))):
            frag[int(rng.integers(0, 250))] = "ACGT"[int(rng.integers(0, 4))]
        frag = "".join(frag)
        truth.append((t, at))
        a, b = frag[:100], revcomp(frag[-100:])
        r1.append(f"@p{k}/1\n{a}\n+\n{'I' * 100}\n")
        r2.append(f"@p{k}/2\n{b}\n+\n{'@' * 100}\n")
    noise = "".join(rng.choice(list("ACGT"), 100))
    r1.append(f"@noise/1\n{noise}\n+\n{'I' * 100}\n")
    r2.append(f"@noise/2\n{noise[::-1]}\n+\n{'I' * 100}\n")
    (d / "r1.fq").write_text("".join(r1))
    (d / "r2.fq").write_text("".join(r2))
    return {"dir": d, "seqs": seqs, "truth": truth, "chroms": chroms}
