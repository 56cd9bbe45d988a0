import random

from strandloom.plans import pipeline
from strandloom.runtime import ship
from tests.conftest import revcomp


def test_pairs_in_repeats_are_found_on_the_genome(spark):
    ship(spark)
    rng = random.Random(6)
    unit = "".join(rng.choice("ACGT") for _ in range(240))
    contigs = spark.createDataFrame([(0, unit * 1010)], "tid int, seq string")
    pairs = spark.createDataFrame([(1, unit[:80], revcomp(unit[90:170]))], "pair long, seq1 string, seq2 string")
    found = {"outcomes": spark.createDataFrame([], "pair long, outcome string")}
    got = pipeline.genome_fallback(pairs, found, contigs)
    assert {(0, 240 * k) for k in range(1010)} <= {(r.tid, r.pos1) for r in got.collect()}
