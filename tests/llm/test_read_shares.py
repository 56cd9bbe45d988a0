import random

from strandloom.llm import queries
from strandloom.runtime import ship


def test_every_read_with_a_sequence_has_its_share(spark, tmp_path):
    ship(spark)
    rng = random.Random(3)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    common = base(60)
    reads = [(1, common + base(40)), (2, base(20) + common.lower()), (3, base(100)), (4, "ACGT"), (5, ""), (6, None)]
    spark.createDataFrame(reads + reads[:3], "read_id long, seq string").write.parquet(f"{tmp_path}/reads.parquet")
    got = {r.read_id: (r.shared, r.part) for r in queries.all_queries()["p4_read_shares"](spark, str(tmp_path)).collect()}
    assert got == {1: (60, 0.6), 2: (60, 0.75), 3: (0, 0.0), 4: (0, 0.0), 5: (0, 0.0)}
