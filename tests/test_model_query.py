import numpy as np
import pytest

from strandloom.operators import generative
from strandloom.plans import abundances
from strandloom.runtime import ship


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """200 reads, 80 of them without a mapped alignment."""
    ship(spark)
    rng, d = np.random.default_rng(8), tmp_path_factory.mktemp("model")
    aligns = [(r, r, int(k), int(rng.integers(1, 65)), 200, int(rng.integers(0, 3)), 1) for r in range(120) for k in {rng.integers(0, 3), rng.integers(0, 3)}]
    aligns += [(200, 150, -1, 1, 200, 0, 1), (201, 151, None, 1, 200, 0, 1)]
    spark.createDataFrame([(k, n) for k, n in enumerate((500, 700, 900))], "tid int, len int").write.parquet(f"{d}/transcripts.parquet")
    spark.createDataFrame([(r, 100) for r in range(200)] + [(150, 100)], "read_id long, len int").write.parquet(f"{d}/reads.parquet")
    spark.createDataFrame(aligns, "align_id long, read_id long, trans_id int, pos int, f_len int, dis int, ori int").write.parquet(f"{d}/f_align.parquet")
    return str(d)


def test_reads_without_an_alignment_are_noise(spark, small, monkeypatch):
    seen, fit = [], generative.fit
    monkeypatch.setattr(generative, "fit", lambda *a, **k: seen.append(fit(*a, **k)) or seen[-1])
    out = abundances.generative_model(spark, small).collect()
    assert abs(seen[0].p[0] - 0.4) < 0.01 and seen[0].converged
    assert abs(sum(r.read_count for r in out) - 120) < 1


def test_a_model_that_has_not_converged_fails(spark, small, monkeypatch):
    fit = generative.fit
    monkeypatch.setattr(generative, "fit", lambda t, table, unmapped: fit(t, table, unmapped, full=1, most=0))
    with pytest.raises(RuntimeError, match="converged"):
        abundances.generative_model(spark, small)
