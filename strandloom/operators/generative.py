"""Generative model of alignments, after the published RSEM-style models.

A read comes from a target (or from noise) and has a fragment length, a start
bucket, an orientation and mismatches, each with a distribution of its own.
Every E-step is one pass over a written table of alignments, partitioned by
read; tasks send back sums by distribution, never rows per read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.runtime import materialize

BUCKETS, MAX_LENGTH, TINY = 64, 1000, 1e-300
#: Alignments of a smaller share of their read don't count.
LEAST_SHARE = 1e-6


@dataclass
class Model:
    """Distributions; ``p`` has the noise first, then the targets in order of tid."""

    tids: np.ndarray
    lengths: np.ndarray
    p: np.ndarray
    length: np.ndarray = field(default_factory=lambda: np.full(MAX_LENGTH + 1, 1.0 / (MAX_LENGTH + 1)))
    start: np.ndarray = field(default_factory=lambda: np.full(BUCKETS, 1.0 / BUCKETS))
    forward: float = 0.5
    mismatch: float = 0.5
    converged: bool = False

    @property
    def cumulated(self) -> np.ndarray:
        return np.cumsum(self.length)

    def effective_lengths(self) -> np.ndarray:
        """Expected start places: sum over fitting lengths of pmf x (target - length + 1); below 1 it counts as 0."""
        m = np.minimum(self.lengths, MAX_LENGTH).astype(int)
        expected = self.cumulated[m] * (self.lengths + 1) - np.cumsum(self.length * np.arange(MAX_LENGTH + 1))[m]
        return np.where(expected >= 1, expected, 0.0)

    def to_json(self) -> dict:
        return {"tids": self.tids.tolist(), "lengths": self.lengths.tolist(), "p": self.p.tolist(), "length": self.length.tolist(), "start": self.start.tolist(), "forward": self.forward, "mismatch": self.mismatch}

    @classmethod
    def from_json(cls, d: dict) -> "Model":
        return cls(*(np.array(d[k]) for k in ("tids", "lengths", "p", "length", "start")), d["forward"], d["mismatch"])


def uniform(targets: DataFrame) -> Model:
    t = targets.select("tid", "len").orderBy("tid").toPandas()
    n = len(t)
    return Model(t["tid"].to_numpy(), t["len"].to_numpy(), np.full(n + 1, 1.0 / (n + 1)))


def _reach(m: Model, a: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The chance of the buckets where a fragment of that length can begin on its target, and the last of them (from 0)."""
    n = m.lengths[a["t"]]
    places = np.clip((n - a["f_len"] + 1) * (BUCKETS / n), 0.0, BUCKETS)
    whole = np.minimum(places.astype(int), BUCKETS - 1)
    before = np.concatenate([[0.0], np.cumsum(m.start)])
    last = np.clip(((n - a["f_len"]) * (BUCKETS / n)).astype(int), 0, BUCKETS - 1)
    return before[whole] + (places - whole) * m.start[whole], last


def _likelihood(m: Model, a: dict[str, np.ndarray]) -> np.ndarray:
    """Of each alignment given its target."""
    n = m.lengths[a["t"]]
    fits = np.minimum(n, MAX_LENGTH).astype(int)
    f = np.clip(a["f_len"], 0, MAX_LENGTH)
    length = np.where(f <= fits, m.length[f] / np.maximum(m.cumulated[fits], TINY), 0.0)
    q = min(max(m.mismatch, 1e-9), 1 - 1e-9)
    wrong = np.minimum(a["dis"], a["len"])
    errors = q**wrong * (1 - q) ** (a["len"] - wrong)
    side = np.where(a["ori"] == 1, m.forward, 1 - m.forward)
    # a bucket's chance is shared by its places; only those where the fragment fits can be seen
    start = m.start[a["bucket"] - 1] * (BUCKETS / n) / np.maximum(_reach(m, a)[0], 1e-12)
    return length * start * side * errors


def _columns(batch, tids: np.ndarray):
    """Alignments of a batch of whole reads, one entry each; ``r`` is the read's row."""
    nested = batch.column(1)
    inner = nested.flatten()
    per = np.diff(nested.offsets.to_numpy())
    row = np.repeat(np.arange(batch.num_rows), per)
    get = {k: inner.field(k).to_numpy(zero_copy_only=False) for k in ("tid", "bucket", "f_len", "dis", "ori")}
    get["r"], get["len"] = row, batch.column(0).to_numpy(zero_copy_only=False)[row]
    at = np.minimum(np.searchsorted(tids, get["tid"]), len(tids) - 1)
    keep = (tids[at] == get["tid"]) & (get["bucket"] >= 1) & (get["bucket"] <= BUCKETS)
    out = {k: v[keep] for k, v in get.items()}
    out["t"] = at[keep]
    return out


def _posteriors(m: Model, a, joint: np.ndarray):
    """Share of each alignment and of noise in its read."""
    _, first, which = np.unique(a["r"], return_index=True, return_inverse=True)
    noise = m.p[0] * 0.25 ** a["len"][first].astype(float)
    total = np.maximum(np.bincount(which, joint) + noise, TINY)
    share = joint / total[which]
    return np.where(share >= LEAST_SHARE, share, 0.0), noise / total


def _statistics(m: Model, only_p: bool):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from sums(batch)

    def sums(batch):
        a = _columns(batch, m.tids)
        if not len(a["t"]):
            return
        post, noise = _posteriors(m, a, np.maximum(m.p[a["t"] + 1] * _likelihood(m, a), TINY))
        out = [("p", 0, noise.sum())]
        by_target = np.bincount(a["t"], post, len(m.tids))
        hit = np.flatnonzero(by_target)
        out += [("p", k + 1, by_target[k]) for k in hit]
        if not only_p:
            f = np.bincount(np.clip(a["f_len"], 0, MAX_LENGTH), post, MAX_LENGTH + 1)
            y = np.bincount(np.minimum(m.lengths[a["t"]], MAX_LENGTH).astype(int), post, MAX_LENGTH + 1)
            s = np.bincount(a["bucket"] - 1, post, BUCKETS)
            seen, last = _reach(m, a)
            z = np.bincount(last, post / np.maximum(seen, 1e-12), BUCKETS)
            out += [("z", k, z[k]) for k in np.flatnonzero(z)]
            out += [("f", k, f[k]) for k in np.flatnonzero(f)] + [("y", k, y[k]) for k in np.flatnonzero(y)] + [("s", k, s[k]) for k in np.flatnonzero(s)]
            out += [("o", 0, post[a["ori"] == 1].sum()), ("o", 1, post.sum()), ("d", 0, (post * a["dis"]).sum()), ("d", 1, (post * a["len"]).sum())]
        kind, key, value = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.array(key, np.int64)), pa.array(np.array(value, float))], names=["kind", "key", "value"])

    return run


def start_distribution(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Chances of the start buckets from the mass ``x`` seen in each and the mass ``z`` by the last bucket that could be seen.

    A bucket's chance is its mass over what could have shown it, shifted by one
    number so that the chances add up to 1: the root of a falling convex
    function, which Newton's steps reach from the left without passing it.
    """
    passed = np.concatenate([[0.0], np.cumsum(z)[:-1]])
    kept = x > 0
    if not kept.any():
        return np.full(len(x), 1.0 / len(x))
    at = (passed + x)[kept].max()  # no chance is above 1
    for _ in range(200):
        rest = at - passed[kept]
        off = (x[kept] / rest).sum() - 1
        if off <= 1e-9:
            break
        at += off / (x[kept] / rest**2).sum()
    out = np.where(kept, x / np.where(kept, at - passed, 1.0), 0.0)
    return out / out.sum()


def _maximise(m: Model, sums: dict[tuple[str, int], float], unmapped: float, only_p: bool) -> Model:
    p = np.zeros(len(m.p))
    for (kind, key), v in sums.items():
        if kind == "p":
            p[key] = v
    p[0] += unmapped
    new = Model(m.tids, m.lengths, p / max(p.sum(), TINY), m.length, m.start, m.forward, m.mismatch)
    if only_p:
        return new

    def vector(kind, n):
        return np.array([sums.get((kind, k), 0.0) for k in range(n)])

    x, y, s = vector("f", MAX_LENGTH + 1), vector("y", MAX_LENGTH + 1), vector("s", BUCKETS)
    # lengths are seen only up to the target's: each counts by how many could have shown it
    could = np.cumsum((y / np.maximum(m.cumulated, TINY))[::-1])[::-1]
    pdf = np.divide(x, could, out=np.zeros_like(x), where=could > 0)
    if pdf.sum() > 0:
        new.length = pdf / pdf.sum()
    if s.sum() > 0:
        new.start = start_distribution(s, vector("z", BUCKETS))
    new.forward = sums.get(("o", 0), 0.0) / max(sums.get(("o", 1), 0.0), TINY)
    new.mismatch = sums.get(("d", 0), 0.0) / max(sums.get(("d", 1), 0.0), TINY)
    return new


def prepare(aligns: DataFrame, most: int = 1000) -> DataFrame:
    """The written table of reads: ``len`` and their ``aligns``, nested.

    ``aligns`` has the columns ``read``, ``len``, ``tid``, ``bucket``, ``f_len``,
    ``dis`` and ``ori``. Reads with ``most`` or more alignments are left out, as
    the model has it, before any is nested; so are alignments with a null. Where
    the rows of a read differ in ``len`` the largest stands.
    """
    cols = [F.col(c).cast(t) for c, t in (("read", "long"), ("len", "int"), ("tid", "int"), ("bucket", "int"), ("f_len", "int"), ("dis", "int"), ("ori", "int"))]
    rows = aligns.select(*cols).dropna()
    many = rows.groupBy("read").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= most).select("read")
    kept = rows.join(many, "read", "left_anti")
    nested = kept.groupBy("read").agg(F.max("len").alias("len"), F.collect_list(F.struct("tid", "bucket", "f_len", "dis", "ori")).alias("aligns"))
    return materialize(nested.select("len", "aligns"), "aligns")


def step(m: Model, table: DataFrame, unmapped: float = 0.0, only_p: bool = False) -> Model:
    """One E-step and M-step."""
    sums = table.mapInArrow(_statistics(m, only_p), "kind string, key long, value double")
    rows = sums.groupBy("kind", "key").agg(F.sum("value").alias("value")).collect()  # at most targets + some thousand rows
    return _maximise(m, {(r.kind, r.key): r.value for r in rows}, unmapped, only_p)


def _extrapolated(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared extrapolation of three successive vectors; entries that leave (0, inf) fall back to a tenth of the last."""
    r, v = b - a, (c - b) - (b - a)
    size = np.linalg.norm(v)
    if size == 0:
        return c
    g = -max(np.linalg.norm(r) / size, 1.0)
    out = a - 2 * g * r + g * g * v
    out = np.where(out > 0, out, c / 10)
    return out / max(out.sum(), TINY)


def _jumped(a: Model, b: Model, c: Model) -> Model:
    """Each distribution of three successive models extrapolated by itself."""

    def two(x, y, z):
        return float(_extrapolated(*(np.array([v, 1 - v]) for v in (x, y, z)))[0])

    return Model(
        a.tids, a.lengths, _extrapolated(a.p, b.p, c.p), _extrapolated(a.length, b.length, c.length), _extrapolated(a.start, b.start, c.start),
        two(a.forward, b.forward, c.forward), two(a.mismatch, b.mismatch, c.mismatch),
    )


def _settled(old: Model, new: Model) -> bool:
    big = new.p >= 1e-7
    return not (np.abs(new.p - old.p)[big] >= 1e-3 * new.p[big]).any()


def fit(targets: DataFrame, table: DataFrame, unmapped: float = 0.0, full: int = 10, most: int = 200) -> Model:
    """Up to ``full`` accelerated loops of the whole model, then loops of the target weights alone, until no weight of at least 1e-7 changes by 1e-3.

    A loop is two rounds, the extrapolation of the three models and a round from
    there. The model's ``converged`` tells whether the weights came to rest within ``most`` loops.
    """
    m = step(uniform(targets), table, unmapped)
    for k in range(full + most):
        only_p = k >= full
        one = step(m, table, unmapped, only_p)
        two = step(one, table, unmapped, only_p)
        if only_p:
            jump = Model(m.tids, m.lengths, _extrapolated(m.p, one.p, two.p), m.length, m.start, m.forward, m.mismatch)
        else:
            jump = _jumped(m, one, two)
        new = step(jump, table, unmapped, only_p)
        new.converged = _settled(m, new)
        m = new
        if m.converged:
            break
    return m


def result(spark, m: Model, n_reads: float) -> DataFrame:
    """``tid``, ``length``, ``eff_length``, ``read_count``, ``tpm`` and ``fpkm``; the share of noise is left out of the last two."""
    eff, p = m.effective_lengths(), m.p[1:]
    rate = np.divide(p, eff, out=np.zeros_like(p), where=eff > 0)
    whole = max(p.sum(), TINY)
    return spark.createDataFrame(
        pd.DataFrame({"tid": m.tids, "length": m.lengths, "eff_length": eff, "read_count": p * n_reads, "tpm": rate * 1e6 / max(rate.sum(), TINY), "fpkm": rate * 1e9 / whole}),
        "tid int, length int, eff_length double, read_count double, tpm double, fpkm double",
    )
