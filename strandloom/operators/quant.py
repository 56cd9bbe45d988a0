"""Equivalence classes and abundance by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import stats
from strandloom.runtime import materialize

MAX_CLASS_ERROR = 7
MIN_ROUNDS, MAX_ROUNDS = 50, 1000
#: Rows of a side that goes to all tasks.
BROADCAST = 2_000_000
COLLECT_LIMIT = 1_000_000


def classes(hits: DataFrame, read: str, tid: str = "tid", err: str | None = None) -> DataFrame:
    """Reads by their set of targets: ``refs`` (sorted, distinct) and ``n``.

    With ``err``, reads on several targets count only below 7 errors. Targets of
    a read are few, so the set is built in one aggregate before the counting.
    """
    sets = hits.groupBy(read).agg(F.array_sort(F.collect_set(tid)).alias("refs"), (F.min(err) if err else F.lit(0)).alias("e"))
    return sets.filter((F.size("refs") > 0) & ((F.size("refs") == 1) | (F.col("e") < MAX_CLASS_ERROR))).groupBy("refs").agg(F.count(F.lit(1)).alias("n"))


def unique_counts(cls: DataFrame) -> DataFrame:
    """Reads that hit one target only, by target."""
    return cls.filter(F.size("refs") == 1).select(F.element_at("refs", 1).alias("tid"), "n").groupBy("tid").agg(F.sum("n").alias("unique_map"))


class Problem:
    """Classes over targets 0 ... n - 1, as arrays: one entry for each member of each class."""

    def __init__(self, lengths: np.ndarray, refs: Sequence[np.ndarray], counts: np.ndarray):
        self.lengths = np.asarray(lengths, float)
        self.counts = np.asarray(counts, float)
        self.sizes = np.array([len(r) for r in refs], np.int64)
        self.member = np.concatenate(list(refs)).astype(np.int64) if len(refs) else np.empty(0, np.int64)
        self.of = np.repeat(np.arange(len(refs)), self.sizes)

    def step(self, rate: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """One round: each class shared out by rate; new rate = count / length. Classes without any rate are left out."""
        counts = self.counts if counts is None else counts
        w = rate[self.member]
        total = np.bincount(self.of, w, len(counts))
        per = np.divide(counts, total, out=np.zeros(len(counts)), where=total > 0)
        got = np.bincount(self.member, w * per[self.of], len(rate))
        return np.divide(got, self.lengths, out=np.zeros(len(rate)), where=self.lengths > 0)


def _going(old: np.ndarray, new: np.ndarray) -> bool:
    big = new > 1e-3
    return bool((np.abs(new - old)[big] > 0.01 * new[big]).any())


def squarem(problem: Problem, counts: np.ndarray | None = None, least: int = MIN_ROUNDS, most: int = MAX_ROUNDS) -> np.ndarray:
    """Accelerated rounds until no rate above 1e-3 changes by more than 1 %.

    The step length is the ratio of the sample standard deviations of the first
    and second differences, at least 1 in size; rates that would fall to 0 or
    below keep the plain round's, so that no class loses all its members, and a
    plain round follows. Where the differences don't vary the plain round stands.
    """
    n = len(problem.lengths)
    rate = np.full(n, 1.0 / max(n, 1))
    for k in range(most):
        one = problem.step(rate, counts)
        two = problem.step(one, counts)
        r = one - rate
        v = (two - one) - r
        spread = v.std(ddof=1) if n > 1 else 0.0
        if spread > 0:
            a = min(-(r.std(ddof=1) / spread), -1.0)
            jump = rate - 2 * a * r + a * a * v
            two = np.where(jump > 0, jump, two)
        new = problem.step(two, counts)
        done = k + 1 >= least and not _going(rate, new)
        rate = new
        if done:
            break
    return rate


def _problem(targets: DataFrame, cls: DataFrame) -> tuple[np.ndarray, Problem]:
    t = targets.select("tid", F.col("len").cast("double").alias("len")).orderBy("tid").toPandas()
    c = cls.select("refs", "n").toPandas()
    tids = t["tid"].to_numpy()
    refs = [np.searchsorted(tids, np.asarray(r)) for r in c["refs"]]
    return tids, Problem(t["len"].to_numpy(), refs, c["n"].to_numpy())


def abundance(targets: DataFrame, cls: DataFrame, mean_length: float, limit: int = COLLECT_LIMIT) -> DataFrame:
    """``tid``, ``unique_map``, ``length``, ``eff_length``, ``est_counts`` and ``tpm`` of all targets.

    Classes are few next to reads; up to ``limit`` of them the rounds run on
    arrays of the driver, beyond it as DataFrame rounds; steps, stop test and
    bounds are the same.
    """
    spark = targets.sparkSession
    if cls.limit(limit + 1).count() <= limit:
        tids, problem = _problem(targets, cls)
        rate = squarem(problem)
        rates = spark.createDataFrame(pd.DataFrame({"tid": tids, "rate": rate}), "tid int, rate double")
    else:
        rates = squarem_rounds(targets, cls)
    out = targets.select("tid", F.col("len").alias("length")).join(rates, "tid", "left").join(unique_counts(cls), "tid", "left")
    out = out.withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    out = stats.tpm(out.withColumn("est_counts", F.col("rate") * F.col("length")))
    eff = stats.effective_length(F.col("length"), F.lit(float(mean_length)))
    return out.select("tid", F.coalesce("unique_map", F.lit(0)).cast("long").alias("unique_map"), "length", eff.alias("eff_length"), "est_counts", "tpm")


def round_of(targets: DataFrame, cls: DataFrame, rates: DataFrame, small: bool = False) -> DataFrame:
    """One round as a DataFrame: ``tid`` and ``rate``.

    Members meet their rate on tid, then their class's total on the class; both
    aggregates combine on the map side, so a target that is in a third of all
    classes costs one row per task. ``small``: rates, a row per target, were
    counted and may go to all tasks, which spares hot targets a join by key.
    """
    members = cls.select(F.col("refs").alias("c"), "n", F.explode("refs").alias("tid")).join(F.broadcast(rates) if small else rates, "tid")
    total = members.groupBy("c").agg(F.sum("rate").alias("total"))
    shares = members.join(total, "c").filter("total > 0").groupBy("tid").agg(F.sum(F.col("n") * F.col("rate") / F.col("total")).alias("got"))
    return targets.select("tid", "len").join(shares, "tid", "left").select("tid", (F.coalesce("got", F.lit(0.0)) / F.col("len")).alias("rate"))


def start_rates(targets: DataFrame) -> DataFrame:
    n = targets.count()
    return targets.select("tid", F.lit(1.0 / max(n, 1)).alias("rate"))


def rounds(targets: DataFrame, cls: DataFrame, n: int, every: int = 3) -> DataFrame:
    """``n`` plain rounds as DataFrames; every few rounds the rates are written and their lineage cut."""
    rates, small = start_rates(targets), targets.count() <= BROADCAST
    for k in range(n):
        rates = round_of(targets, cls, rates, small)
        if (k + 1) % every == 0 and k + 1 < n:
            rates = materialize(rates, "rates")
    return rates


def _jumped(rates: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """The accelerated rates of three successive ones; see ``squarem``. The step length is computed beside them from one row of sums."""
    all3 = rates.withColumnRenamed("rate", "x").join(one.withColumnRenamed("rate", "x1"), "tid").join(two.withColumnRenamed("rate", "x2"), "tid")
    d = all3.withColumn("r", F.col("x1") - F.col("x")).withColumn("v", (F.col("x2") - F.col("x1")) - F.col("r"))
    d = materialize(d, "rates")
    sd = d.agg(F.stddev_samp("r").alias("r"), F.stddev_samp("v").alias("v")).first()
    if sd.v is None or not sd.v > 0:
        return d.select("tid", F.col("x2").alias("rate"))
    a = min(-(sd.r / sd.v), -1.0)
    jump = F.col("x") - F.lit(2 * a) * F.col("r") + F.lit(a * a) * F.col("v")
    return d.select("tid", F.when(jump > 0, jump).otherwise(F.col("x2")).alias("rate"))


def squarem_rounds(targets: DataFrame, cls: DataFrame, least: int = MIN_ROUNDS, most: int = MAX_ROUNDS) -> DataFrame:
    """``squarem`` as DataFrame rounds; only the two standard deviations and the outcome of the stop test go to the driver."""
    targets, cls = materialize(targets.select("tid", "len"), "targets"), materialize(cls.select("refs", "n"), "classes")
    rates, small = materialize(start_rates(targets), "rates"), targets.count() <= BROADCAST
    for k in range(most):
        one = materialize(round_of(targets, cls, rates, small), "rates")
        new = materialize(round_of(targets, cls, _jumped(rates, one, round_of(targets, cls, one, small)), small), "rates")
        done = False
        if k + 1 >= least:
            both = rates.withColumnRenamed("rate", "old").join(new, "tid")
            done = both.filter((F.col("rate") > 1e-3) & (F.abs(F.col("rate") - F.col("old")) > 0.01 * F.col("rate"))).limit(1).count() == 0
        rates = new
        if done:
            break
    return rates


def bootstrap(targets: DataFrame, cls: DataFrame, replicates: int, seed: int = 0, limit: int = COLLECT_LIMIT) -> DataFrame:
    """``bs``, ``tid`` and ``est_counts`` of each replicate.

    All classes, unique ones included, are drawn anew from one multinomial per
    replicate; each replicate has a generator of its own, so a task that runs
    again gives the same numbers. Up to ``limit`` classes replicates run side by
    side on arrays; beyond it they are drawn in parts of the classes and run as
    DataFrame rounds with the same steps and stop test.
    """
    cls = materialize(cls.select("refs", "n"), "classes")
    if cls.count() > limit:
        return _large_bootstrap(targets, cls, replicates, seed, limit)
    spark = targets.sparkSession
    tids, problem = _problem(targets, cls)
    shared = spark.sparkContext.broadcast((tids, problem))

    def run(frames):
        tids, problem = shared.value
        total = problem.counts.sum()
        for frame in frames:
            for bs in frame["id"]:
                rng = np.random.default_rng([seed, int(bs)])
                drawn = rng.multinomial(int(total), problem.counts / total).astype(float) if total else problem.counts
                rate = squarem(problem, drawn)
                yield pd.DataFrame({"bs": np.full(len(tids), bs + 1), "tid": tids, "est_counts": rate * problem.lengths})

    ids = spark.range(replicates, numPartitions=max(1, min(replicates, spark.sparkContext.defaultParallelism)))
    return ids.mapInPandas(run, "bs int, tid int, est_counts double")


def redrawn(cls: DataFrame, bs: int, seed: int, part: int) -> DataFrame:
    """The classes with counts of one multinomial over all of them, drawn in parts of about ``part`` classes.

    The total goes to the parts by their sums first, then to the classes of each
    part in order; both draws have seeds of their own.
    """
    parts = max(1, -(-cls.count() // part))
    split = cls.withColumn("part", F.pmod(F.xxhash64("refs"), F.lit(parts)).cast("int"))
    sums = {r.part: int(r.n) for r in split.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row per part
    whole = sum(sums.values())
    shares = np.random.default_rng([seed, bs]).multinomial(whole, [sums.get(k, 0) / whole for k in range(parts)]).tolist() if whole else [0] * parts

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        k = int(frame["part"].iloc[0])
        frame = frame.assign(key=[tuple(r) for r in frame["refs"]]).sort_values("key")
        n = frame["n"].to_numpy(float)
        drawn = np.random.default_rng([seed, bs, k]).multinomial(shares[k], n / n.sum())
        return pd.DataFrame({"refs": frame["refs"], "n": drawn})

    return split.groupBy("part").applyInPandas(draw, "refs array<int>, n long").filter("n > 0")


def _large_bootstrap(targets: DataFrame, cls: DataFrame, replicates: int, seed: int, part: int) -> DataFrame:
    out = None
    for bs in range(replicates):
        rates = squarem_rounds(targets, redrawn(cls, bs, seed, part))
        one = rates.join(targets.select("tid", "len"), "tid").select(F.lit(bs + 1).alias("bs"), "tid", (F.col("rate") * F.col("len")).alias("est_counts"))
        out = one if out is None else out.unionByName(one)
    return out


def gene_rollup(ab: DataFrame, genes: DataFrame, gene: str = "gene_id", values: Sequence[str] = ("est_counts", "tpm")) -> DataFrame:
    """Sums by gene with the gene's name; targets without a gene fall out."""
    return ab.groupBy(gene).agg(*[F.sum(v).alias(v) for v in values]).join(genes, gene)


def two_levels(ab: DataFrame, gene: str, tid: str, value: str) -> DataFrame:
    """Sums by target, by gene and over all: a rollup; nulls in the keys mark the levels."""
    return ab.rollup(gene, tid).agg(F.sum(value).alias(value), F.grouping_id().cast("int").alias("level"))
