"""Rates, lengths and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effective_length(length: Column, mean: Column) -> Column:
    """Start places of a fragment of mean length: 0 on targets shorter than it."""
    return F.when(length < mean, 0.0).otherwise(length - mean + 1)


def with_share(df: DataFrame, value: str, to: str, scale: float = 1.0) -> DataFrame:
    """Adds ``to``: ``value`` over its sum over all rows, times ``scale`` (0 if the sum is 0)."""
    whole = df.agg(F.sum(value).alias("__whole"))
    share = F.when(F.col("__whole") != 0, F.col(value) * F.lit(scale) / F.col("__whole")).otherwise(0.0)
    return df.join(F.broadcast(whole)).withColumn(to, share).drop("__whole")


def tpm(df: DataFrame, rate: str = "rate", to: str = "tpm") -> DataFrame:
    return with_share(df, rate, to, 1e6)


def fpkm(df: DataFrame, share: str, effective: str, to: str = "fpkm") -> DataFrame:
    """1e9 x share of the fragments over the effective length; 0 where that is about 0."""
    out = with_share(df, share, "__p")
    return out.withColumn(to, F.when(F.col(effective) > 1e-9, F.col("__p") * 1e9 / F.col(effective)).otherwise(0.0)).drop("__p")


def histogram(df: DataFrame, value: str) -> DataFrame:
    """``value``, its count ``n``, share ``pdf`` and running share ``cdf``; nulls don't count.

    The window runs over the distinct values, which are bounded by the range of
    lengths, not by the number of rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    order = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(whole)
    return counts.select(value, "n", (F.col("n") / total).alias("pdf"), (F.sum("n").over(order) / total).alias("cdf"))


def model_effective_length(targets: DataFrame, length: str, pdf: DataFrame, value: str, to: str = "eff_length") -> DataFrame:
    """Expected number of start places over the fragment lengths that fit; below 1 it counts as 0.

    ``pdf`` has one row for each length (at most some thousands), so its sums up
    to each length go to every task; lengths beyond the longest use its last row.
    """
    order = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    sums = pdf.select(F.col(value).alias("__v"), F.sum("pdf").over(order).alias("__c"), F.sum(F.col(value) * F.col("pdf")).over(order).alias("__m"), F.lead(value).over(Window.orderBy(value)).alias("__next"))
    fits = (F.col(length) >= F.col("__v")) & (F.col("__next").isNull() | (F.col(length) < F.col("__next")))
    expected = F.col("__c") * (F.col(length) + 1) - F.col("__m")
    joined = targets.join(F.broadcast(sums), fits, "left")
    return joined.withColumn(to, F.when(expected >= 1, expected).otherwise(0.0)).drop("__v", "__c", "__m", "__next")


def mean_and_sd(df: DataFrame, value: str, weight: Column) -> DataFrame:
    """One row: weighted ``mean`` and population ``sd``."""
    s = df.agg(F.sum(weight).alias("w"), F.sum(weight * F.col(value)).alias("wx"), F.sum(weight * F.col(value) * F.col(value)).alias("wxx"))
    mean = F.col("wx") / F.col("w")
    return s.select(mean.alias("mean"), F.sqrt(F.greatest(F.col("wxx") / F.col("w") - mean * mean, F.lit(0.0))).alias("sd"))


def relative_change(df: DataFrame, old: str, new: str) -> DataFrame:
    """One row: largest relative change, and how many changed by more than 1e-3 and 1e-7."""
    rel = F.abs(F.col(new) - F.col(old)) / F.col(new)
    rel = F.when(F.col(new) > 0, rel).otherwise(0.0)
    return df.agg(F.max(rel).alias("max_change"), F.count_if(rel > 1e-3).alias("n_above_1e3"), F.count_if(rel > 1e-7).alias("n_above_1e7"))
