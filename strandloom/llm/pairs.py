"""Items that appear together: pair weights, lift and pointwise mutual information.

Items are deduplicated within each basket, ordered pairs are emitted row by row
and combined on the map side, and the chance level comes from the marginals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.runtime import materialize

BLOCK = 64
#: Rows of a side that goes to all tasks.
BROADCAST = 1_000_000


def baskets(df: DataFrame, basket: str, items: str, weight: str) -> DataFrame:
    """Sound baskets, once each: ``id``, sorted distinct ``items`` and ``n``.

    Left out are baskets with null or empty items and with a null, zero or
    negative weight; null items within a basket are dropped. Of several rows of
    one basket the one with the largest weight stands.
    """
    rows = df.select(F.col(basket).alias("id"), F.col(items).alias("raw"), F.col(weight).cast("long").alias("n")).filter(
        (F.size("raw") > 0) & (F.col("n") > 0)
    )
    rows = rows.select("id", F.array_sort(F.array_distinct(F.array_compact("raw"))).alias("items"), "n").filter(F.size("items") > 0)
    return rows.groupBy("id").agg(F.max_by("items", F.struct("n", "items")).alias("items"), F.max("n").alias("n"))


def marginals(sets: DataFrame) -> DataFrame:
    """Weight ``w`` and number of baskets ``k`` of each item."""
    return sets.select(F.explode("items").alias("item"), "n").groupBy("item").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("k"))


def emit_pairs(sets: DataFrame) -> DataFrame:
    """Rows ``a``, ``b``, ``n`` with a < b for each pair of each basket.

    Baskets are cut into blocks of items and each pair of blocks is a row of its
    own before it expands, so that no basket, however large, has to expand in
    one piece; large baskets are spread over all tasks first.
    """
    blocks = F.ceil(F.size("items") / F.lit(BLOCK)).cast("int")
    small = sets.filter(F.size("items") <= BLOCK).select("n", F.col("items").alias("x"), F.col("items").alias("y"))
    large = sets.filter(F.size("items") > BLOCK).select("n", "items", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"), blocks.alias("m"))
    large = large.select("n", "items", "i", F.explode(F.sequence("i", F.col("m") - 1)).alias("j"))
    cut = [F.slice("items", F.col(c) * BLOCK + 1, F.lit(BLOCK)).alias(to) for c, to in (("i", "x"), ("j", "y"))]
    large = large.select("n", *cut).repartition(F.xxhash64("x", "y"))
    both = small.unionByName(large)
    first = both.select("n", F.explode("x").alias("a"), "y")
    second = first.select("n", "a", F.explode(F.filter("y", lambda v: v > F.col("a"))).alias("b"))
    return second.select("a", "b", "n")


def joint_weights(sets: DataFrame) -> DataFrame:
    """Weight ``w_ab`` and number of baskets ``k_ab`` of each pair that occurs."""
    return emit_pairs(sets).groupBy("a", "b").agg(F.sum("n").alias("w_ab"), F.count(F.lit(1)).alias("k_ab"))


def _sent(items: DataFrame) -> DataFrame:
    """Sent to all tasks if its counted rows allow it, else joined by key."""
    return F.broadcast(items) if items.count() <= BROADCAST else items


def lift_table(sets: DataFrame, keep: DataFrame | None = None, single: DataFrame | None = None) -> DataFrame:
    """Every pair with its joint weight, lift and pointwise mutual information.

    Columns ``a``, ``b``, ``w_ab``, ``k_ab``, ``w_a``, ``w_b``, ``lift`` (joint
    weight over the weight expected by chance) and ``pmi`` (its logarithm to
    base 2). ``keep``: items (column ``item``) to which the pairs are limited;
    the marginals are those of all baskets all the same (``single``, if they are
    at hand). Items go to all tasks where there are few; otherwise hot ones are
    joined by key, which adaptive execution splits. An empty input gives an
    empty result.
    """
    whole = sets.agg(F.sum("n")).first()[0] or 0
    single = materialize(marginals(sets), "marginals") if single is None else single
    inner = sets
    if keep is not None:
        rows = sets.select("id", "n", F.explode("items").alias("item")).join(_sent(keep.select("item")), "item", "left_semi")
        inner = rows.groupBy("id", "n").agg(F.array_sort(F.collect_list("item")).alias("items"))
        single = single.join(keep.select("item"), "item", "left_semi")
    single = _sent(single)
    pairs = joint_weights(inner)
    a = single.select(F.col("item").alias("a"), F.col("w").alias("w_a"))
    b = single.select(F.col("item").alias("b"), F.col("w").alias("w_b"))
    lift = F.col("w_ab") * F.lit(float(whole)) / (F.col("w_a").cast("double") * F.col("w_b"))
    return pairs.join(a, "a").join(b, "b").withColumn("lift", lift).withColumn("pmi", F.log2("lift"))


def associated(sets: DataFrame, min_share: float, min_lift: float, min_baskets: int) -> DataFrame:
    """Pairs with at least this share of all weight, this lift and so many baskets.

    A pair weighs no more than either item, so only items with the least share
    themselves can be in one; and as its lift is at most N over the larger
    marginal, items above N / min_lift can't be either. Both cuts are exact and
    take the hot items away before any pair is emitted.
    """
    n = float(sets.agg(F.sum("n")).first()[0] or 0)
    single = materialize(marginals(sets), "marginals")
    # weights of items add up to at most n x the largest basket, so no more than 1 / min_share of them for each of its items
    items = materialize(single.filter((F.col("w") >= min_share * n) & (F.col("w") * min_lift <= n) & (F.col("k") >= min_baskets)), "items")
    table = lift_table(sets, items, single)
    return table.filter((F.col("w_ab") >= min_share * n) & (F.col("lift") >= min_lift) & (F.col("k_ab") >= min_baskets))
