"""Consecutive numbers within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.runtime import materialize


def number_rows(df: DataFrame, group: list[str], order: list[str], to: str = "ordinal") -> DataFrame:
    """Adds ``to``: 1, 2, ... within each ``group`` in ``order``.

    Rows are cut into ranges of group and order, which split a large group over
    many tasks; each range counts its rows, the counts (one per range and group)
    add up to where each range begins, and rows are numbered within ranges.
    Rows that agree in group and order get numbers in no given order. Nulls come
    first, as in Spark's ascending order. An empty table gives an empty result.
    """
    keys = [*group, *order]
    placed = materialize(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = placed.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    # without a group: a row per range
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*group, "__range").orderBy(*order)
    same = F.col("__range") == F.col("__r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    numbered = placed.withColumn("__k", F.row_number().over(within)).join(begins, same)
    return numbered.withColumn(to, F.col("__base") + F.col("__k")).select(*df.columns, to)
