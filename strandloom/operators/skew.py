"""Per-key totals that stay balanced when a few keys hold most rows.

Stage one groups by key and salt, where only keys with more rows than a part of
a task's get more than one salt; stage two merges the partial results by key. The salt
is a hash of the columns that identify a row rather than a random number: a
task that runs again puts each row where it was before, and re-delivered copies
of a row meet in one group and count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.runtime import materialize


#: Rows of one key and salt are at most this part of the mean rows of a task.
PART = 0.25


def heavy_keys(df: DataFrame, key: str, share: float | None = None, total: int | None = None) -> DataFrame:
    """Keys with more rows than one salt should have, and the salts each should get.

    A salt should hold a quarter of a task's mean rows, so the bound follows the
    number of shuffle partitions; ``share`` of all rows sets it by hand. Rows are
    counted in one pass, combined on the map side; the total is the sum of the
    counts, where it isn't known. No more keys come out than all tasks have slots: 4 x partitions, or
    1 / ``share``, whatever the size of the input.
    """
    if share is not None and not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    counts = df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    if total is None:
        counts = materialize(counts, "counts")
        total = counts.agg(F.sum("__n")).first()[0] or 0
    part = share or PART / int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = max(1.0, total * part)
    return counts.filter(F.col("__n") >= slot).select("__key", F.ceil(F.col("__n") / slot).cast("int").alias("__salts"))


def salted(df: DataFrame, key: str, row_id: Sequence[str], share: float | None = None) -> DataFrame:
    """``df`` with a column ``__salt``, partitioned by key and salt."""
    heavy = heavy_keys(df, key, share)
    spread = df.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("__key")), "left")
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in row_id]), F.coalesce(F.col("__salts"), F.lit(1)))
    return spread.withColumn("__salt", salt.cast("int")).drop("__key", "__salts").repartition(key, "__salt")


def balanced_join(rows: DataFrame, other: DataFrame, key: str, row_id: Sequence[str], share: float | None = None) -> DataFrame:
    """Inner join on ``key`` in which no task gets more than its part of ``rows`` for one key.

    ``rows`` is read twice and should be a written table. Keys without too many rows join as
    they are (a bucketed ``other`` isn't shuffled); of the heavy ones rows are
    salted and the few rows of ``other`` that have such a key repeated for each
    salt. Null keys join nothing.
    """
    heavy = materialize(heavy_keys(rows.filter(F.col(key).isNotNull()), key, share, max(1, rows.count())).filter("__salts > 1"), "heavy")
    if heavy.limit(1).count() == 0:
        return rows.join(other, key)
    heavy = F.broadcast(heavy.withColumnRenamed("__key", key))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in row_id]), F.col("__salts")).cast("int").alias("__salt")
    one = rows.join(heavy, key).select(*rows.columns, salt)
    two = other.join(heavy, key).select(*other.columns, F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)).alias("__salt"))
    hot = one.join(two, [key, "__salt"]).drop("__salt")
    return rows.join(heavy, key, "left_anti").join(other, key).unionByName(hot)


def two_stage_totals(df: DataFrame, key: str, row_id: Sequence[str], sums: Sequence[str] = (), share: float | None = None) -> DataFrame:
    """Distinct rows and sums per key: columns ``key``, ``n_rows`` and ``sum_<c>``.

    * Rows that agree in ``row_id`` (nulls being alike) count once within a key;
      of their values the largest that is not null or NaN is taken.
    * A null key is a group of its own. Null and NaN values add nothing; a key
      with no other values has the sum 0.
    * Only the named columns are read, so other columns can't clash.
    * An empty table gives an empty result. Ties need no order.
    """
    own = [F.col(key).alias("__k0")] + [F.col(c).alias(f"__r{i}") for i, c in enumerate(row_id)]
    own += [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"__v{i}") for i, c in enumerate(sums)]
    ids = [f"__r{i}" for i in range(len(row_id))]
    part = salted(df.select(*own), "__k0", ids, share)
    values = [f"__v{i}" for i in range(len(sums))]
    if values:
        once = part.groupBy("__k0", "__salt", *ids).agg(*[F.max(v).alias(v) for v in values])
    else:
        once = part.select("__k0", "__salt", *ids).distinct()
    partial = once.groupBy("__k0", "__salt").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(v).alias(v) for v in values])
    final = partial.groupBy("__k0").agg(F.sum("__n").alias("__n"), *[F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in values])
    return final.select(F.col("__k0").alias(key), F.col("__n").alias("n_rows"), *[F.col(f"__v{i}").alias(f"sum_{c}") for i, c in enumerate(sums)])


def keys_above(totals: DataFrame, key: str, share: float) -> DataFrame:
    """The keys of ``two_stage_totals`` with at least ``share`` of all its rows; the totals, a row per key, are written once."""
    written = materialize(totals.select(key, "n_rows"), "totals")
    whole = written.agg(F.sum("n_rows")).first()[0] or 0
    return written.filter(F.col("n_rows") >= F.lit(share) * F.lit(whole)).select(key)
