"""Most frequent values of a column, within memory that doesn't grow with it.

Values travel as 64-bit hashes. Their stream is partitioned by hash, so that
all occurrences of a value meet in one task, which holds a count-min sketch
with conservative update and a bounded heap of heavy candidates. The heaps of
the tasks hold disjoint values; their union is the result. A last pass over
the column fetches the values behind the few hashes and counts them exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.runtime import materialize

WIDTH_BITS, DEPTH = 17, 4
BROADCAST = 1_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Sketch:
    """Count-min sketch; conservative update keeps every cell as low as it may be."""

    def __init__(self, width_bits: int = WIDTH_BITS, depth: int = DEPTH):
        self.shift = np.uint64(64 - width_bits)
        self.cells = np.zeros((depth, 1 << width_bits), np.int64)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        k = keys.view(np.uint64)
        return np.stack([((k ^ (k >> np.uint64(29))) * m) >> self.shift for m in _ODD[: len(self.cells)]]).astype(np.int64)

    def estimate(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys)
        return np.min([row[i] for row, i in zip(self.cells, at)], axis=0)

    def add(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Adds distinct keys; returns their new estimates, never below the truth."""
        at = self._at(keys)
        new = np.min([row[i] for row, i in zip(self.cells, at)], axis=0) + weights
        for row, i in zip(self.cells, at):
            np.maximum.at(row, i, new)
        return new


class Candidates:
    """The keys of largest estimate, at most ``size`` of them."""

    def __init__(self, size: int):
        self.size, self.floor = size, 0
        self.keys, self.estimates = np.empty(0, np.int64), np.empty(0, np.int64)

    def offer(self, keys: np.ndarray, estimates: np.ndarray) -> None:
        big = estimates > self.floor
        if not big.any():
            return
        keys, estimates = np.concatenate([self.keys, keys[big]]), np.concatenate([self.estimates, estimates[big]])
        order = np.lexsort((-estimates, keys))
        keys, estimates = keys[order], estimates[order]
        first = np.r_[True, keys[1:] != keys[:-1]]
        keys, estimates = keys[first], estimates[first]
        if len(keys) > self.size:
            cut = np.argpartition(-estimates, self.size)
            self.floor = max(self.floor, int(estimates[cut[self.size]]))
            keys, estimates = keys[cut[: self.size]], estimates[cut[: self.size]]
        self.keys, self.estimates = keys, estimates


def _totals(keys: np.ndarray, weights: np.ndarray | None):
    unique, where = np.unique(keys, return_inverse=True)
    return unique, np.bincount(where, weights, len(unique)).astype(np.int64)


def _combine(batches):
    """Totals within each batch: a value that fills a batch leaves one row."""
    for b in batches:
        keys, n = _totals(b.column(0).to_numpy(zero_copy_only=False), None)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["h", "n"])


def _heaps(stream: DataFrame, heap: int) -> DataFrame:
    """The written heaps of all tasks: ``h``, ``estimate`` and ``floor``, below which a task may have dropped values."""

    def run(batches):
        sketch, top, total = Sketch(), Candidates(heap), 0
        for b in batches:
            keys, n = _totals(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False))
            total += int(n.sum())
            top.offer(keys, sketch.add(keys, n))
        if total:
            # the row total travels as a candidate without a hash
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None, *top.keys.tolist()], pa.int64()),
                    pa.array([total, *sketch.estimate(top.keys).tolist()], pa.int64()),
                    pa.array([top.floor] * (1 + len(top.keys)), pa.int64()),
                ],
                names=["h", "estimate", "floor"],
            )

    return materialize(stream.mapInArrow(run, "h long, estimate long, floor long"), "heaps")


def frequent_hashes(hashes: DataFrame, share: float, at_least: int, heap: int = 0) -> tuple[DataFrame, int]:
    """Hashes of the column ``h`` that may reach the share, and the number of rows.

    The first result has ``h`` and ``estimate``. If a task had to drop a value
    that may reach the threshold, all tasks run again with heaps four times as
    large, so nothing is lost; heaps of a few times 1 / share seldom need it.
    """
    heap = heap or max(1024, 4 * math.ceil(1 / share))
    stream = hashes.select("h").mapInArrow(_combine, "h long, n long").repartition("h")
    while True:
        heaps = _heaps(stream, heap)
        seen = heaps.agg(F.sum(F.when(F.col("h").isNull(), F.col("estimate"))).alias("total"), F.max("floor").alias("floor")).first()
        total = seen.total or 0
        threshold = max(at_least, share * total)
        if (seen.floor or 0) < threshold:
            return heaps.filter(F.col("h").isNotNull() & (F.col("estimate") >= threshold)).select("h", "estimate"), total
        heap *= 4


def frequent_values(df: DataFrame, value: str, row_id: str, share: float, at_least: int = 1, heap: int = 0) -> DataFrame:
    """Values that at least ``share`` of the distinct rows and ``at_least`` of them carry.

    Columns: ``value``, ``n_estimate`` (of the sketch, never too low) and
    ``n_rows`` (exact). Rows that agree in ``row_id`` and value count once.
    Null values count nowhere; null ids count as one id. The empty string is a
    value like any other. Ties at the threshold are all kept. Other columns
    aren't read. An empty table gives an empty result. Memory per task is the
    sketch and the heap, whatever the number of distinct values.
    """
    rows = df.select(F.col(row_id).alias("__id"), F.col(value).alias("__v")).filter(F.col("__v").isNotNull())
    hashed = rows.select("__id", F.xxhash64("__v").alias("h")).distinct()
    heavy, total = frequent_hashes(hashed, share, at_least, heap)
    threshold = max(at_least, share * total)
    # about 1 / share hashes: estimates of a value above the threshold are its count and the sketch's error
    few = heavy.count() <= BROADCAST
    again = rows.withColumn("h", F.xxhash64("__v")).join(F.broadcast(heavy) if few else heavy, "h")
    once = again.groupBy("__id", "__v").agg(F.max("estimate").alias("e"))
    counted = once.groupBy("__v").agg(F.max("e").alias("n_estimate"), F.count(F.lit(1)).alias("n_rows"))
    return counted.filter(F.col("n_rows") >= threshold).select(F.col("__v").alias("value"), "n_estimate", "n_rows")
