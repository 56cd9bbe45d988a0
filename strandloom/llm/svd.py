"""Truncated SVD of a tall sparse matrix by random projection, distributed by rows.

Only the feature side is ever held whole: features x rank numbers, a size that
doesn't depend on the number of rows. Each pass sends the current basis to the
tasks, which add up their part of A'(AQ); partial sums are added by blocks of
features before the driver orthogonalises them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 2048


class Sparse:
    """Some rows as numbers of features and weights, end to end; nothing is as wide as the vocabulary."""

    def __init__(self, batch):
        lists = batch.column(0)
        self.f = lists.flatten().to_numpy(zero_copy_only=False)
        self.v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        self.n = np.diff(lists.offsets.to_numpy())
        self.r = np.repeat(np.arange(len(self.n)), self.n)

    def times(self, q: np.ndarray) -> np.ndarray:
        """Rows times ``q``."""
        out = np.zeros((len(self.n), q.shape[1]), np.float32)
        if len(self.f):
            first = np.flatnonzero(np.r_[True, self.r[1:] != self.r[:-1]])
            out[self.r[first]] = np.add.reduceat(self.v[:, None] * q[self.f], first)
        return out

    def add_back(self, y: np.ndarray, total: np.ndarray) -> None:
        """Adds the transposed rows times ``y`` to ``total``."""
        if len(self.f):
            o = np.argsort(self.f, kind="stable")
            f = self.f[o]
            first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
            total[f[first]] += np.add.reduceat(self.v[o][:, None] * y[self.r[o]], first)


def _rows(batch):
    for part in range(0, batch.num_rows, 512):
        yield Sparse(pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column(k).slice(part, 512)]) for k in (0, 1)], names=["f", "w"]))


def _summed(rows: DataFrame, add, height: int, width: int) -> np.ndarray:
    """Sum over all tasks of the matrices to which ``add`` adds the part of some rows."""

    def partial(batches):
        total = None
        for batch in batches:
            for x in _rows(batch):
                total = np.zeros((height, width), np.float32) if total is None else total
                add(x, total)
        if total is not None:
            for k in range(0, height, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([total[k:k + BLOCK].astype(np.float32).tobytes()], pa.binary())], names=["k", "m"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(m, np.float32)
                sums[k] = sums[k] + x if k in sums else x.astype(np.float64)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([x.astype(np.float32).tobytes()], pa.binary())], names=["k", "m"])

    blocks = rows.mapInArrow(partial, "k long, m binary").repartition("k").mapInArrow(merge, "k long, m binary").collect()
    out = np.zeros((height, width), np.float32)
    for k, m in blocks:
        x = np.frombuffer(m, np.float32).reshape(-1, width)
        out[k:k + len(x)] = x
    return out


def right_vectors(rows: DataFrame, n_features: int, rank: int, oversample: int = 16, passes: int = 2, seed: int = 7) -> np.ndarray:
    """The first ``rank`` right singular vectors (features x rank) of sparse rows.

    ``rows`` has the columns ``features array<int>`` and ``weights array<float>``.
    """
    width = min(rank + oversample, n_features)
    q = np.random.default_rng(seed).standard_normal((n_features, width)).astype(np.float32)
    q, _ = np.linalg.qr(q)
    for _ in range(passes + 1):
        def power(x, total, q=q):
            x.add_back(x.times(q), total)

        q, _ = np.linalg.qr(_summed(rows.select("features", "weights"), power, n_features, width))

    def gram(x, total):
        y = x.times(q)
        total += y.T @ y

    values, vectors = np.linalg.eigh(_summed(rows.select("features", "weights"), gram, width, width).astype(np.float64))
    order = np.argsort(-values)
    kept = order[: min(rank, int((values > 1e-9).sum()))]
    return (q @ vectors[:, kept].astype(np.float32)).astype(np.float32)
