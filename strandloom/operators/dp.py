"""Alignment kernels, vectorised over batches of pairs and used as Arrow UDFs.

Rows of the dynamic programme run one after the other; within a row all pairs
of the batch and all reference places are one numpy operation. The dependence
along a row is a running minimum (or maximum) of the row less its gap cost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATION = T.StructType([T.StructField("op", T.StringType()), T.StructField("len", T.IntegerType()), T.StructField("ref", T.StringType())])
RESULT = T.StructType([T.StructField(c, T.IntegerType()) for c in ("err", "start", "score")] + [T.StructField("cigar", T.ArrayType(OPERATION))])


def _grid(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), max(1, n.max(initial=1))), np.uint8)
    for row, t in zip(out, texts):
        row[: len(t)] = np.frombuffer(t.encode("latin-1", "replace"), np.uint8)
    return out, n


def _runs(ops: list[tuple[str, str]]):
    """Operations base by base, joined to (op, len, ref)."""
    out: list[list] = []
    for op, base in ops:
        ref = base if op in "XD" else ""
        if out and out[-1][0] == op:
            out[-1][1] += 1
            out[-1][2] += ref
        else:
            out.append([op, 1, ref])
    return [{"op": o, "len": n, "ref": r} for o, n, r in out]


def _clip(ops: list[tuple[str, str]], least: int):
    """Soft-clips ends in which more than one base in three is an edit, if they have at least ``least`` bases."""

    def bad_prefix(seq):
        best, at, score = 0, 0, 0
        for i, (op, _) in enumerate(seq):
            score += 2 if op != "=" else -1
            if score > best:
                best, at = score, i + 1
        return at if sum(op != "D" for op, _ in seq[:at]) >= least else 0

    a = bad_prefix(ops)
    b = len(ops) - bad_prefix(ops[a:][::-1])
    head, tail = ops[:a], ops[b:]
    clipped = [("S", "") for op, _ in head if op != "D"] + ops[a:b] + [("S", "") for op, _ in tail if op != "D"]
    return clipped, sum(op != "I" for op, _ in head)


def _at_most_one_edit(read: str, window: str):
    """The alignment if the read stands in the window with no or one wrong base, which nothing beats; else None."""
    m = len(read)
    at = window.find(read)
    if at >= 0:
        return {"err": 0, "start": at, "score": m, "cigar": [{"op": "=", "len": m, "ref": ""}]}
    room = len(window) - m + 1
    if m < 2 or room <= 0 or not (read.isascii() and window.isascii()):
        return None
    t = np.lib.stride_tricks.sliding_window_view(np.frombuffer(window.encode(), np.uint8), m)
    wrong = t != np.frombuffer(read.encode(), np.uint8)
    n = wrong.sum(axis=1)
    at = int(np.argmin(n))
    if n[at] != 1:
        return None
    x = int(np.argmax(wrong[at]))
    parts = [("=", x, ""), ("X", 1, window[at + x]), ("=", m - x - 1, "")]
    return {"err": 1, "start": at, "score": m - 1, "cigar": [{"op": o, "len": k, "ref": r} for o, k, r in parts if k]}


def global_in_window(reads: list[str], windows: list[str], clip: int = 5):
    """Aligns each whole read somewhere in its window with the fewest edits; ends that don't fit are soft-clipped.

    Returns for each pair (errors and clipped bases, start in the window, matches, operations), or None for an empty read.
    """
    out: list = [None] * len(reads)
    keep = [i for i, r in enumerate(reads) if r and windows[i] is not None]
    for i in keep:
        out[i] = _at_most_one_edit(reads[i].upper(), windows[i].upper())
    keep = [i for i in keep if out[i] is None]
    for k in range(0, len(keep), 64):
        part = keep[k:k + 64]
        q, n = _grid([reads[i].upper() for i in part])
        t, w = _grid([windows[i].upper() for i in part])
        m, cols = q.shape[1], t.shape[1] + 1
        j = np.arange(cols, dtype=np.int32)
        beyond = j[None, :] > w[:, None]
        table = np.zeros((m + 1, len(part), cols), np.int32)
        table[0][beyond] = 1 << 20
        for i in range(1, m + 1):
            prev, row = table[i - 1], table[i]
            row[:, 0] = i
            row[:, 1:] = np.minimum(prev[:, :-1] + (t != q[:, i - 1:i]), prev[:, 1:] + 1)
            np.minimum.accumulate(row - j, axis=1, out=row)
            row += j
            row[beyond] = 1 << 20
        for p, i in enumerate(part):
            x, y = int(n[p]), int(np.argmin(table[n[p], p]))
            ops = []
            while x:
                here = table[x, p, y]
                if y and here == table[x - 1, p, y - 1] + (t[p, y - 1] != q[p, x - 1]):
                    ops.append(("=" if t[p, y - 1] == q[p, x - 1] else "X", chr(t[p, y - 1])))
                    x, y = x - 1, y - 1
                elif here == table[x - 1, p, y] + 1:
                    ops.append(("I", ""))
                    x -= 1
                else:
                    ops.append(("D", chr(t[p, y - 1])))
                    y -= 1
            ops, moved = _clip(ops[::-1], clip)
            out[i] = {"err": sum(op != "=" for op, _ in ops), "start": y + moved, "score": sum(op == "=" for op, _ in ops), "cigar": _runs(ops)}
    return out


def local(reads: list[str], windows: list[str], match: int = 1, mismatch: int = -2, gap: int = 4, clip: int = 5):
    """Best local alignment of each pair (linear gaps).

    Ends of fewer than ``clip`` bases that the local alignment leaves out are
    matched base by base instead of clipped, where the window has room for them.
    """
    out: list = [None] * len(reads)
    keep = [i for i, r in enumerate(reads) if r and windows[i]]
    for k in range(0, len(keep), 32):
        part = keep[k:k + 32]
        q, n = _grid([reads[i].upper() for i in part])
        t, w = _grid([windows[i].upper() for i in part])
        m, cols = q.shape[1], t.shape[1] + 1
        j = np.arange(cols, dtype=np.int32) * gap
        table = np.zeros((m + 1, len(part), cols), np.int32)
        for i in range(1, m + 1):
            prev, row = table[i - 1], table[i]
            same = (t == q[:, i - 1:i]) & (t != 0)
            row[:, 1:] = np.maximum(np.maximum(prev[:, :-1] + np.where(same, match, mismatch), prev[:, 1:] - gap), 0)
            np.maximum.accumulate(row + j, axis=1, out=row)
            row -= j
            row[i > n] = 0
        for p, i in enumerate(part):
            flat = int(np.argmax(table[:, p, :]))
            x, y = divmod(flat, cols)
            score = int(table[x, p, y])
            ops: list[tuple[str, str]] = []
            tail = int(n[p]) - x
            if 0 < tail < clip and y + tail <= w[p]:
                ends = [("=" if t[p, y + d] == q[p, x + d] else "X", chr(t[p, y + d])) for d in range(tail)]
            else:
                ends = [("S", "")] * tail
            while x and table[x, p, y] > 0:
                here = table[x, p, y]
                if y and here == table[x - 1, p, y - 1] + (match if t[p, y - 1] == q[p, x - 1] else mismatch):
                    ops.append(("=" if t[p, y - 1] == q[p, x - 1] else "X", chr(t[p, y - 1])))
                    x, y = x - 1, y - 1
                elif here == table[x - 1, p, y] - gap:
                    ops.append(("I", ""))
                    x -= 1
                else:
                    ops.append(("D", chr(t[p, y - 1])))
                    y -= 1
            ops = ops[::-1]
            if 0 < x < clip and y >= x:
                ops = [("=" if t[p, y - x + d] == q[p, d] else "X", chr(t[p, y - x + d])) for d in range(x)] + ops
                y -= x
            else:
                ops = [("S", "")] * x + ops
            ops += ends
            out[i] = {"err": sum(op != "=" for op, _ in ops), "start": y, "score": score, "cigar": _runs(ops)}
    return out


def _frame(rows) -> pd.DataFrame:
    empty = {"err": None, "start": None, "score": None, "cigar": None}
    return pd.DataFrame([r or empty for r in rows], columns=list(empty))


@F.pandas_udf(RESULT)
def align_in_window(read: pd.Series, window: pd.Series) -> pd.DataFrame:
    return _frame(global_in_window(read.fillna("").tolist(), [w if isinstance(w, str) else None for w in window]))


@F.pandas_udf(RESULT)
def align_locally(read: pd.Series, window: pd.Series) -> pd.DataFrame:
    return _frame(local(read.fillna("").tolist(), [w if isinstance(w, str) else "" for w in window]))
