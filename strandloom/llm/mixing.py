"""Mixing of sources to target shares, with capped repeats and without a sort.

Each document has a hash. A source's documents below a threshold of the hash
make up its share; the threshold comes from sums of tokens by source and hash
bucket, of which only the bucket that holds the threshold is split further. A
larger budget keeps every document of a smaller one.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.runtime import materialize

BITS, HASH_BITS = 10, 60


def same_source(c):
    """Spellings of a source made one: case, outer blanks, and blank, hyphen and underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s+|\s+$", ""), r"[\s_-]+", "_")


class Plan(NamedTuple):
    """What one source contributes: ``full`` times all of it, once more what hashes below ``below``."""

    source: str
    target: float
    full: int
    below: int
    short: bool


def sized(docs: DataFrame, doc_id: str, source: str, size) -> DataFrame:
    """Columns ``doc_id``, ``source`` (made one), ``h`` and ``tokens``; ``size`` is a column."""
    h = F.shiftrightunsigned(F.xxhash64(F.col(doc_id)), 64 - HASH_BITS)
    return docs.select(F.col(doc_id).alias("doc_id"), same_source(F.col(source)).alias("source"), h.alias("h"), size.cast("long").alias("tokens"))


def _histogram(table: DataFrame, depth: int, at: dict[str, int]) -> dict[str, dict[int, tuple[int, int]]]:
    """Tokens and documents by source and the bits of the hash after the prefix ``at``.

    Sums are combined on the map side; no more than sources x 2 ** BITS rows come back.
    """
    spark = table.sparkSession
    # shifts take 60-bit hashes; the prefix of the first level is empty
    prefix = F.shiftright("h", HASH_BITS - depth * BITS) if depth else F.lit(0).cast("long")
    chosen = spark.createDataFrame(list(at.items()), "source string, prefix long")
    bucket = F.shiftright("h", HASH_BITS - (depth + 1) * BITS).bitwiseAND((1 << BITS) - 1).cast("int")
    rows = table.withColumn("prefix", prefix).join(F.broadcast(chosen), ["source", "prefix"]).groupBy("source", bucket.alias("bucket")).agg(F.sum("tokens"), F.count(F.lit(1)))
    out: dict[str, dict[int, tuple[int, int]]] = {}
    for s, b, tokens, n in rows.collect():
        out.setdefault(s, {})[b] = (tokens or 0, n)
    return out


def plan(table: DataFrame, targets: list[tuple[str, float, int]]) -> tuple[list[Plan], int]:
    """A plan for each target (source, share, most repeats), and the size of all documents."""
    total = table.agg(F.sum("tokens")).first()[0] or 0
    names = {s: s for s, _, _ in targets}
    first = _histogram(table, 0, dict.fromkeys(names, 0))
    plans: dict[str, Plan] = {}
    open_: dict[str, tuple[int, float]] = {}  # source: prefix so far and tokens still wanted
    for s, share, most in targets:
        own = sum(t for t, _ in first.get(s, {}).values())
        want = share * total
        if own * most <= want:
            plans[s] = Plan(s, want, most, 0, own * most < want)
            continue
        full = int(want // own)
        plans[s] = Plan(s, want, full, 0, False)
        if want - full * own > 0:
            open_[s] = (0, want - full * own)
    depth, level = 0, first
    while open_:
        going: dict[str, tuple[int, float]] = {}
        for s, (prefix, rest) in open_.items():
            below, edge = prefix << BITS, None
            for b in sorted(level.get(s, {})):
                t, n = level[s][b]
                if t <= rest:
                    rest, below = rest - t, (prefix << BITS) + b + 1
                    continue
                edge = (b, t, n)
                break
            shift = HASH_BITS - (depth + 1) * BITS
            if edge is not None and edge[2] > 1 and shift > 0:
                going[s] = ((prefix << BITS) + edge[0], rest)
                below = (prefix << BITS) + edge[0]
            elif edge is not None:
                # one document, or one hash, stands at the edge: take it if that comes closer
                below = (prefix << BITS) + edge[0] + (1 if edge[1] - rest < rest else 0)
            plans[s] = plans[s]._replace(below=below << shift)
        open_, depth = going, depth + 1
        if open_:
            level = _histogram(table, depth, {s: p for s, (p, _) in open_.items()})
    return [plans[s] for s, _, _ in targets], total


def read_targets(targets: DataFrame, source: str, share: str, repeats: str) -> list[tuple[str, str, float, int]]:
    """Rows of the target table: name as given, name made one, share, most repeats.

    Rows with a null source, share or repeats are left out; shares and repeats
    below 0 are refused, as are two rows of one source.
    """
    rows = targets.select(F.col(source), same_source(F.col(source)), F.col(share).cast("double"), F.col(repeats).cast("int")).collect()
    rows = [tuple(r) for r in rows if None not in tuple(r)]
    if any(w < 0 or math.isnan(w) or m < 0 for _, _, w, m in rows):
        raise ValueError("shares and repeats can't be negative")
    if len({r[1] for r in rows}) < len(rows):
        raise ValueError("two targets for one source")
    return sorted(rows)


class Mix:
    """The chosen documents and what came of the targets."""

    def __init__(self, table: DataFrame, targets: list[tuple[str, str, float, int]]):
        self.names = {same: given for given, same, _, _ in targets}
        self.shares = {same: w for _, same, w, _ in targets}
        self.plans, self.total = plan(table, [(same, w, m) for _, same, w, m in targets])
        self.table = table

    def _plans(self) -> DataFrame:
        rows = [(p.source, self.names[p.source], self.shares[p.source], float(p.target), p.full, p.below, p.short) for p in self.plans]
        return self.table.sparkSession.createDataFrame(rows, "source string, name string, target_share double, target double, full int, below long, short boolean")

    def documents(self) -> DataFrame:
        """``doc_id``, ``source`` (as in the targets), ``tokens`` and ``repeats`` of each document used; ``whole``: all of its source are."""
        both = self.table.join(F.broadcast(self._plans()), "source")
        repeats = F.col("full") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
        return both.select("doc_id", F.col("name").alias("source"), "tokens", repeats.alias("repeats"), (F.col("full") > 0).alias("whole")).filter("repeats > 0")

    def report(self) -> DataFrame:
        """For each target: tokens used, its part of the mix and of all documents, and whether it falls short."""
        used = self.documents().groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"))
        rows = self._plans().select(F.col("name").alias("source"), "target_share", "short").join(F.broadcast(used), "source", "left")
        rows = rows.withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
        mix = rows.agg(F.sum("used_tokens").alias("mix"))
        return rows.join(F.broadcast(mix)).select(
            "source", "target_share", "short", "used_tokens", (F.col("used_tokens") / F.greatest(F.col("mix"), F.lit(1))).alias("mix_share"), (F.col("used_tokens") / F.lit(max(self.total, 1))).alias("total_share")
        )

    def short_sources(self) -> DataFrame:
        """The sources that fall short of their target with every repeat used."""
        return self._plans().filter("short").select(F.col("name").alias("source"))


def mix(docs: DataFrame, targets: DataFrame, doc_id: str, source: str, size_table) -> Mix:
    """Plans a mix of ``docs``; ``size_table(docs, keep)`` gives columns ``keep`` and ``tokens``.

    The goal of a source is its share of the tokens of all documents, listed
    sources or not. Documents with a null source count in that total and are
    never used, nor are those of sources without a target. Documents with equal
    ids have one hash and go in together. Empty texts have no tokens. An empty
    table gives an empty mix, in which no source is short.
    """
    rows = size_table(docs, [F.col(doc_id).alias("__id"), F.col(source).alias("__source")])
    table = materialize(sized(rows, "__id", "__source", F.col("tokens")), "sizes")
    return Mix(table, read_targets(targets, "source", "target_share", "max_repeats"))
