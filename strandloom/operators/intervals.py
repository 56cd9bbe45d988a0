"""Joins on ranges, bands and nearest places, as equi-joins on bins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, width: int, on: list[str] | None = None) -> DataFrame:
    """Pairs with |a - b| <= width (and equal ``on``): bins of the width, each left row in its own and both neighbours.

    Column names of the two sides must differ but for ``on``. Exact: the bins
    only find candidates. A null place joins nothing.
    """
    size = max(1, width)
    bin_ = F.floor(F.col(a) / size)
    x = left.withColumn("__bin", F.explode(F.array(bin_ - 1, bin_, bin_ + 1)))
    y = right.withColumn("__bin", F.floor(F.col(b) / size))
    return x.join(y, [*(on or []), "__bin"]).filter(F.abs(F.col(a) - F.col(b)) <= width).drop("__bin")


def _neighbours(events: DataFrame, on: list[str], up: bool) -> DataFrame:
    """Adds ``__n`` to events of both sides within bins: the last right place up to each (or the first from it on) with its mark, and the next one beyond of another mark."""
    order = [F.col("__p").asc() if up else F.col("__p").desc(), F.col("__m")]
    own = Window.partitionBy(*on, "__bin", "__left").orderBy(*order)
    # of right rows: the nearest place before it whose mark differs
    change = F.when(F.lag("__m").over(own) != F.col("__m"), F.lag("__p").over(own))
    told = events.withColumn("__o", F.when(~F.col("__left"), F.last(change, True).over(own.rowsBetween(Window.unboundedPreceding, 0))))
    right = F.when(~F.col("__left"), F.struct(F.col("__p").alias("p"), F.col("__m").alias("m"), F.col("__o").alias("o")))
    # right rows of a place come before left rows of it
    both = Window.partitionBy(*on, "__bin").orderBy(order[0], F.col("__left"), F.col("__m")).rowsBetween(Window.unboundedPreceding, 0)
    return told.withColumn("__n", F.last(right, True).over(both)).drop("__o")


def nearest(left: DataFrame, right: DataFrame, key: list[str], a: str, b: str, width: int, on: list[str], differ: tuple[str, str] | None = None) -> DataFrame:
    """For each left row (``key``) the right rows of least distance ``dist`` within the width; ties kept.

    ``differ``: a left and a right column that must not be equal (nulls count as
    one value). No pairs are formed before the nearest place is known: places of both sides
    are sorted within bins of the width, where running last and first places tell the
    neighbours, and the outermost places of the bins beside it the
    rest. Only rows of the places found are joined. A null place joins nothing.
    """
    size = max(1, width)
    keys = list(dict.fromkeys([*key, *on, a, *([differ[0]] if differ else [])]))
    marks = [F.coalesce(F.col(c).cast("string"), F.lit("")) if differ else F.col(p).cast("string") for c, p in zip(differ or (a, b), (a, b))]
    own = left.filter(F.col(a).isNotNull()).select(*keys, F.floor(F.col(a) / size).alias("__bin"), F.col(a).cast("long").alias("__p"), marks[0].alias("__m")).distinct()
    there = right.filter(F.col(b).isNotNull()).select(*on, F.floor(F.col(b) / size).alias("__bin"), F.col(b).cast("long").alias("__p"), marks[1].alias("__m")).distinct()
    events = own.withColumn("__left", F.lit(True)).unionByName(there.withColumn("__left", F.lit(False)), allowMissingColumns=True)
    for up in (True, False):
        name = "__lo" if up else "__hi"
        events = _neighbours(events, on, up).withColumnRenamed("__n", name)
    inner = events.filter("__left")
    for up, name, step in ((True, "__lo2", 1), (False, "__hi2", -1)):
        far = _neighbours(there.withColumn("__left", F.lit(False)), on, up)
        best = F.max_by("__n", F.struct("__p", "__m")) if up else F.max_by("__n", F.struct(-F.col("__p"), F.col("__m")))
        edge = far.groupBy(*on, "__bin").agg(best.alias(name))
        inner = inner.join(edge.withColumn("__bin", F.col("__bin") + step), [*on, "__bin"], "left")

    def place(n):
        return F.when(F.col(n)["m"] != F.col("__m"), F.col(n)["p"]).otherwise(F.col(n)["o"]) if differ else F.col(n)["p"]

    lo, hi = F.coalesce(place("__lo"), place("__lo2")), F.coalesce(place("__hi"), place("__hi2"))
    found = inner.select(*keys, "__p", lo.alias("__a"), hi.alias("__b")).withColumn("dist", F.least(F.col("__p") - F.col("__a"), F.col("__b") - F.col("__p"))).filter(F.col("dist") <= width)
    sides = F.array(F.when(F.col("__p") - F.col("__a") == F.col("dist"), F.col("__a")), F.when(F.col("__b") - F.col("__p") == F.col("dist"), F.col("__b")))
    places = found.select(*keys, "dist", F.explode(F.array_distinct(F.array_compact(sides))).alias("__at"))
    met = places.join(right.withColumn("__at", F.col(b).cast("long")), [*on, "__at"]).drop("__at")
    if differ:
        met = met.filter(~F.col(differ[0]).eqNullSafe(F.col(differ[1])))
    return left.join(met, keys)


def overlaps(left: DataFrame, right: DataFrame, on: str, a: tuple[str, str], b: tuple[str, str], size: int) -> DataFrame:
    """Pairs of intervals (both ends inside) of one ``on`` that meet.

    Both sides are spread over the bins that they touch; a pair is kept in the
    bin where the later of the two begins, so it comes out once.
    """

    def bins(df, lo, hi, to):
        return df.withColumn(to, F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))))

    x, y = bins(left, *a, "__bin"), bins(right, *b, "__bin")
    met = x.join(y, [on, "__bin"]).filter((F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1])))
    return met.filter(F.col("__bin") == F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / size)).drop("__bin")


def exon_offsets(exons: DataFrame, tid: str, order: list[str], length: str) -> DataFrame:
    """Adds ``lo`` and ``hi``: the part [lo, hi) of the transcript that each exon makes up."""
    w = Window.partitionBy(tid).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return exons.withColumn("hi", F.sum(length).over(w)).withColumn("lo", F.col("hi") - F.col(length))


def lift(places: DataFrame, exons: DataFrame, tid: str, pos: str, start: str = "start") -> DataFrame:
    """Places on transcripts as places on the genome (``genome_pos``); ``exons`` from ``exon_offsets``.

    An equi-join on the transcript; a transcript has few exons, so the range is
    a residual filter.
    """
    e = exons.select(F.col(tid).alias("__t"), "lo", "hi", F.col(start).alias("__start"))
    met = places.join(e, (F.col(tid) == F.col("__t")) & (F.col(pos) >= F.col("lo")) & (F.col(pos) < F.col("hi")))
    return met.withColumn("genome_pos", F.col("__start") + F.col(pos) - F.col("lo")).drop("__t", "__start")


def chromosome_offsets(chroms: DataFrame, order: str, length: str) -> DataFrame:
    """Adds ``offset``: where each chromosome begins in the joined genome (a table of some dozen rows)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return chroms.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0)))


def chromosome_places(places: DataFrame, chroms: DataFrame, pos: str, length: str, most: int = 100_000) -> DataFrame:
    """Adds the chromosome's columns and ``chr_pos`` to places in the joined genome.

    The table of chromosomes is sent to all tasks after its size is checked;
    a larger one goes through a join on bins.
    """
    inside = (F.col(pos) >= F.col("offset")) & (F.col(pos) < F.col("offset") + F.col(length))
    if chroms.limit(most + 1).count() <= most:
        met = places.join(F.broadcast(chroms), inside)
    else:
        size = max(1, int(chroms.agg(F.avg(length)).first()[0]))
        spread = chroms.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("offset") / size), F.floor((F.col("offset") + F.col(length) - 1) / size))))
        met = places.withColumn("__bin", F.floor(F.col(pos) / size)).join(spread, "__bin").filter(inside).drop("__bin")
    return met.withColumn("chr_pos", F.col(pos) - F.col("offset"))


def group_changes(df: DataFrame, key: list[str], order: list[str], same) -> DataFrame:
    """Number of groups of neighbours per key: ``same(previous, current)`` says whether two rows belong together.

    ``previous`` and ``current`` are functions from a column name to a column.
    """
    w = Window.partitionBy(*key).orderBy(*order)

    def previous(name):
        return F.lag(name).over(w)

    begins = F.when(F.row_number().over(w) == 1, 1).when(F.coalesce(same(previous, F.col), F.lit(False)), 0).otherwise(1)
    return df.withColumn("__new", begins).groupBy(*key).agg(F.sum("__new").alias("n_groups"))


def lift_cigar(pos: int, cigar, exons) -> tuple[int, list[dict]] | None:
    """Place and operations of a transcript alignment on the genome, an ``N`` for each intron that it spans.

    ``exons``: (lo, hi, start) in order. Insertions and clips stay where they
    are. None if the alignment begins outside of the transcript.
    """
    k = next((i for i, (lo, hi, _) in enumerate(exons) if lo <= pos < hi), None)
    if k is None:
        return None
    out: list[dict] = []

    def add(op, n, ref=""):
        if n and out and out[-1]["op"] == op:
            out[-1]["len"] += n
            out[-1]["ref"] += ref
        elif n:
            out.append({"op": op, "len": n, "ref": ref})

    at, begin = pos, exons[k][2] + pos - exons[k][0]
    for c in cigar:
        op, n, ref = c["op"], c["len"], c["ref"] or ""
        if op not in ("=", "X", "M", "D"):
            add(op, n, ref)
            continue
        done = 0
        while done < n:
            while at >= exons[k][1] and k + 1 < len(exons):
                add("N", exons[k + 1][2] - (exons[k][2] + exons[k][1] - exons[k][0]))
                k += 1
            room = exons[k][1] - at if k + 1 < len(exons) else n - done
            step = min(n - done, room)
            add(op, step, ref[done:done + step])
            at, done = at + step, done + step
    return begin, out


def lift_alignments(hits: DataFrame, exons: DataFrame, key: list[str]) -> DataFrame:
    """``key``, ``chr_id``, ``genome_pos`` and ``genome_cigar`` of hits with ``tid``, ``pos`` and ``cigar``.

    The exons of a transcript come as one array, joined on the transcript; the
    walk along them runs in Arrow batches.
    """
    from strandloom.operators.dp import OPERATION

    schema = T.StructType([T.StructField("pos", T.LongType()), T.StructField("cigar", T.ArrayType(OPERATION))])

    @F.pandas_udf(schema)
    def lifted(pos: pd.Series, cigar: pd.Series, parts: pd.Series) -> pd.DataFrame:
        rows = [lift_cigar(int(p), c, [(e["lo"], e["hi"], e["start"]) for e in x]) for p, c, x in zip(pos, cigar, parts)]
        return pd.DataFrame([{"pos": r[0], "cigar": r[1]} if r else {"pos": None, "cigar": None} for r in rows], columns=["pos", "cigar"])

    e = exons.groupBy("tid", "chr_id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "start"))).alias("parts"))
    done = hits.join(e, "tid").withColumn("g", lifted("pos", "cigar", "parts"))
    return done.select(*key, "tid", "chr_id", F.col("g.pos").alias("genome_pos"), F.col("g.cigar").alias("genome_cigar")).filter("genome_pos IS NOT NULL")
