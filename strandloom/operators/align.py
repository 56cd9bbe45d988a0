"""From seeds to hits, pairs and the decision on each pair."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.seq import K
from strandloom.operators import dp, kmers, skew
from strandloom.runtime import materialize

MAX_FRAGMENT, MAX_PAIR_ERROR, SLACK = 1000, 7, 7


def chains(hits: DataFrame, key: list[str], k: int = K, slack: int = SLACK) -> DataFrame:
    """Seeds of one target in increasing order on read and target: islands of the sorted hits.

    An island ends where the read place doesn't grow or the diagonal moves by
    more than ``slack``. Columns ``key``, ``tid``, ``n_seeds``, ``off`` and
    ``pos`` of the first seed, ``last_off`` and ``last_pos``. One window per
    (read, target): its rows are bounded by seeds of a read, not by the data.
    """
    order = Window.partitionBy(*key, "tid").orderBy("pos", "off")
    moved = F.abs(F.col("diag") - F.lag("diag").over(order)) > slack
    broken = F.lag("off").over(order).isNull() | (F.col("off") <= F.lag("off").over(order)) | moved
    marked = hits.withColumn("__new", F.when(broken, 1).otherwise(0))
    numbered = marked.withColumn("chain", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "tid", "chain").agg(F.count(F.lit(1)).alias("n_seeds"), F.min("off").alias("off"), F.min("pos").alias("pos"), F.max("off").alias("last_off"), F.max("pos").alias("last_pos"))


def seeded_enough(chain: DataFrame, length: Column, k: int = K) -> DataFrame:
    """Chains of at least two seeds; one is enough for reads of at most two k-mers."""
    return chain.filter((F.col("n_seeds") >= 2) | (F.floor(length / k) <= 2))


def _tile_rows(size: int, overlap: int):
    def run(batches):
        for b in batches:
            tids, numbers, texts = [], [], []
            for tid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k in range(0, max(1, -(-len(text or "") // size))):
                    tids.append(tid)
                    numbers.append(k)
                    texts.append((text or "")[k * size:(k + 1) * size + overlap])
            yield pa.RecordBatch.from_arrays([pa.array(tids, b.schema.field(0).type), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["tid", "__tile", "__text"])

    return run


class Tiles:
    """Targets cut into overlapping tiles, so that a place brings its surroundings and not a whole contig.

    Any window of at most ``window`` bases lies in the tile where it begins.
    Tiles as long as ten windows make the overlaps a tenth of the sequence.
    """

    def __init__(self, targets: DataFrame, window: int):
        self.size = max(2000, 10 * window)
        tid = targets.schema["tid"].dataType.simpleString()
        self.rows = targets.select("tid", "seq").mapInArrow(_tile_rows(self.size, window), f"tid {tid}, __tile int, __text string")

    def windows(self, places: DataFrame, start: str, length: Column, row_id: list[str]) -> DataFrame:
        """``places`` (a written table) with ``__window``: ``length`` bases of the target from ``start`` on, what the target has of them.

        A target with a large part of all places is salted.
        """
        at = F.floor(F.col(start) / self.size)
        own = places.withColumn("__at", F.concat_ws(":", F.col("tid").cast("string"), at.cast("string"))).withColumn("__len", length)
        tiles = self.rows.select(F.concat_ws(":", F.col("tid").cast("string"), F.col("__tile").cast("string")).alias("__at"), "__text")
        both = skew.balanced_join(own, tiles, "__at", row_id)
        return both.withColumn("__window", F.substring("__text", (F.col(start) - at * self.size + 1).cast("int"), F.col("__len"))).drop("__at", "__text", "__len")


def longest(reads: DataFrame, seq: str = "seq") -> int:
    return reads.agg(F.max(F.length(seq))).first()[0] or 1


def extend(chain: DataFrame, reads: DataFrame, targets: DataFrame, key: list[str], slack: int = SLACK, most: int | None = None) -> DataFrame:
    """Aligns each chain's read to its place on the target: ``pos``, ``err``, ``score`` and ``cigar``, and the other columns of ``chain``.

    The reads come back by key, the surroundings of the place by tile; only the
    window goes to the kernel. Alignments off the target or with more than half of the
    read wrong are dropped. ``most``: the longest read, if known.
    """
    r = reads.select(*key, F.col("seq").alias("__read"))
    start = F.greatest(F.col("pos") - F.col("off") - slack, F.lit(0))
    joined = materialize(chain.join(r, key).withColumn("__start", start), "chains")
    tiles = Tiles(targets, (most or longest(reads)) + 2 * slack)
    near = tiles.windows(joined, "__start", F.length("__read") + 2 * slack, [*key, "chain"])
    kept = [c for c in chain.columns if c not in (*key, "tid", "chain", "off", "pos", "last_off", "last_pos")]
    done = near.select(*key, "tid", *kept, "__start", F.length("__read").alias("len"), dp.align_in_window("__read", "__window").alias("a"))
    return done.filter(F.col("a.err") * 2 <= F.col("len")).select(*key, "tid", *kept, "len", (F.col("__start") + F.col("a.start")).cast("int").alias("pos"), F.col("a.err").alias("err"), F.col("a.score").alias("score"), F.col("a.cigar").alias("cigar"))


def best(hits: DataFrame, group: list[str], by: str = "err") -> DataFrame:
    """The hits of least ``by`` in each group, ties kept."""
    return hits.withColumn("__rank", F.rank().over(Window.partitionBy(*group).orderBy(by))).filter("__rank = 1").drop("__rank")


def first_hits(hits: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    """At most ``most`` hits of each group, in a total order."""
    return hits.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")


def guided(hits: DataFrame, mate_hits: DataFrame, on: list[str]) -> DataFrame:
    """Hits on targets that the mate hit too."""
    return hits.join(mate_hits.select(*on).distinct(), on, "left_semi")


GUIDED, MULTIPLE, SINGLE = 0, 1, 2


def map_reads(reads: DataFrame, targets: DataFrame, index: DataFrame, key: list[str], k: int = K, stride: int = 14, per_strand: bool = False, mate: str | None = None) -> DataFrame:
    """Best hits of each read over both strands (or on each): ``key``, ``strand``, ``tid``, ``pos``, ``err``, ``cigar``.

    Reads seed at the wide stride first, where a chain needs several seeds. Only
    those without a hit (an anti-join) seed again at the narrow one, in three
    passes, each for what the one before left without a hit: chains on targets that
    the mate hit on the other strand, chains of several seeds, single seeds.
    ``mate`` names the column of ``key`` that tells the mates (1 and 2) of a
    pair apart; without it there is nothing to guide by.
    """
    full = [*key, "strand"]
    turned = materialize(kmers.both_strands(reads.select(*key, "seq").filter(F.length("seq") >= k)).withColumn("__n", F.length("seq")), "turned")
    most = longest(turned)
    group = full if per_strand else key

    def seeded(some, step):
        c = chains(kmers.seed_hits(some, index, [*full, "__n"], "seq", k, step, spread=True), [*full, "__n"], k)
        return c.withColumn("rank", F.when((F.col("n_seeds") >= 2) | (F.floor(F.col("__n") / k) <= 2), MULTIPLE).otherwise(SINGLE)).drop("__n")

    first = seeded(turned, k).filter(F.col("rank") == MULTIPLE)
    wide = materialize(best(extend(first, turned, targets, full, most=most), group), "hits")
    rest = materialize(turned.join(wide.select(*key).distinct(), key, "left_anti"), "rest")
    left = seeded(rest, stride)
    if mate:
        pair = [c for c in key if c != mate]
        hit = wide.select(*pair, (3 - F.col(mate)).alias(mate), (1 - F.col("strand")).alias("strand"), "tid", F.lit(True).alias("__guided")).distinct()
        left = left.join(hit, [*full, "tid"], "left").withColumn("rank", F.when(F.col("__guided"), GUIDED).otherwise(F.col("rank"))).drop("__guided")
    left = materialize(left, "seeded")
    found = None
    for rank in (GUIDED, MULTIPLE, SINGLE) if mate else (MULTIPLE, SINGLE):
        some = left.filter(F.col("rank") == rank)
        if found is not None:
            some = some.join(found.select(*group).distinct(), group, "left_anti")
        hits = materialize(best(extend(some, rest, targets, full, most=most), group), "hits")
        found = hits if found is None else found.unionByName(hits)
    return wide.unionByName(found).drop("rank").dropDuplicates([*full, "tid", "pos"])


def introns(hits: DataFrame, reads: DataFrame, contigs: DataFrame, index: DataFrame, key: list[str], k: int = K, within: int = 2_000_000) -> DataFrame:
    """Clipped ends of at least ``k`` bases that stand elsewhere on the contig, without an error: split reads.

    ``hits`` as from ``map_reads`` on contigs. The segment lies before the hit
    if the start is clipped, behind it if the end is. Candidates come from the
    k-mers of the segment; of those within the distance the nearest stay, ties
    kept. Adds ``side``, ``split_pos`` and ``gap`` (the intron's length).
    """
    head, tail = F.get("cigar", F.lit(0)), F.get("cigar", F.size("cigar") - 1)
    sides = F.array(F.struct(F.lit("start").alias("side"), F.when(head["op"] == "S", head["len"]).otherwise(0).alias("n")), F.struct(F.lit("end").alias("side"), F.when(tail["op"] == "S", tail["len"]).otherwise(0).alias("n")))
    span = F.aggregate(F.filter("cigar", lambda x: x["op"].isin("=", "X", "D")), F.lit(0), lambda s, x: s + x["len"])
    cut = hits.withColumn("__span", span).withColumn("__x", F.explode(sides)).select("*", "__x.side", F.col("__x.n").alias("seg_len")).filter(F.col("seg_len") >= k)
    r = reads.select(*key, "strand", F.col("seq").alias("__read"))
    seg = cut.join(r, [*key, "strand"]).withColumn("segment", F.when(F.col("side") == "start", F.substring("__read", F.lit(1), F.col("seg_len"))).otherwise(F.substring("__read", -F.col("seg_len"), F.col("seg_len"))))
    seg = seg.select(*key, "strand", "tid", "pos", "__span", "side", "seg_len", "segment")
    seeds = kmers.kmers(seg, [*key, "strand", "tid", "pos", "__span", "side", "seg_len"], "segment", k, k)
    at = seeds.join(index.select("kmer", F.col("tid").alias("__c"), F.col("pos").alias("__p")), "kmer").filter(F.col("__c") == F.col("tid"))
    at = at.withColumn("split_pos", F.col("__p") - F.col("at")).select(*key, "strand", "tid", "pos", "__span", "side", "seg_len", "split_pos").distinct()
    gap = F.when(F.col("side") == "start", F.col("pos") - F.col("split_pos") - F.col("seg_len")).otherwise(F.col("split_pos") - F.col("pos") - F.col("__span"))
    near = at.withColumn("gap", gap).filter((F.col("gap") > 0) & (F.col("gap") <= within))
    same = materialize(near.filter("split_pos >= 0").join(seg.select(*key, "strand", "tid", "pos", "side", "segment"), [*key, "strand", "tid", "pos", "side"]), "segments")
    cut = Tiles(contigs, longest(same, "segment")).windows(same, "split_pos", F.col("seg_len"), [*key, "split_pos"])
    exact = cut.filter(F.col("__window") == F.col("segment"))
    return best(exact, [*key, "strand", "tid", "pos", "side"], "gap").select(*key, "strand", "tid", "pos", "side", "seg_len", "split_pos", "gap")


def with_introns(hits: DataFrame) -> DataFrame:
    """Hits whose clipped ends stand beyond an intron (``start``, ``end``: gap, seg_len and split_pos of ``introns``, or null), joined to them by ``N``."""

    def op(kind, n):
        return F.array(F.struct(F.lit(kind).alias("op"), n.cast("int").alias("len"), F.lit("").alias("ref")))

    cigar, n = F.col("cigar"), F.size("cigar")
    headed = F.when(F.col("start").isNotNull(), F.concat(op("=", F.col("start.seg_len")), op("N", F.col("start.gap")), F.slice(cigar, F.lit(2), n - 1))).otherwise(cigar)
    size = F.size("__c")
    tailed = F.when(F.col("end").isNotNull(), F.concat(F.slice("__c", F.lit(1), size - 1), op("N", F.col("end.gap")), op("=", F.col("end.seg_len")))).otherwise(F.col("__c"))
    err = F.col("err") - F.coalesce(F.col("start.seg_len"), F.lit(0)) - F.coalesce(F.col("end.seg_len"), F.lit(0))
    out = hits.withColumn("__c", headed).withColumn("cigar", tailed).withColumn("pos", F.coalesce(F.col("start.split_pos"), F.col("pos")).cast("int"))
    return out.withColumn("err", err.cast("int")).drop("__c", "start", "end")


def proper_pairs(left: DataFrame, right: DataFrame, pair: str, most: int | None = MAX_FRAGMENT, carry: list[str] = ()) -> DataFrame:
    """Mates on one target within ``most`` bases of each other, or at any distance.

    An equi-join on pair, target and stretch of the target with the distance as
    a residual filter, so that hits of a repeat meet near ones only; each hit
    keeps its nearest mate (smallest distance, then places). At any distance the
    hits of a pair on one target meet, which are few. ``carry``: more columns of both sides, with 1 and 2 behind.
    """
    cols = ["pos", "err", *carry]
    a = left.select(pair, "tid", *[F.col(c).alias(f"{c}1") for c in cols])
    b = right.select(pair, "tid", *[F.col(c).alias(f"{c}2") for c in cols])
    on = [pair, "tid"]
    if most is not None:
        at1, at2 = F.floor(F.col("pos1") / (most + 1)), F.floor(F.col("pos2") / (most + 1))
        a = a.withColumn("__at", at1)
        b = b.withColumn("__at", F.explode(F.array(at2 - 1, at2, at2 + 1)))
        on.append("__at")
    both = a.join(b, on).drop("__at").withColumn("dist", F.abs(F.col("pos1") - F.col("pos2")))
    both = both if most is None else both.filter(F.col("dist") <= most)
    one = Window.partitionBy(pair, "tid", "pos1").orderBy("dist", "pos2")
    two = Window.partitionBy(pair, "tid", "pos2").orderBy("dist", "pos1")
    ranked = both.withColumn("__a", F.row_number().over(one)).withColumn("__b", F.row_number().over(two))
    return ranked.filter("__a = 1 AND __b = 1").drop("__a", "__b")


def rescue(hits: DataFrame, mates: DataFrame, targets: DataFrame, pair: str, within: int = MAX_FRAGMENT, most: int | None = None) -> DataFrame:
    """Finds a mate without a hit by local alignment near each hit of its partner.

    Only pairs with one mate missing get here (an anti-join), and only the
    window of the target, by tile, goes to the kernel. Accepted: score of at least a
    quarter of the read, at most half of it wrong; the least error wins.
    """
    near = hits.select(pair, "tid", "pos").join(mates.select(pair, F.col("seq").alias("__mate")), pair)
    near = materialize(near.withColumn("__start", F.greatest(F.col("pos") - within, F.lit(0))), "near")
    tiles = Tiles(targets, 2 * within + (most or longest(mates)))
    cut = tiles.windows(near, "__start", F.lit(2 * within) + F.length("__mate"), [pair, "pos"])
    done = cut.select(pair, "tid", F.col("pos").alias("mate_pos"), "__start", F.length("__mate").alias("len"), dp.align_locally("__mate", "__window").alias("a"))
    good = done.filter((F.col("a.score") * 4 >= F.col("len")) & (F.col("a.err") * 2 <= F.col("len")))
    out = good.select(pair, "tid", "mate_pos", "len", (F.col("__start") + F.col("a.start")).cast("int").alias("pos"), F.col("a.err").alias("err"), F.col("a.cigar").alias("cigar"))
    return best(out, [pair])


def decide(slots: DataFrame) -> DataFrame:
    """The outcome of each pair, from one row per pair.

    Columns wanted: ``a_proper``, ``b_proper`` (whether an orientation is a
    proper pair), ``a0``, ``a1``, ``b0``, ``b1`` (whether each slot has a hit),
    ``err_a``, ``err_b`` (sums of errors), ``a_tx``, ``b_tx`` (whether the proper
    pair lies on the transcriptome). An orientation with more errors than the
    other loses its properness. Adds ``outcome`` and ``counted``.
    """
    a = F.col("a_proper") & (F.col("err_a") <= F.col("err_b"))
    b = F.col("b_proper") & (F.col("err_b") <= F.col("err_a"))
    a, b = a | (F.col("a_proper") & ~F.col("b_proper")), b | (F.col("b_proper") & ~F.col("a_proper"))
    hit_a, hit_b = F.col("a0") & F.col("a1"), F.col("b0") & F.col("b1")
    outcome = (
        F.when(a & b, "proper_both")
        .when(a, "proper_a")
        .when(b, "proper_b")
        .when(hit_a & (~hit_b | (F.col("err_a") < F.col("err_b"))), "improper_a")
        .when(hit_b, "improper_b")
        .when(F.col("a0") & F.col("b0"), "both_forward")
        .when(F.col("a1") & F.col("b1"), "both_reverse")
        .when(F.col("a0"), "single_a0")
        .when(F.col("a1"), "single_a1")
        .when(F.col("b0"), "single_b0")
        .when(F.col("b1"), "single_b1")
        .otherwise("unmapped")
    )
    counted = F.when(a & b, F.col("a_tx") | F.col("b_tx")).when(a, F.col("a_tx")).when(b, F.col("b_tx")).otherwise(False)
    return slots.withColumn("outcome", outcome).withColumn("counted", counted)


def mapping_summary(outcomes: DataFrame) -> DataFrame:
    """One row: total, proper, improper and unmapped pairs with their ratios."""
    kinds = outcomes.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome").startswith("proper")).alias("proper"), F.count_if(F.col("outcome") == "unmapped").alias("unmapped"))
    rest = F.col("total") - F.col("proper") - F.col("unmapped")
    whole = F.greatest(F.col("total"), F.lit(1))
    return kinds.select("total", "proper", rest.alias("improper"), "unmapped", (F.col("proper") / whole).alias("proper_ratio"), (rest / whole).alias("improper_ratio"), (F.col("unmapped") / whole).alias("unmapped_ratio"))
