"""De Bruijn graphs, unitigs, simplification and connected groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.seq import kmer_text, reverse_complement
from strandloom.operators import kmers
from strandloom.runtime import materialize


def edges(reads: DataFrame, seq: str = "seq", k: int = 30, strands: bool = True) -> DataFrame:
    """Edges ``src``, ``dst`` (k-mers as codes, k <= 30) with their ``cover``: the (k + 1)-mers of all reads.

    Counting combines on the map side; a (k + 1)-mer of poly-A is one row per task.
    """
    both = reads.select(F.col(seq).alias("s"))
    if strands:
        both = both.unionAll(reads.select(reverse_complement(F.col(seq)).alias("s")))
    counted = kmers.kmers(both, [], "s", k + 1).groupBy("kmer").agg(F.count(F.lit(1)).alias("cover"))
    return counted.select(F.shiftright("kmer", 2).alias("src"), F.col("kmer").bitwiseAND((1 << (2 * k)) - 1).alias("dst"), "cover")


def without_weak(e: DataFrame, ratio: float = 0.2) -> DataFrame:
    """Edges that cover at least ``ratio`` of the best edge out of their source and into their target."""
    out, into = Window.partitionBy("src"), Window.partitionBy("dst")
    return e.withColumn("a", F.max("cover").over(out)).withColumn("b", F.max("cover").over(into)).filter((F.col("cover") >= ratio * F.col("a")) & (F.col("cover") >= ratio * F.col("b"))).drop("a", "b")


def without_tips(e: DataFrame, cover: int = 1, layers: int = 1) -> DataFrame:
    """Without dead ends of at most this cover beside another way, layer by layer until none is left or ``layers`` are gone."""
    for k in range(layers):
        less = _without_tip_layer(e, cover)
        if k + 1 < layers:
            less = materialize(less, "edges")
            if less.count() == e.count():
                return less
        e = less
    return e


def _without_tip_layer(e: DataFrame, cover: int) -> DataFrame:
    outs = e.groupBy("src").agg(F.count(F.lit(1)).alias("n_out")).withColumnRenamed("src", "v")
    ins = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n_in")).withColumnRenamed("dst", "w")
    leaves = e.join(outs.select(F.col("v").alias("dst")), "dst", "left_anti").join(outs.filter("n_out > 1").select(F.col("v").alias("src")), "src", "left_semi")
    roots = e.join(ins.select(F.col("w").alias("src")), "src", "left_anti").join(ins.filter("n_in > 1").select(F.col("w").alias("dst")), "dst", "left_semi")
    tips = leaves.unionByName(roots).filter(F.col("cover") <= cover).select("src", "dst").distinct()
    return e.join(tips, ["src", "dst"], "left_anti")


def without_bubbles(e: DataFrame) -> DataFrame:
    """Of parallel paths of two edges between one source and target the best covered stays (ties: the first middle)."""
    a = e.select(F.col("src").alias("s"), F.col("dst").alias("m"), F.col("cover").alias("c1"))
    b = e.select(F.col("src").alias("m"), F.col("dst").alias("t"), F.col("cover").alias("c2"))
    simple = e.groupBy("src").count().filter("count = 1").select(F.col("src").alias("m")).join(e.groupBy("dst").count().filter("count = 1").select(F.col("dst").alias("m")), "m")
    paths = a.join(b, "m").join(simple, "m", "left_semi").withColumn("cover", F.least("c1", "c2"))
    lost = paths.withColumn("k", F.row_number().over(Window.partitionBy("s", "t").orderBy(F.desc("cover"), "m"))).filter("k > 1").select("m")
    return e.join(lost.select(F.col("m").alias("src")), "src", "left_anti").join(lost.select(F.col("m").alias("dst")), "dst", "left_anti")


def unitigs(e: DataFrame, k: int = 30) -> DataFrame:
    """Paths without a branch, as ``contig`` and mean ``cover``.

    A node whose only way on leads to a node with no other way in is linked
    to it. Pointer doubling finds each node's first node and its distance in
    logarithmically many rounds; circles are opened at their smallest node.
    """
    e = materialize(e, "edges")
    one_out = e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("src")
    one_in = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("dst")
    links = materialize(e.join(one_out, "src", "left_semi").join(one_in, "dst", "left_semi").filter("src <> dst"), "links")
    starts = links.select("src").subtract(links.select("dst"))
    nodes = links.select(F.col("dst").alias("node"), F.col("src").alias("ptr"), F.lit(1).cast("long").alias("dist"), F.least("src", "dst").alias("low"))
    nodes = nodes.unionByName(starts.select(F.col("src").alias("node"), F.col("src").alias("ptr"), F.lit(0).cast("long").alias("dist"), F.col("src").alias("low")))
    nodes = materialize(nodes, "pointers")
    heads = materialize(starts.withColumnRenamed("src", "head"), "heads")
    rounds = max(1, (links.count() + 1).bit_length())

    def doubled(n):
        to = n.select(F.col("node").alias("ptr"), F.col("ptr").alias("p2"), F.col("dist").alias("d2"), F.col("low").alias("l2"))
        return n.join(to, "ptr").select("node", F.col("p2").alias("ptr"), (F.col("dist") + F.col("d2")).alias("dist"), F.least("low", "l2").alias("low"))

    def settled(n):
        for _ in range(rounds):
            if n.join(heads, F.col("ptr") == F.col("head"), "left_anti").limit(1).count() == 0:
                break
            n = materialize(doubled(n), "pointers")
        return n

    done = settled(nodes)
    circle = materialize(done.join(heads, F.col("ptr") == F.col("head"), "left_anti").select("node", "low"), "circles")
    if circle.limit(1).count():
        opened = circle.filter("node = low").select("node")
        heads = materialize(heads.unionByName(opened.select(F.col("node").alias("head"))), "heads")
        fresh = nodes.join(opened, "node", "left_anti").unionByName(opened.select("node", F.col("node").alias("ptr"), F.lit(0).cast("long").alias("dist"), F.col("node").alias("low")))
        done = settled(materialize(fresh, "pointers"))
    inner = links.join(done.select(F.col("node").alias("dst"), F.col("ptr").alias("head"), "dist"), "dst").filter("dist > 0")
    ordered = F.array_sort(F.collect_list(F.struct("dist", kmer_text(F.col("dst").bitwiseAND(3), 1).alias("base"))))
    joined = inner.groupBy("head").agg(F.concat_ws("", F.transform(ordered, lambda x: x["base"])).alias("rest"), F.avg("cover").alias("cover"))
    return joined.select(F.concat(kmer_text(F.col("head"), k), "rest").alias("contig"), "cover")


def components(pairs: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """Connected groups of an edge list: ``node`` and ``group`` (the smallest node of it).

    Smallest labels spread over edges and jump along pointers; each round is
    written, and rounds grow with the logarithm of the diameter. Neither labels
    nor edges are collected.
    """
    e = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    e = materialize(e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    label = materialize(e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("group")).withColumnRenamed("u", "node"), "labels")
    for _ in range(most):
        seen = e.join(label.select(F.col("node").alias("v"), "group"), "v").groupBy("u").agg(F.min("group").alias("near")).withColumnRenamed("u", "node")
        low = label.join(seen, "node").select("node", F.least("group", "near").alias("group"), F.col("group").alias("old"))
        jump = low.join(label.select(F.col("node").alias("group"), F.col("group").alias("over")), "group").select("node", F.least("group", "over").alias("group"), "old")
        new = materialize(jump, "labels")
        changed = new.filter("group <> old").limit(1).count()
        label = new.select("node", "group")
        if not changed:
            break
    return label


def gene_pairs(hits1: DataFrame, hits2: DataFrame, read: str, genes: DataFrame) -> DataFrame:
    """Pairs of genes that the mates of a read point to and that don't overlap: ``read``, ``gene_a``, ``gene_b``.

    ``genes``: ``gene_id``, ``chr``, ``start``, ``end``. Mates have few hits, so
    the join is on the read.
    """
    a = hits1.select(read, F.col("gene_id").alias("gene_a")).distinct()
    b = hits2.select(read, F.col("gene_id").alias("gene_b")).distinct()
    both = a.join(b, read).filter("gene_a <> gene_b")
    g = genes.select("gene_id", "chr", "start", "end")
    for side in ("a", "b"):
        both = both.join(g.select(*[F.col(c).alias(f"{c}_{side}" if c != "gene_id" else f"gene_{side}") for c in g.columns]), f"gene_{side}")
    apart = ~((F.col("chr_a") == F.col("chr_b")) & (F.col("start_a") <= F.col("end_b")) & (F.col("start_b") <= F.col("end_a")))
    ordered = both.filter(F.coalesce(apart, F.lit(True)))
    return ordered.select(read, F.least("gene_a", "gene_b").alias("gene_a"), F.greatest("gene_a", "gene_b").alias("gene_b")).distinct()


def grouped_pairs(pairs: DataFrame) -> DataFrame:
    """Gene pairs with the group of pairs that share genes, directly or through others, and their number of reads."""
    groups = components(pairs, "gene_a", "gene_b")
    counted = pairs.groupBy("gene_a", "gene_b").agg(F.count(F.lit(1)).alias("n_reads"))
    return counted.join(groups.select(F.col("node").alias("gene_a"), "group"), "gene_a")


def half_targets(contigs: DataFrame, index: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """The target that most seeds of each half of a contig lie on (ties: the smallest), with the outermost places."""
    length = F.length(seq)
    halves = contigs.select(key, F.explode(F.array(F.struct(F.lit(0).alias("half"), F.substring(F.col(seq), F.lit(1), F.floor(length / 2).cast("int")).alias("s")), F.struct(F.lit(1).alias("half"), F.substring(F.col(seq), F.floor(length / 2).cast("int") + 1, length).alias("s")))).alias("x")).select(key, "x.half", F.col("x.s").alias("s"))
    hits = kmers.seed_hits(halves, index, [key, "half"], "s", k, 1)
    per = hits.groupBy(key, "half", "tid").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), (F.max("pos") + k).alias("last"))
    return per.withColumn("r", F.row_number().over(Window.partitionBy(key, "half").orderBy(F.desc("n"), "tid"))).filter("r = 1").drop("r")


def longest_contigs(contigs: DataFrame, group: list[str]) -> DataFrame:
    """The longest ``contig`` of each group, of equals the first in order."""
    best = F.min_by("contig", F.struct(-F.length("contig"), F.col("contig")))
    return contigs.groupBy(*group).agg(best.alias("contig"))


def fusion_rows(halves: DataFrame, contigs: DataFrame, exons: DataFrame, targets: DataFrame, genes: DataFrame, key: str, within: int = 10) -> DataFrame:
    """A row for each contig whose halves lie on two genes: place, gene id, strand and name of both sides, and the contig.

    ``halves`` from ``half_targets``. The first half counts by its last place,
    the second by its first one; both are moved to an exon border less than
    ``within`` away and lifted to the chromosome. ``exons``: ``tid``, ``chr_id``, ``lo``, ``hi``, ``start``.
    """
    e = exons.select("tid", "chr_id", "lo", "hi", "start")
    end = F.when(F.col("half") == 0, F.col("last")).otherwise(F.col("first"))
    p = halves.select(key, "half", "tid", end.cast("long").alias("pos"))
    snapped = snap_to_exons(p.select("tid", "pos").distinct(), e, within)
    # the place behind a transcript's last base lies in its last exon
    last = e.groupBy("tid").agg(F.max("hi").alias("__end"))
    inside = F.when(F.col("snapped") >= F.col("hi"), (F.col("snapped") == F.col("hi")) & (F.col("hi") == F.col("__end"))).otherwise(F.col("snapped") >= F.col("lo"))
    placed = p.join(snapped, ["tid", "pos"]).join(e.join(last, "tid"), "tid").filter(inside)
    placed = placed.select(key, "half", "tid", "chr_id", (F.col("start") + F.col("snapped") - F.col("lo")).alias("place"))
    named = placed.join(targets.select("tid", "gene_id"), "tid").join(genes.select("gene_id", "ensembl_id", "strand", "name"), "gene_id")
    sides = [named.filter(F.col("half") == h).select(key, *[F.col(c).alias(f"{c}{h + 1}") for c in ("chr_id", "place", "gene_id", "ensembl_id", "strand", "name")]) for h in (0, 1)]
    both = sides[0].join(sides[1], key).filter("gene_id1 <> gene_id2")
    return both.drop("gene_id1", "gene_id2").join(contigs, key)


def snap_to_exons(places: DataFrame, exons: DataFrame, within: int = 10) -> DataFrame:
    """Moves ``pos`` on ``tid`` to the nearest exon border less than ``within`` away (ties: the lower one)."""
    borders = exons.select("tid", F.explode(F.array("lo", "hi")).alias("border")).distinct()
    near = places.join(borders, "tid", "left").withColumn("d", F.abs(F.col("border") - F.col("pos")))
    w = Window.partitionBy(*places.columns).orderBy("d", "border")
    first = near.withColumn("r", F.row_number().over(w)).filter("r = 1")
    return first.withColumn("snapped", F.when(F.col("d") < within, F.col("border")).otherwise(F.col("pos"))).select(*places.columns, "snapped")
