"""Queries over alignments: classes, pairs, flags, places, posteriors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import sam, stats
from strandloom.functions import seq as S
from strandloom.operators import align, graph, intervals, ordinals, quant
from strandloom.runtime import read_table


def _aligns(spark, sf):
    """Alignments once each: re-delivered rows agree but for their load time."""
    return read_table(spark, sf, "f_align").select("align_id", "read_id", "trans_id", "pos", "f_len", "dis", "ori").distinct()


def _mapped(spark, sf):
    return _aligns(spark, sf).filter("trans_id >= 0")


def _transcripts(spark, sf):
    return read_table(spark, sf, "transcripts").select("tid", "gene_id", "chr_id", "len")


def _placed(spark, sf):
    """Alignments with the place (from 0) where their bucket begins on the transcript."""
    t = _transcripts(spark, sf)
    a = _mapped(spark, sf).withColumnRenamed("trans_id", "tid")
    return a.join(t, "tid").withColumn("at", F.floor((F.col("pos") - 1) * F.col("len") / 64).cast("int"))


def eq_classes(spark, sf):
    """Reads by the set of transcripts of their least-error alignments."""
    best = align.best(_mapped(spark, sf), ["read_id"], "dis")
    cls = quant.classes(best, "read_id", "trans_id", "dis")
    return cls.select(F.concat_ws(",", F.transform("refs", lambda x: x.cast("string"))).alias("refs"), "n")


def unique_map(spark, sf):
    best = align.best(_mapped(spark, sf), ["read_id"], "dis")
    return quant.unique_counts(quant.classes(best, "read_id", "trans_id", "dis"))


def qname_group(spark, sf):
    """Reads with fewer than 1000 alignments, by how many they have, with and without unmapped ones."""
    per = _aligns(spark, sf).groupBy("read_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("trans_id") >= 0).alias("mapped"))
    return per.filter("n < 1000").groupBy("n", "mapped").agg(F.count(F.lit(1)).alias("n_reads"))


def mapping_totals(spark, sf):
    """One row: reads, mapped reads, unmapped ones, mean fragment length of the first alignment of least error."""
    per = _aligns(spark, sf).groupBy("read_id").agg(F.count_if(F.col("trans_id") >= 0).alias("hits"), F.min(F.struct("dis", "align_id", "f_len")).alias("first"))
    return per.agg(F.count(F.lit(1)).alias("n_reads"), F.count_if(F.col("hits") > 0).alias("n_mapped"), F.count_if(F.col("hits") == 0).alias("n_unmapped"), F.count_if(F.col("hits") > 1).alias("n_multi"), F.round(F.avg("first.f_len"), 6).alias("mean_frag"))


def mate_band_join(spark, sf):
    """Reads 2k - 1 and 2k as mates: alignments on one transcript within 200 bases, each with its nearest."""
    p = _placed(spark, sf).withColumn("pair", F.floor((F.col("read_id") + 1) / 2)).select("read_id", "pair", "tid", F.col("at").alias("pos"), F.col("dis").alias("err"))
    best = p.groupBy("read_id", "pair", "tid", "pos").agg(F.min("err").alias("err"))
    left, right = best.filter("read_id % 2 = 1"), best.filter("read_id % 2 = 0")
    return align.proper_pairs(left, right, "pair", 200).select("pair", "tid", "pos1", "pos2", "err1", "err2", "dist")


def _outcomes(spark, sf):
    """Outcomes of the pairs of reads 2k - 1 and 2k, by forward and reverse alignments."""
    a = _mapped(spark, sf).withColumn("pair", F.floor((F.col("read_id") + 1) / 2))
    first = F.col("read_id") % 2 == 1
    slot = {"a0": first & (F.col("ori") == 1), "a1": ~first & (F.col("ori") == 0), "b0": ~first & (F.col("ori") == 1), "b1": first & (F.col("ori") == 0)}
    per = a.groupBy("pair").agg(
        *[F.max(c).alias(k) for k, c in slot.items()],
        *[F.coalesce(F.min(F.when(c, F.col("dis"))), F.lit(100)).alias(f"e_{k}") for k, c in slot.items()],
        *[F.collect_set(F.when(c, F.col("trans_id"))).alias(f"t_{k}") for k, c in slot.items()],
    )
    ready = per.select(
        "pair", *slot, F.arrays_overlap("t_a0", "t_a1").alias("a_proper"), F.arrays_overlap("t_b0", "t_b1").alias("b_proper"), (F.col("e_a0") + F.col("e_a1")).alias("err_a"), (F.col("e_b0") + F.col("e_b1")).alias("err_b"), F.lit(True).alias("a_tx"), F.lit(True).alias("b_tx")
    )
    return align.decide(ready)


def decision_tree(spark, sf):
    """How many pairs have each outcome."""
    return _outcomes(spark, sf).groupBy("outcome", "counted").agg(F.count(F.lit(1)).alias("n_pairs"), F.bit_xor("pair").alias("mixed"))


def posterior(spark, sf):
    """Share of each alignment in its read, weights falling by errors; shares below 1e-3 are dropped."""
    a = _mapped(spark, sf).withColumn("w", F.pow(F.lit(0.25), F.col("dis")))
    noise = F.pow(F.lit(0.25), F.lit(12))
    p = F.col("w") / (F.sum("w").over(Window.partitionBy("read_id")) + noise)
    return a.select("align_id", "read_id", "trans_id", p.alias("post")).filter("post >= 0.001").select("align_id", "read_id", "trans_id", F.round("post", 9).alias("post"))


def sufficient_stats(spark, sf):
    """Sums of the posteriors by start bucket, orientation and mismatches."""
    a = _mapped(spark, sf).withColumn("w", F.pow(F.lit(0.25), F.col("dis")))
    a = a.withColumn("post", F.col("w") / F.sum("w").over(Window.partitionBy("read_id")))
    return a.groupBy("pos", "ori").agg(F.round(F.sum("post"), 6).alias("mass"), F.round(F.sum(F.col("post") * F.col("dis")), 6).alias("wrong"))


def gene_groups(spark, sf):
    """Neighbouring alignments of a read on one gene make one group; the mapping quality follows from their number."""
    t = _transcripts(spark, sf).select(F.col("tid").alias("trans_id"), "gene_id")
    hits = _mapped(spark, sf).select("read_id", "trans_id").distinct().join(t, "trans_id")
    g = intervals.group_changes(hits, ["read_id"], ["trans_id"], lambda before, now: before("gene_id") == now("gene_id"))
    return g.groupBy("n_groups", sam.mapq(F.col("n_groups")).alias("mapq")).agg(F.count(F.lit(1)).alias("n_reads"))


def sam_flags(spark, sf):
    """Flags of the alignments, read 2k - 1 being the first mate, with bin and template length."""
    a = _placed(spark, sf)
    first = F.col("read_id") % 2 == 1
    w = Window.partitionBy("read_id").orderBy("dis", "align_id")
    f = sam.flag(paired=F.lit(True), proper=F.col("dis") < 3, reverse=F.col("ori") == 0, mate_reverse=F.col("ori") == 1, first=first, last=~first, secondary=F.row_number().over(w) > 1)
    out = a.select("align_id", f.alias("flag"), sam.reg2bin(F.col("at") * 1000, F.col("at") * 1000 + F.coalesce("f_len", F.lit(1))).alias("bin"), sam.template_length(F.col("at"), F.col("at") + 50, F.lit(100), F.col("len") > 300, first).alias("tlen"))
    return out


def flag_filter(spark, sf):
    f = sam_flags(spark, sf)
    return f.filter(sam.kept_by_model(F.col("flag"), F.col("tlen")) & ~sam.has(F.col("flag"), sam.SECONDARY)).groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("align_id").alias("mixed"))


def cigar_rle(spark, sf):
    """Qualities as operations, run by run: F matches, a comma mismatches, a colon inserts, # clips."""
    r = read_table(spark, sf, "reads").filter("qual IS NOT NULL").select("read_id", "qual").distinct()
    ops = F.regexp_replace(F.translate("qual", "F,:#", "=XIS"), "[^=XIS]", "")
    c = sam.merge_runs(sam.runs_of(ops))
    r = r.withColumn("c", c)
    return r.select("read_id", sam.cigar_text(F.col("c")).alias("cigar"), sam.edit_count(F.col("c")).cast("long").alias("nm"), sam.cigar_text(sam.reverse_cigar(F.col("c"))).alias("turned"))


def tid_intersect(spark, sf):
    """Transcripts hit in both orientations."""
    a = _mapped(spark, sf)
    return a.filter("ori = 0").select("trans_id").intersect(a.filter("ori = 1").select("trans_id"))


def lanes_union(spark, sf):
    """All lanes laid together, then counted by mate."""
    r = read_table(spark, sf, "reads").select("read_id", "lane", "mate", S.strip_mate(F.col("name")).alias("name")).distinct()
    return r.groupBy("mate").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("n_names"))


def zip_pairs(spark, sf):
    """First and second mates of each lane joined by their number; how many find one, by lane."""
    r = read_table(spark, sf, "reads").select("read_id", "lane", "mate").distinct()
    n = ordinals.number_rows(r, ["lane", "mate"], ["read_id"], "k")
    one, two = n.filter("mate = 1").select("lane", "k", F.col("read_id").alias("r1")), n.filter("mate = 2").select("lane", "k", F.col("read_id").alias("r2"))
    z = one.join(two, ["lane", "k"], "full_outer")
    return z.groupBy("lane").agg(F.count_if(F.col("r1").isNotNull() & F.col("r2").isNotNull()).alias("n_pairs"), F.count_if(F.col("r1").isNull() | F.col("r2").isNull()).alias("n_single"), F.sum(F.col("r2") - F.col("r1")).alias("drift"))


def unmapped_anti(spark, sf):
    """Reads without any alignment, by run."""
    r = read_table(spark, sf, "reads").select("read_id", "run_id").distinct()
    return r.join(_mapped(spark, sf).select("read_id"), "read_id", "left_anti").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_reads"))


def _exons(spark, sf):
    """Transcripts as the exons of their gene, in order of tid, 100 bases apart on the chromosome."""
    t = _transcripts(spark, sf).filter("chr_id IS NOT NULL")
    w = Window.partitionBy("chr_id").orderBy("tid").rowsBetween(Window.unboundedPreceding, -1)
    placed = t.withColumn("start", F.coalesce(F.sum(F.col("len") + 100).over(w), F.lit(0)))
    return intervals.exon_offsets(placed, "gene_id", ["tid"], "len")


def liftover(spark, sf):
    """Alignments' places on their gene's joined exons, lifted to the chromosome; summed up by chromosome."""
    e = _exons(spark, sf)
    p = _placed(spark, sf).select("align_id", "tid", "gene_id", "at").join(e.select("tid", "lo", "chr_id"), "tid").withColumn("on_gene", F.col("lo") + F.col("at"))
    l = intervals.lift(p.drop("lo"), e, "gene_id", "on_gene")
    return l.select("align_id", "gene_id", "chr_id", "on_gene", "genome_pos")


def _chroms(spark, sf):
    t = _transcripts(spark, sf).filter("chr_id IS NOT NULL")
    return intervals.chromosome_offsets(t.groupBy("chr_id").agg(F.sum(F.col("len") + 100).alias("chr_len")), "chr_id", "chr_len")


def chr_coord(spark, sf):
    """Places in the joined genome back to chromosomes."""
    c = _chroms(spark, sf)
    l = liftover(spark, sf).join(c.select(F.col("chr_id").alias("c"), "offset"), F.col("chr_id") == F.col("c")).select("align_id", (F.col("genome_pos") + F.col("offset")).alias("joined_pos"))
    return intervals.chromosome_places(l, c, "joined_pos", "chr_len").select("align_id", "chr_id", "chr_pos")


def _intervals(spark, sf, suffix):
    t = _transcripts(spark, sf).filter("chr_id IS NOT NULL")
    start = (F.col("tid") * 37) % 5000
    return t.select("chr_id", F.col("tid").alias(f"tid{suffix}"), F.col("gene_id").alias(f"gene{suffix}"), start.alias(f"s{suffix}"), (start + F.col("len") - 1).alias(f"e{suffix}"))


def interval_overlap(spark, sf):
    """Transcripts of different genes that overlap on a chromosome."""
    both = intervals.overlaps(_intervals(spark, sf, "1"), _intervals(spark, sf, "2"), "chr_id", ("s1", "e1"), ("s2", "e2"), 1000)
    return both.filter("tid1 < tid2 AND gene1 <> gene2").select("chr_id", "tid1", "tid2")


def genome_band_join(spark, sf):
    """Transcripts that begin within 3 bases of one another, whatever their chromosome."""
    a, b = _intervals(spark, sf, "1"), _intervals(spark, sf, "2")
    return intervals.band_join(a.select("tid1", "s1"), b.select("tid2", "s2"), "s1", "s2", 3).filter("tid1 < tid2")


def nearest_range_join(spark, sf):
    """For each transcript the nearest begin of another gene on its chromosome within 2000 bases, ties kept."""
    a, b = _intervals(spark, sf, "1"), _intervals(spark, sf, "2")
    return intervals.nearest(a, b, ["tid1"], "s1", "s2", 2000, ["chr_id"], ("gene1", "gene2")).select("tid1", "tid2", F.col("dist").cast("int").alias("dist"))


def gene_components(spark, sf):
    """Genes that share a read, directly or through others, by all mapped alignments."""
    t = _transcripts(spark, sf).select(F.col("tid").alias("trans_id"), "gene_id")
    h = _mapped(spark, sf).select("read_id", "trans_id").join(t, "trans_id").select("read_id", "gene_id").distinct()
    low = h.groupBy("read_id").agg(F.min("gene_id").alias("a"))
    return graph.components(h.join(low, "read_id").select("a", F.col("gene_id").alias("b")).distinct()).select(F.col("node").alias("gene_id"), "group")


def fusion_pairs(spark, sf):
    """Genes that reads 2k - 1 and 2k point to and that lie apart, by pair of reads; genes begin where their first transcript does."""
    t = _transcripts(spark, sf).select(F.col("tid").alias("trans_id"), "gene_id")
    h = _mapped(spark, sf).select("read_id", "trans_id").join(t, "trans_id").select("read_id", "gene_id").distinct().withColumn("pair", F.floor((F.col("read_id") + 1) / 2))
    genes = _intervals(spark, sf, "").groupBy("gene").agg(F.min("chr_id").alias("chr"), F.min("s").alias("start"), F.max("e").alias("end")).withColumnRenamed("gene", "gene_id")
    return graph.gene_pairs(h.filter("read_id % 2 = 1"), h.filter("read_id % 2 = 0"), "pair", genes)


def pair_summary(spark, sf):
    """Totals and ratios of proper, improper and unmapped pairs."""
    s = align.mapping_summary(_outcomes(spark, sf))
    return s.select("total", "proper", "improper", "unmapped", *[F.round(c, 6).alias(c) for c in ("proper_ratio", "improper_ratio", "unmapped_ratio")])


def cigar_lift(spark, sf):
    """Alignments of f_len matches on their gene's joined exons, lifted to the chromosome with an N for each gap."""
    e = _exons(spark, sf).select(F.col("gene_id").alias("tid"), "chr_id", "lo", "hi", "start")
    p = _placed(spark, sf).filter("f_len > 0").select("align_id", F.col("tid").alias("t"), "gene_id", "at", "f_len")
    on = p.join(_exons(spark, sf).select(F.col("tid").alias("t"), F.col("lo").alias("begin")), "t")
    op = F.array(F.struct(F.lit("=").alias("op"), F.col("f_len").alias("len"), F.lit("").alias("ref")))
    hits = on.select("align_id", F.col("gene_id").alias("tid"), (F.col("begin") + F.col("at")).cast("int").alias("pos"), op.alias("cigar"))
    l = intervals.lift_alignments(hits, e, ["align_id"])
    return l.select("align_id", "chr_id", "genome_pos", sam.cigar_text(F.col("genome_cigar")).alias("cigar"))


def nearest_begin(spark, sf):
    """For each alignment, lifted to its chromosome, the nearest begins of transcripts within 500 bases, ties kept."""
    l = liftover(spark, sf).select("align_id", F.col("chr_id"), "genome_pos")
    b = _exons(spark, sf).select("chr_id", "tid", F.col("start").alias("begin"))
    return intervals.nearest(l, b, ["align_id"], "genome_pos", "begin", 500, ["chr_id"]).select("align_id", "tid", "dist")


def length_pmf(spark, sf):
    h = stats.histogram(_aligns(spark, sf), "f_len")
    return h.select("f_len", "n", F.round("pdf", 9).alias("pdf"), F.round("cdf", 9).alias("cdf"))


def length_mean_sd(spark, sf):
    h = stats.histogram(_aligns(spark, sf), "f_len")
    s = stats.mean_and_sd(h, "f_len", F.col("n").cast("double"))
    return s.select(F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def eff_len_model(spark, sf):
    t = stats.model_effective_length(_transcripts(spark, sf), "len", stats.histogram(_aligns(spark, sf), "f_len"), "f_len")
    return t.select("tid", F.round("eff_length", 6).alias("eff_length"))


def eff_len(spark, sf):
    """Effective lengths for the mean fragment."""
    mean = _aligns(spark, sf).agg(F.avg("f_len").alias("mean"))
    t = _transcripts(spark, sf).join(F.broadcast(mean))
    return t.select("tid", F.round(stats.effective_length(F.col("len"), F.col("mean")), 6).alias("eff_length"))


_A = "a AS (SELECT DISTINCT align_id, read_id, trans_id, pos, f_len, dis, ori FROM f_align), g AS (SELECT * FROM a WHERE trans_id >= 0)"
_BEST = "b AS (SELECT * FROM g QUALIFY rank() OVER (PARTITION BY read_id ORDER BY dis) = 1), s AS (SELECT read_id, list_sort(list_distinct(list(trans_id))) AS refs, min(dis) AS e FROM b GROUP BY 1), c AS (SELECT refs, count(*) AS n FROM s WHERE len(refs) = 1 OR e < 7 GROUP BY 1)"
_PL = "pl AS (SELECT g.*, t.gene_id, t.chr_id, t.len, floor((g.pos - 1) * t.len / 64)::INT AS at0 FROM g JOIN transcripts t ON t.tid = g.trans_id)"
_EX = """ex AS (SELECT tid, gene_id, chr_id, len, coalesce(sum(len + 100) OVER (PARTITION BY chr_id ORDER BY tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  sum(len) OVER (PARTITION BY gene_id ORDER BY tid) - len AS lo, sum(len) OVER (PARTITION BY gene_id ORDER BY tid) AS hi FROM transcripts WHERE chr_id IS NOT NULL),
li AS (SELECT p.align_id, p.gene_id, e.chr_id, (e.lo + p.at0)::BIGINT AS on_gene, (x.start + e.lo + p.at0 - x.lo)::BIGINT AS genome_pos FROM pl p JOIN ex e ON e.tid = p.trans_id JOIN ex x ON x.gene_id = p.gene_id AND e.lo + p.at0 >= x.lo AND e.lo + p.at0 < x.hi)"""
_IV = "iv AS (SELECT tid, gene_id, chr_id, (tid * 37) % 5000 AS s, (tid * 37) % 5000 + len - 1 AS e FROM transcripts WHERE chr_id IS NOT NULL)"
_FLAG = f"""{_A}, {_PL}, fl AS (SELECT align_id,
  (1 + CASE WHEN dis < 3 THEN 2 ELSE 0 END + CASE WHEN ori = 0 THEN 16 ELSE 0 END + CASE WHEN ori = 1 THEN 32 ELSE 0 END + CASE WHEN read_id % 2 = 1 THEN 64 ELSE 128 END
  + CASE WHEN row_number() OVER (PARTITION BY read_id ORDER BY dis, align_id) > 1 THEN 256 ELSE 0 END)::INT AS flag,
  at0 * 1000 AS beg, at0 * 1000 + coalesce(f_len, 1) - 1 AS fin,
  CASE WHEN len > 300 THEN CASE WHEN read_id % 2 = 1 THEN 150 ELSE -50 END ELSE 0 END AS tlen FROM pl)"""
_PMF = f"{_A}, h AS (SELECT f_len, count(*) AS n FROM a WHERE f_len IS NOT NULL GROUP BY 1), q AS (SELECT f_len, n, n / sum(n) OVER () AS pdf, sum(n) OVER (ORDER BY f_len) / sum(n) OVER () AS cdf FROM h)"

_DECIDED = f"""{_A}, k AS (SELECT (read_id + 1) // 2 AS pair, CASE WHEN read_id % 2 = 1 THEN CASE WHEN ori = 1 THEN 'a0' ELSE 'b1' END ELSE CASE WHEN ori = 0 THEN 'a1' ELSE 'b0' END END AS slot, trans_id, dis FROM g),
p AS (SELECT pair, bool_or(slot = 'a0') AS a0, bool_or(slot = 'a1') AS a1, bool_or(slot = 'b0') AS b0, bool_or(slot = 'b1') AS b1,
  coalesce(min(dis) FILTER (slot = 'a0'), 100) + coalesce(min(dis) FILTER (slot = 'a1'), 100) AS ea, coalesce(min(dis) FILTER (slot = 'b0'), 100) + coalesce(min(dis) FILTER (slot = 'b1'), 100) AS eb,
  list_has_any(coalesce(list(trans_id) FILTER (slot = 'a0'), []), coalesce(list(trans_id) FILTER (slot = 'a1'), [])) AS pa, list_has_any(coalesce(list(trans_id) FILTER (slot = 'b0'), []), coalesce(list(trans_id) FILTER (slot = 'b1'), [])) AS pb FROM k GROUP BY 1),
q AS (SELECT *, pa AND (NOT pb OR ea <= eb) AS wa, pb AND (NOT pa OR eb <= ea) AS wb FROM p),
dt AS (SELECT CASE WHEN wa AND wb THEN 'proper_both' WHEN wa THEN 'proper_a' WHEN wb THEN 'proper_b' WHEN a0 AND a1 AND (NOT (b0 AND b1) OR ea < eb) THEN 'improper_a' WHEN b0 AND b1 THEN 'improper_b'
  WHEN a0 AND b0 THEN 'both_forward' WHEN a1 AND b1 THEN 'both_reverse' WHEN a0 THEN 'single_a0' WHEN a1 THEN 'single_a1' WHEN b0 THEN 'single_b0' WHEN b1 THEN 'single_b1' ELSE 'unmapped' END AS outcome, wa OR wb AS counted, pair FROM q)"""
#: Smallest labels spread over shared reads; twelve rounds reach further than any gene is from another.
_COMPONENTS = """h AS MATERIALIZED (SELECT DISTINCT read_id, gene_id FROM g JOIN transcripts ON tid = trans_id), l0 AS (SELECT DISTINCT gene_id, gene_id AS l FROM h)""" + "".join(
    f", r{k} AS MATERIALIZED (SELECT read_id, min(l) AS l FROM h JOIN l{k - 1} USING (gene_id) GROUP BY 1), l{k} AS MATERIALIZED (SELECT gene_id, min(l) AS l FROM h JOIN r{k} USING (read_id) GROUP BY 1)" for k in range(1, 13)
)

QUERIES = {
    "eq_classes": (eq_classes, f"WITH {_A}, {_BEST} SELECT array_to_string(refs, ',') AS refs, n FROM c"),
    "unique_map": (unique_map, f"WITH {_A}, {_BEST} SELECT refs[1] AS tid, sum(n)::BIGINT AS unique_map FROM c WHERE len(refs) = 1 GROUP BY 1"),
    "qname_group": (qname_group, f"WITH {_A}, p AS (SELECT read_id, count(*) AS n, count(*) FILTER (trans_id >= 0) AS mapped FROM a GROUP BY 1) SELECT n, mapped, count(*) AS n_reads FROM p WHERE n < 1000 GROUP BY 1, 2"),
    "mapping_totals": (
        mapping_totals,
        f"""WITH {_A}, p AS (SELECT read_id, count(*) FILTER (trans_id >= 0) AS hits FROM a GROUP BY 1),
f AS (SELECT f_len FROM a QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY dis, align_id) = 1)
SELECT count(*) AS n_reads, count(*) FILTER (hits > 0) AS n_mapped, count(*) FILTER (hits = 0) AS n_unmapped, count(*) FILTER (hits > 1) AS n_multi, (SELECT round(avg(f_len), 6) FROM f) AS mean_frag FROM p""",
    ),
    "mate_band_join": (
        mate_band_join,
        f"""WITH {_A}, {_PL}, k AS (SELECT (read_id + 1) // 2 AS pair, read_id % 2 AS side, trans_id AS tid, at0 AS pos, min(dis) AS err FROM pl GROUP BY ALL),
j AS (SELECT x.pair, x.tid, x.pos AS pos1, y.pos AS pos2, x.err AS err1, y.err AS err2, abs(x.pos - y.pos) AS dist FROM k x JOIN k y ON x.pair = y.pair AND x.tid = y.tid AND x.side = 1 AND y.side = 0 WHERE abs(x.pos - y.pos) <= 200)
SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY pair, tid, pos1 ORDER BY dist, pos2) = 1 AND row_number() OVER (PARTITION BY pair, tid, pos2 ORDER BY dist, pos1) = 1""",
    ),
    "decision_tree": (decision_tree, f"WITH {_DECIDED} SELECT outcome, counted, count(*) AS n_pairs, bit_xor(pair) AS mixed FROM dt GROUP BY 1, 2"),
    "pair_summary": (
        pair_summary,
        f"""WITH {_DECIDED}, c AS (SELECT count(*) AS total, count(*) FILTER (starts_with(outcome, 'proper')) AS proper, count(*) FILTER (outcome = 'unmapped') AS unmapped FROM dt)
SELECT total, proper, total - proper - unmapped AS improper, unmapped, round(proper / greatest(total, 1), 6) AS proper_ratio, round((total - proper - unmapped) / greatest(total, 1), 6) AS improper_ratio, round(unmapped / greatest(total, 1), 6) AS unmapped_ratio FROM c""",
    ),
    "fusion_pairs": (
        fusion_pairs,
        f"""WITH {_A}, {_IV}, gn AS (SELECT gene_id, min(chr_id) AS chr, min(s) AS s, max(e) AS e FROM iv GROUP BY 1),
h AS (SELECT DISTINCT read_id, (read_id + 1) // 2 AS pair, gene_id FROM g JOIN transcripts ON tid = trans_id),
j AS (SELECT x.pair, x.gene_id AS a, y.gene_id AS b FROM h x JOIN h y ON x.pair = y.pair AND x.read_id % 2 = 1 AND y.read_id % 2 = 0 WHERE x.gene_id <> y.gene_id)
SELECT DISTINCT pair, least(a, b) AS gene_a, greatest(a, b) AS gene_b FROM j JOIN gn p ON p.gene_id = a JOIN gn q ON q.gene_id = b WHERE NOT (p.chr = q.chr AND p.s <= q.e AND q.s <= p.e)""",
    ),
    "cigar_lift": (
        cigar_lift,
        f"""WITH {_A}, {_PL}, {_EX}, p AS (SELECT pl.align_id, pl.gene_id, e.lo + pl.at0 AS p0, e.lo + pl.at0 + pl.f_len AS p1 FROM pl JOIN ex e ON e.tid = pl.trans_id WHERE pl.f_len > 0),
z AS (SELECT gene_id, max(hi) AS z FROM ex GROUP BY 1),
c AS (SELECT align_id, x.chr_id, x.lo, x.start + greatest(p0, x.lo) - x.lo AS g0, (CASE WHEN x.hi = z THEN p1 ELSE least(p1, x.hi) END) - greatest(p0, x.lo) AS n FROM p JOIN z USING (gene_id) JOIN ex x ON x.gene_id = p.gene_id AND x.lo < p1 AND x.hi > p0),
w AS (SELECT *, g0 - lag(g0 + n) OVER (PARTITION BY align_id ORDER BY lo) AS gap FROM c)
SELECT align_id, any_value(chr_id) AS chr_id, min(g0)::BIGINT AS genome_pos, string_agg(CASE WHEN gap > 0 THEN gap::BIGINT || 'N' ELSE '' END || n::BIGINT || '=', '' ORDER BY lo) AS cigar FROM w GROUP BY 1""",
    ),
    "nearest_begin": (
        nearest_begin,
        f"""WITH {_A}, {_PL}, {_EX}, b AS (SELECT DISTINCT chr_id, start FROM ex), q AS (SELECT align_id, chr_id, genome_pos FROM li),
d AS (SELECT q.align_id, q.chr_id, q.genome_pos, q.genome_pos - b.start AS d FROM q ASOF JOIN b ON q.chr_id = b.chr_id AND q.genome_pos >= b.start UNION ALL SELECT q.align_id, q.chr_id, q.genome_pos, b.start - q.genome_pos FROM q ASOF JOIN b ON q.chr_id = b.chr_id AND q.genome_pos <= b.start),
n AS (SELECT align_id, chr_id, genome_pos, min(d) AS d FROM d GROUP BY ALL HAVING min(d) <= 500)
SELECT DISTINCT align_id, tid, d::BIGINT AS dist FROM n JOIN ex ON ex.chr_id = n.chr_id AND (start = genome_pos - d OR start = genome_pos + d)""",
    ),
    "posterior": (
        posterior,
        f"WITH {_A}, p AS (SELECT align_id, read_id, trans_id, pow(0.25, dis) / (sum(pow(0.25, dis)) OVER (PARTITION BY read_id) + pow(0.25, 12)) AS post FROM g) SELECT align_id, read_id, trans_id, round(post, 9) AS post FROM p WHERE post >= 0.001",
    ),
    "sufficient_stats": (
        sufficient_stats,
        f"WITH {_A}, p AS (SELECT pos, ori, dis, pow(0.25, dis) / sum(pow(0.25, dis)) OVER (PARTITION BY read_id) AS post FROM g) SELECT pos, ori, round(sum(post), 6) AS mass, round(sum(post * dis), 6) AS wrong FROM p GROUP BY 1, 2",
    ),
    "gene_groups": (
        gene_groups,
        f"""WITH {_A}, d AS (SELECT DISTINCT read_id, trans_id FROM g), x AS (SELECT read_id, CASE WHEN gene_id = lag(gene_id) OVER (PARTITION BY read_id ORDER BY trans_id) THEN 0 ELSE 1 END AS new FROM d JOIN transcripts ON tid = trans_id),
n AS (SELECT read_id, sum(new)::BIGINT AS n_groups FROM x GROUP BY 1)
SELECT n_groups, CASE WHEN n_groups = 1 THEN 70 ELSE floor(-10 * log10(1 - 1 / n_groups)) END::INT AS mapq, count(*) AS n_reads FROM n GROUP BY 1, 2""",
    ),
    "sam_flags": (
        sam_flags,
        f"""WITH {_FLAG} SELECT align_id, flag, (CASE WHEN beg >> 14 = fin >> 14 THEN 4681 + (beg >> 14) WHEN beg >> 17 = fin >> 17 THEN 585 + (beg >> 17) WHEN beg >> 20 = fin >> 20 THEN 73 + (beg >> 20)
 WHEN beg >> 23 = fin >> 23 THEN 9 + (beg >> 23) WHEN beg >> 26 = fin >> 26 THEN 1 + (beg >> 26) ELSE 0 END)::INT AS bin, tlen FROM fl""",
    ),
    "flag_filter": (flag_filter, f"WITH {_FLAG} SELECT flag, count(*) AS n, bit_xor(align_id) AS mixed FROM fl WHERE flag & 2 <> 0 AND flag & 4 = 0 AND tlen >= 0 AND flag & 256 = 0 GROUP BY 1"),
    "cigar_rle": (
        cigar_rle,
        r"""WITH q AS (SELECT DISTINCT read_id, regexp_replace(translate(qual, 'F,:#', '=XIS'), '[^=XIS]', '', 'g') AS o FROM reads WHERE qual IS NOT NULL),
c AS (SELECT read_id, o, CASE WHEN regexp_matches(o, '^S*[^S]+S') THEN regexp_extract(o, '^(S*[^S]+)', 1) || repeat('S', (length(o) - length(regexp_extract(o, '^(S*[^S]+)', 1)))::INT) ELSE o END AS f FROM q),
l AS (SELECT read_id, f, regexp_extract_all(f, '=+|X+|I+|S+') AS runs FROM c)
SELECT read_id, coalesce(array_to_string(list_transform(runs, lambda x: length(x)::VARCHAR || left(x, 1)), ''), '') AS cigar, length(regexp_replace(f, '[^XI]', '', 'g')) AS nm,
  coalesce(array_to_string(list_reverse(list_transform(runs, lambda x: length(x)::VARCHAR || left(x, 1))), ''), '') AS turned FROM l""",
    ),
    "tid_intersect": (tid_intersect, f"WITH {_A} SELECT trans_id FROM g WHERE ori = 0 INTERSECT SELECT trans_id FROM g WHERE ori = 1"),
    "lanes_union": (
        lanes_union,
        "WITH r AS (SELECT DISTINCT read_id, lane, mate, regexp_replace(name, '/[12]$', '') AS name FROM reads) SELECT mate, count(*) AS n, count(DISTINCT name) AS n_names FROM r GROUP BY 1",
    ),
    "zip_pairs": (
        zip_pairs,
        """WITH n AS (SELECT read_id, lane, mate, row_number() OVER (PARTITION BY lane, mate ORDER BY read_id) AS k FROM (SELECT DISTINCT read_id, lane, mate FROM reads)),
z AS (SELECT coalesce(a.lane, b.lane) AS lane, a.read_id AS r1, b.read_id AS r2 FROM (SELECT * FROM n WHERE mate = 1) a FULL JOIN (SELECT * FROM n WHERE mate = 2) b ON a.lane = b.lane AND a.k = b.k)
SELECT lane, count(*) FILTER (r1 IS NOT NULL AND r2 IS NOT NULL) AS n_pairs, count(*) FILTER (r1 IS NULL OR r2 IS NULL) AS n_single, sum(r2 - r1)::BIGINT AS drift FROM z GROUP BY 1""",
    ),
    "unmapped_anti": (unmapped_anti, f"WITH {_A}, r AS (SELECT DISTINCT read_id, run_id FROM reads) SELECT run_id, count(*) AS n_reads FROM r ANTI JOIN g USING (read_id) GROUP BY 1"),
    "liftover": (liftover, f"WITH {_A}, {_PL}, {_EX} SELECT * FROM li"),
    "chr_coord": (
        chr_coord,
        f"""WITH {_A}, {_PL}, {_EX}, ch AS (SELECT chr_id, sum(len + 100) AS n FROM transcripts WHERE chr_id IS NOT NULL GROUP BY 1), o AS (SELECT chr_id, n, sum(n) OVER (ORDER BY chr_id) - n AS off FROM ch),
j AS (SELECT align_id, genome_pos + off AS pos FROM li JOIN o USING (chr_id)) SELECT align_id, chr_id, (pos - off)::BIGINT AS chr_pos FROM j JOIN o ON pos >= off AND pos < off + n""",
    ),
    "interval_overlap": (interval_overlap, f"WITH {_IV} SELECT a.chr_id, a.tid AS tid1, b.tid AS tid2 FROM iv a JOIN iv b ON a.chr_id = b.chr_id AND a.s <= b.e AND b.s <= a.e AND a.tid < b.tid AND a.gene_id <> b.gene_id"),
    "genome_band_join": (genome_band_join, f"WITH {_IV} SELECT a.tid AS tid1, a.s AS s1, b.tid AS tid2, b.s AS s2 FROM iv a JOIN iv b ON abs(a.s - b.s) <= 3 AND a.tid < b.tid"),
    "nearest_range_join": (
        nearest_range_join,
        f"WITH {_IV}, j AS (SELECT a.tid AS tid1, b.tid AS tid2, abs(a.s - b.s) AS dist FROM iv a JOIN iv b ON a.chr_id = b.chr_id AND abs(a.s - b.s) <= 2000 AND a.gene_id <> b.gene_id) SELECT tid1, tid2, dist FROM j QUALIFY rank() OVER (PARTITION BY tid1 ORDER BY dist) = 1",
    ),
    "gene_components": (gene_components, f"WITH {_A}, {_COMPONENTS} SELECT gene_id, l AS \"group\" FROM l12"),
    "length_pmf": (length_pmf, f"WITH {_PMF} SELECT f_len, n, round(pdf, 9) AS pdf, round(cdf, 9) AS cdf FROM q"),
    "length_mean_sd": (length_mean_sd, f"WITH {_A} SELECT round(avg(f_len), 6) AS mean, round(stddev_pop(f_len), 6) AS sd FROM a WHERE f_len IS NOT NULL"),
    "eff_len_model": (
        eff_len_model,
        f"WITH {_PMF}, x AS (SELECT tid, coalesce(sum(pdf) * (any_value(len) + 1) - sum(pdf * f_len), 0) AS e FROM transcripts LEFT JOIN q ON f_len <= len GROUP BY tid) SELECT tid, round(CASE WHEN e >= 1 THEN e ELSE 0 END, 6)::DOUBLE AS eff_length FROM x",
    ),
    "eff_len": (eff_len, f"WITH {_A}, m AS (SELECT avg(f_len) AS m FROM a) SELECT tid, round(CASE WHEN len < m THEN 0 ELSE len - m + 1 END, 6)::DOUBLE AS eff_length FROM transcripts, m"),
}
