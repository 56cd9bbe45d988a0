"""From files to files: index building and quantification."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import sam
from strandloom.functions.seq import K, fake_quality, first_token, reverse_complement, strip_mate
from strandloom.operators import align, intervals, kmers, quant
from strandloom.runtime import materialize
from strandloom.sources import annotation, bam, reads as read_source, tables

MAX_FIND = 1_000_000
#: Mates on the genome may have introns between them.
GENOME_FRAGMENT = 2_000_000


def build_index(spark: SparkSession, fasta: str, gtf: str, out: str, first: int | None = None, with_genome: bool = False) -> dict[str, DataFrame]:
    """Transcriptome of a genome and its annotation, with its k-mer postings, as Parquet tables in ``out``.

    ``with_genome``: the contigs and their postings are saved too, so that runs needn't make them.
    """
    contigs = materialize(annotation.genome(spark, fasta, first), "contigs")
    made = annotation.transcriptome(contigs, annotation.gtf(spark, gtf))
    genes = annotation.numbered(made["genes"].select(F.col("gene").alias("ensembl_id"), "strand", "name", "chr", "start", "end"), "ensembl_id", "gene_id")
    t = made["transcripts"].join(genes.select(F.col("ensembl_id").alias("gene"), "gene_id"), "gene")
    t = materialize(annotation.numbered(t, "name", "tid").select("tid", "name", "gene_id", "chr_id", "len", "seq", "transcript"), "transcripts")
    ids = t.select("transcript", "tid")
    e = made["exons"].join(ids, "transcript").select("tid", "chr_id", "start", "end", (F.col("end") - F.col("start")).alias("len"))
    chroms = intervals.chromosome_offsets(contigs.select("chr_id", "name", "len"), "chr_id", "len")
    found = {"transcripts": t.drop("transcript"), "genes": genes, "exons": intervals.exon_offsets(e, "tid", ["start"], "len"), "chroms": chroms}
    tables.save_index(found, out, kmers.postings(t))
    if with_genome:
        _save_genome(contigs, out)
    saved = tables.load_index(spark, out)
    tables.write_fasta(saved["transcripts"], f"{out}/transcripts.fasta", order="tid")
    return saved


def _save_genome(contigs: DataFrame, out: str) -> None:
    rows = contigs.select(F.col("chr_id").alias("tid"), "name", F.col("len").cast("int").alias("len"), F.upper("seq").alias("seq"))
    tables.save_genome(rows, genome_postings(rows), out)


def index_transcripts(spark: SparkSession, fasta: str, out: str, genome: str | None = None) -> dict[str, DataFrame]:
    """The index of ready transcripts, named ``TRANSCRIPT:GENE``; a name without a gene is a gene of its own. ``genome``: FASTA of contigs to save with it."""
    df = read_source.with_ordinals(read_source.scan(spark, fasta)).select(F.col("ordinal").cast("int").alias("tid"), first_token(F.col("name")).alias("name"), F.upper("seq").alias("seq"))
    gene = F.coalesce(F.get(F.split("name", ":"), F.lit(1)), F.col("name"))
    df = materialize(df.withColumn("gene", gene), "transcripts")
    genes = annotation.numbered(df.select(F.col("gene").alias("ensembl_id")).distinct(), "ensembl_id", "gene_id").withColumn("strand", F.lit(".")).withColumn("name", F.col("ensembl_id"))
    t = df.join(genes.select(F.col("ensembl_id").alias("gene"), "gene_id"), "gene").select("tid", "name", "gene_id", F.lit(None).cast("int").alias("chr_id"), F.length("seq").alias("len"), "seq")
    tables.save_index({"transcripts": t, "genes": genes}, out, kmers.postings(t))
    if genome:
        _save_genome(annotation.genome(spark, genome), out)
    return tables.load_index(spark, out)


CARRIED = ["strand", "cigar"]


def _orientation(hits: DataFrame, mates: DataFrame, targets: DataFrame, forward: int, most: int) -> DataFrame:
    """Proper pairs of one orientation: mate ``forward`` as it is, the other turned.

    Mates on one target near each other, else at any distance; where they share
    no target or one has no hit, it is looked for near its partner.
    """
    a = hits.filter((F.col("mate") == forward) & (F.col("strand") == 0))
    b = hits.filter((F.col("mate") == 3 - forward) & (F.col("strand") == 1))
    near = materialize(align.proper_pairs(a, b, "pair", carry=CARRIED), "proper")
    left, right = (x.join(near.select("pair"), "pair", "left_anti") for x in (a, b))
    far = materialize(align.proper_pairs(left, right, "pair", None, CARRIED), "proper")
    lone_a, lone_b = (x.join(far.select("pair"), "pair", "left_anti").filter(F.col("err") < align.MAX_PAIR_ERROR) for x in (left, right))
    turned = mates.filter((F.col("mate") == 3 - forward) & (F.col("strand") == 1)).select("pair", "seq")
    plain = mates.filter((F.col("mate") == forward) & (F.col("strand") == 0)).select("pair", "seq")
    found_b = align.rescue(lone_a, turned, targets, "pair", most=most).withColumn("strand", F.lit(1))
    found_a = align.rescue(lone_b, plain, targets, "pair", most=most).withColumn("strand", F.lit(0))
    one = align.proper_pairs(lone_a, found_b, "pair", carry=CARRIED)
    two = align.proper_pairs(found_a, lone_b, "pair", carry=CARRIED)
    every = near.unionByName(far).unionByName(one).unionByName(two).withColumn("err", F.col("err1") + F.col("err2"))
    return align.best(every, ["pair"]).withColumn("forward", F.lit(forward))


def _mates(pairs: DataFrame) -> DataFrame:
    both = F.array(*[F.struct(F.lit(m).alias("mate"), F.col(f"seq{m}").alias("seq")) for m in (1, 2)])
    return pairs.select("pair", F.explode(both).alias("x")).select("pair", "x.mate", "x.seq").filter("seq IS NOT NULL")


def align_pairs(pairs: DataFrame, index: dict[str, DataFrame], k: int = K) -> dict[str, DataFrame]:
    """``hits`` of single mates, ``proper`` pairs and the ``outcomes`` of all pairs.

    ``pairs``: ``pair``, ``seq1``, ``seq2``.
    """
    targets, postings = index["transcripts"], index["postings"]
    mates = _mates(pairs)
    most = align.longest(mates)
    hits = materialize(align.map_reads(mates, targets, postings, ["pair", "mate"], k, per_strand=True, mate="mate"), "hits")
    both = kmers.both_strands(mates)
    proper = materialize(_orientation(hits, both, targets, 1, most).unionByName(_orientation(hits, both, targets, 2, most)), "proper")
    slot = {"a0": (1, 0), "a1": (2, 1), "b0": (2, 0), "b1": (1, 1)}
    flags = [F.coalesce(F.max((F.col("mate") == m) & (F.col("strand") == s)), F.lit(False)).alias(n) for n, (m, s) in slot.items()]
    errs = [F.coalesce(F.min(F.when((F.col("mate") == m) & (F.col("strand") == s), F.col("err"))), F.lit(1000)).alias(f"e_{n}") for n, (m, s) in slot.items()]
    seen = pairs.select("pair").join(hits.groupBy("pair").agg(*flags, *errs), "pair", "left").na.fill(False, list(slot)).na.fill(1000, [f"e_{n}" for n in slot])
    won = proper.groupBy("pair").agg(F.min(F.when(F.col("forward") == 1, F.col("err"))).alias("pa"), F.min(F.when(F.col("forward") == 2, F.col("err"))).alias("pb"))
    ready = seen.join(won, "pair", "left").select(
        "pair", *slot, F.col("pa").isNotNull().alias("a_proper"), F.col("pb").isNotNull().alias("b_proper"), F.coalesce("pa", F.col("e_a0") + F.col("e_a1")).alias("err_a"), F.coalesce("pb", F.col("e_b0") + F.col("e_b1")).alias("err_b"), F.lit(True).alias("a_tx"), F.lit(True).alias("b_tx")
    )
    return {"hits": hits, "proper": proper, "outcomes": materialize(align.decide(ready), "outcomes")}


def genome_postings(contigs: DataFrame, most: int = MAX_FIND) -> DataFrame:
    """K-mer postings of the contigs; k-mers with more than ``most`` (the reference's bound) don't seed."""
    return kmers.without_frequent(kmers.postings(contigs), most)


def genome_hits(reads: DataFrame, contigs: DataFrame, postings: DataFrame, key: list[str], k: int = K, **how) -> DataFrame:
    """``map_reads`` on contigs, with ends that stand beyond an intron joined to their hit by ``N``."""
    hits = materialize(align.map_reads(reads, contigs, postings, key, k, **how), "genome")
    split = align.introns(hits, kmers.both_strands(reads), contigs, postings, key, k)
    side = split.groupBy(*key, "strand", "tid", "pos").agg(*[F.min(F.when(F.col("side") == s, F.struct("gap", "seg_len", "split_pos"))).alias(s) for s in ("start", "end")])
    return align.with_introns(hits.join(side, [*key, "strand", "tid", "pos"], "left"))


def genome_fallback(pairs: DataFrame, found: dict[str, DataFrame], contigs: DataFrame, k: int = K, postings: DataFrame | None = None) -> DataFrame:
    """Proper pairs on the genome of those pairs that have none on the transcriptome.

    ``contigs``: ``tid`` (the contig's number) and ``seq``. The same operators
    run on k-mer postings of the contigs (``postings``, if they are saved). Such pairs aren't counted in classes.
    """
    rest = pairs.join(found["outcomes"].filter(F.col("outcome").startswith("proper")).select("pair"), "pair", "left_anti")
    postings = genome_postings(contigs) if postings is None else postings
    hits = genome_hits(_mates(rest), contigs, postings, ["pair", "mate"], k, per_strand=True, mate="mate")
    ways = None
    for forward in (1, 2):
        a = hits.filter((F.col("mate") == forward) & (F.col("strand") == 0))
        b = hits.filter((F.col("mate") == 3 - forward) & (F.col("strand") == 1))
        one = align.proper_pairs(a, b, "pair", GENOME_FRAGMENT, CARRIED).withColumn("forward", F.lit(forward))
        ways = one if ways is None else ways.unionByName(one)
    return align.best(ways.withColumn("err", F.col("err1") + F.col("err2")), ["pair"])


def pair_classes(found: dict[str, DataFrame]) -> DataFrame:
    """Classes of the counted pairs; where both orientations tie, the union of their targets."""
    best = align.best(found["proper"], ["pair"])
    return quant.classes(best.select("pair", "tid", "err"), "pair", "tid", "err")


def _grouped(rows: DataFrame, key: list[str], index: dict[str, DataFrame]) -> DataFrame:
    """One row of each group of neighbouring targets (in order of tid) whose genes are one or overlap: ``groups`` and ``primary``."""
    genes = index["genes"]
    placed = {"chr", "start", "end"} <= set(genes.columns)
    g = genes.select("gene_id", *([F.col(c).alias(f"__{c}") for c in ("chr", "start", "end")] if placed else []))
    t = index["transcripts"].select("tid", "gene_id").join(g, "gene_id", "left")
    w = Window.partitionBy(*key).orderBy("tid", "pos1", "pos2", "forward")

    def before(c):
        return F.lag(c).over(w)

    same = F.col("gene_id") == before("gene_id")
    if placed:
        same = same | ((F.col("__chr") == before("__chr")) & (F.col("__start") < before("__end")) & (before("__start") < F.col("__end")))
    marked = rows.join(t, "tid", "left").withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    firsts = marked.filter("__new = 1").drop("gene_id", "__new", *[f"__{c}" for c in ("chr", "start", "end")])
    order = Window.partitionBy(*key).orderBy("err", "tid", "pos1", "pos2", "forward")
    return firsts.withColumn("groups", F.count(F.lit(1)).over(Window.partitionBy(*key))).withColumn("primary", F.row_number().over(order) == 1)


def _one_place(hits: DataFrame, slot: tuple[int, int], key: str = "pair") -> DataFrame:
    """The first of the best hits of a mate on a strand: ``place``."""
    m, s = slot
    own = hits.filter((F.col("mate") == m) & (F.col("strand") == s))
    return own.groupBy(key).agg(F.min(F.struct("err", "tid", "pos", "strand", "cigar")).alias("place"))


SLOTS = {"improper_a": ((1, 0), (2, 1)), "improper_b": ((1, 1), (2, 0)), "both_forward": ((1, 0), (2, 0)), "both_reverse": ((1, 1), (2, 1)), "single_a0": ((1, 0), None), "single_a1": (None, (2, 1)), "single_b0": (None, (2, 0)), "single_b1": ((1, 1), None)}


def _placed_pairs(found: dict[str, DataFrame], index: dict[str, DataFrame]) -> DataFrame:
    """Every pair's rows: ``pair``, ``proper``, ``groups``, ``primary``, ``on_genome`` and for both mates tid, pos, strand and cigar, null if it has no place."""
    outcomes = found["outcomes"].select("pair", "outcome")
    won = found["proper"].join(outcomes.filter(F.col("outcome").startswith("proper")), "pair")
    kept = won.filter((F.col("outcome") == "proper_both") | ((F.col("outcome") == "proper_a") & (F.col("forward") == 1)) | ((F.col("outcome") == "proper_b") & (F.col("forward") == 2)))
    grouped = _grouped(kept.drop("outcome"), ["pair"], index).withColumn("on_genome", F.lit(False))
    if "genome_pairs" in found:
        w = Window.partitionBy("pair").orderBy("err", "tid", "pos1", "pos2", "forward")
        g = found["genome_pairs"].withColumn("groups", F.count(F.lit(1)).over(Window.partitionBy("pair"))).withColumn("primary", F.row_number().over(w) == 1)
        grouped = grouped.unionByName(g.withColumn("on_genome", F.lit(True)).select(grouped.columns))
    grouped = materialize(grouped, "grouped")

    def side(m):
        """Mate ``m``: the first of the row if it is the forward one, else the second."""
        own = F.col("forward") == m
        return [F.when(own, F.col(f"{c}1" if c != "tid" else "tid")).otherwise(F.col(f"{c}2" if c != "tid" else "tid")).alias(f"{c}_{m}") for c in ("tid", "pos", "strand", "cigar")]

    rows = grouped.select("pair", F.lit(True).alias("proper"), "groups", "primary", "on_genome", *side(1), *side(2))
    rest = materialize(outcomes.join(grouped.select("pair").distinct(), "pair", "left_anti"), "improper")
    places = {slot: _one_place(found["hits"], slot).withColumnRenamed("place", f"p{slot[0]}{slot[1]}") for pair in SLOTS.values() for slot in pair if slot}
    for p in places.values():
        rest = rest.join(p, "pair", "left")
    chosen = []
    for m in (1, 2):
        pick = F.lit(None)
        for name, slots in SLOTS.items():
            if slots[m - 1]:
                pick = F.when(F.col("outcome") == name, F.col(f"p{m}{slots[m - 1][1]}")).otherwise(pick)
        chosen.append(pick.alias(f"x{m}"))
    rest = rest.select("pair", *chosen)
    return rows.unionByName(
        rest.select("pair", F.lit(False).alias("proper"), F.lit(1).cast("long").alias("groups"), F.lit(True).alias("primary"), F.lit(False).alias("on_genome"), *[F.col(f"x{m}.{c}").alias(f"{c}_{m}") for m in (1, 2) for c in ("tid", "pos", "strand", "cigar")])
    )


def _on_references(rows: DataFrame, key: list[str], index: dict[str, DataFrame], lifted: bool) -> DataFrame:
    """Places with ``rname``: on transcripts, or lifted through their exons to the genome; those found on the genome keep theirs."""
    names = index["transcripts"].select("tid", F.col("name").alias("rname"))
    on_tx = rows.filter("NOT on_genome")
    if lifted:
        chroms = index["chroms"].select("chr_id", F.col("name").alias("rname"))
        up = intervals.lift_alignments(on_tx, index["exons"], [*key, "pos"])
        moved = up.join(chroms, "chr_id").select(*key, "tid", "pos", "rname", F.col("genome_pos").cast("int").alias("place"), F.col("genome_cigar").alias("gcigar"))
        out = on_tx.join(moved, [*key, "tid", "pos"]).drop("cigar", "pos").withColumnsRenamed({"place": "pos", "gcigar": "cigar"})
    else:
        out = on_tx.join(names, "tid")
    if "contigs" not in index:
        return out
    contigs = index["contigs"].select("tid", F.col("name").alias("rname"))
    return out.unionByName(rows.filter("on_genome").join(contigs, "tid").select(out.columns))


def sam_records(pairs: DataFrame, found: dict[str, DataFrame], index: dict[str, DataFrame], lifted: bool = False) -> DataFrame:
    """SAM rows of all pairs, by their outcome.

    * Proper pairs: the best place is primary, and one secondary pair for each
      further group of overlapping genes; MAPQ from the number of groups.
    * Discordant pairs and pairs on one strand: the first of each mate's best hits, not proper.
    * Single mates: the mate with a hit; the other is unmapped.
    * Pairs without a hit: two unmapped rows.

    NM, MD and AS come from the CIGAR, so they always agree. ``lifted``: places
    on the genome, with ``N`` for introns. ``pairs`` needs ``name``, ``qual1`` and ``qual2`` too.
    """
    placed = _placed_pairs(found, index).withColumn("row", F.monotonically_increasing_id())
    placed = materialize(placed, "placed")
    sides = [placed.select("pair", "row", "proper", "groups", "primary", "on_genome", F.lit(m).alias("mate"), *[F.col(f"{c}_{m}").alias(c) for c in ("tid", "pos", "strand", "cigar")]) for m in (1, 2)]
    one = sides[0].unionByName(sides[1])
    mapped = materialize(_on_references(one.filter("tid IS NOT NULL"), ["row", "mate"], index, lifted).select("row", "mate", "rname", "pos", "cigar", "strand"), "mates")
    every = one.select("pair", "row", "mate", "proper", "groups", "primary").join(mapped, ["row", "mate"], "left")
    other = mapped.select("row", (3 - F.col("mate")).alias("mate"), F.col("rname").alias("mate_rname"), F.col("pos").alias("mate_pos"), F.col("strand").alias("mate_strand"), sam.reference_length(F.col("cigar")).alias("mate_span"))
    reads = pairs.select("pair", strip_mate(first_token(F.col("name"))).alias("qname"), F.explode(F.array(*[F.struct(F.lit(m).alias("mate"), F.col(f"seq{m}").alias("seq"), F.col(f"qual{m}").alias("qual")) for m in (1, 2)])).alias("x")).select("pair", "qname", "x.*")
    full = every.join(other, ["row", "mate"], "left").join(reads, ["pair", "mate"])
    first = F.col("mate") == 1
    own, theirs = F.col("rname").isNotNull(), F.col("mate_rname").isNotNull()
    rev, mate_rev = F.col("strand") == 1, F.col("mate_strand") == 1
    same = F.col("rname") == F.col("mate_rname")
    span = sam.reference_length(F.col("cigar"))
    low = F.least("pos", "mate_pos")
    reach = F.greatest(F.col("pos") + span, F.col("mate_pos") + F.col("mate_span")) - low
    leads = (F.col("pos") < F.col("mate_pos")) | ((F.col("pos") == F.col("mate_pos")) & first)
    return full.select(
        "qname", sam.flag(paired=F.lit(True), proper=F.col("proper"), unmapped=~own, mate_unmapped=~theirs, reverse=rev, mate_reverse=mate_rev, first=first, last=~first, secondary=~F.col("primary")).alias("flag"),
        *_fields(own, rev, F.col("groups")), F.when(same, "=").otherwise(F.coalesce("mate_rname", F.lit("*"))).alias("rnext"), (F.coalesce("mate_pos", F.lit(-1)) + 1).alias("pnext"),
        F.when(same, F.when(leads, reach).otherwise(-reach)).otherwise(0).cast("int").alias("tlen"), *_bases(rev), *_tags(own),
    ).select(*SAM_COLUMNS)


SAM_COLUMNS = [c.split()[0] for c in bam.SCHEMA.split(", ")]


def _fields(own, rev, groups) -> list:
    cigar = sam.cigar_text(sam.normalised(F.col("cigar")))
    return [F.coalesce("rname", F.lit("*")).alias("rname"), (F.coalesce("pos", F.lit(-1)) + 1).alias("pos"), F.when(own, sam.mapq(groups)).otherwise(0).alias("mapq"), F.when(own, cigar).otherwise("*").alias("cigar")]


def _bases(rev) -> list:
    return [F.when(rev, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(rev, F.reverse("qual")).otherwise(F.col("qual")).alias("qual")]


def _tags(own) -> list:
    c = F.col("cigar")
    return [F.when(own, sam.edit_count(c)).cast("int").alias("nm"), F.when(own, sam.md_text(c)).alias("md"), F.when(own, sam.match_count(c)).cast("int").alias("score")]


def single_records(reads: DataFrame, hits: DataFrame, index: dict[str, DataFrame], lifted: bool = False, genome: DataFrame | None = None) -> DataFrame:
    """SAM rows of single reads: the best place, one secondary row for each further group of overlapping genes, unmapped reads.

    ``reads``: ``read``, ``name``, ``seq``, ``qual``; ``genome``: hits on contigs of reads without another.
    """
    cols = ["read", "tid", "pos", "strand", "err", "cigar"]
    rows = hits.select(*cols, F.col("pos").alias("pos1"), F.lit(0).alias("pos2"), F.lit(1).alias("forward"))
    grouped = _grouped(rows, ["read"], index).select(*cols, "groups", "primary", F.lit(False).alias("on_genome"))
    if genome is not None:
        order = Window.partitionBy("read").orderBy("err", "tid", "pos", "strand")
        g = genome.select(*cols).withColumn("groups", F.count(F.lit(1)).over(Window.partitionBy("read"))).withColumn("primary", F.row_number().over(order) == 1)
        grouped = grouped.unionByName(g.withColumn("on_genome", F.lit(True)).select(grouped.columns))
    grouped = materialize(grouped.withColumn("row", F.monotonically_increasing_id()), "grouped")
    placed = _on_references(grouped, ["row"], index, lifted)
    full = reads.select("read", strip_mate(first_token(F.col("name"))).alias("qname"), "seq", "qual").join(placed.select("read", "rname", "pos", "cigar", "strand", "groups", "primary"), "read", "left")
    own, rev = F.col("rname").isNotNull(), F.col("strand") == 1
    return full.select(
        "qname", sam.flag(unmapped=~own, reverse=rev, secondary=own & ~F.col("primary")).alias("flag"), *_fields(own, rev, F.col("groups")), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), *_bases(rev), *_tags(own),
    ).select(*SAM_COLUMNS)


def _contigs(spark: SparkSession, index: dict[str, DataFrame], genome: str | None) -> dict[str, DataFrame]:
    """The index with ``contigs`` and their postings: saved ones, or those of a FASTA file."""
    if genome:
        contigs = annotation.genome(spark, genome).select(F.col("chr_id").alias("tid"), "name", F.col("len").cast("int").alias("len"), F.upper("seq").alias("seq"))
        return index | {"contigs": contigs, "contig_postings": genome_postings(contigs)}
    return index


def _references(index: dict[str, DataFrame], lifted: bool) -> list[tuple[str, int]]:
    """Names and lengths for a BAM header: chromosomes, or transcripts and the contigs that are searched too."""
    tables_ = [index["chroms"].select(F.col("chr_id").alias("tid"), "name", "len")] if lifted else [index["transcripts"].select("tid", "name", "len")] + ([index["contigs"].select("tid", "name", "len")] if "contigs" in index else [])
    return [(r.name, int(r.len)) for t in tables_ for r in t.orderBy("tid").collect()]


def quantify_pairs(spark: SparkSession, index: dict[str, DataFrame], left: list[str], right: list[str], out: str, bootstraps: int = 0, bam_path: str | None = None, level: int = -1, seed: int = 0, genome: str | None = None, prefix: str = "", on_transcripts: bool = False) -> dict[str, DataFrame]:
    """Quantifies paired reads; writes the abundance and gene tables and, if asked, replicates and a BAM file.

    With ``genome`` (FASTA), or an index that holds one, pairs without a proper place on the transcriptome
    are looked for there (``genome_pairs`` of the result). ``unpaired`` of the
    result counts the pairs that are left out as malformed or without a mate.
    The BAM file is on the genome where the index knows the exons, unless it should be ``on_transcripts``.
    """
    both = materialize(read_source.zipped(spark, left, right), "zipped")
    sound = both.filter("problem1 IS NULL AND problem2 IS NULL").withColumn("pair", F.col("lane").cast("long") * (1 << 40) + F.col("ordinal"))
    pairs = materialize(sound.select("pair", F.col("name1").alias("name"), "seq1", "qual1", "seq2", "qual2"), "pairs")
    index = _contigs(spark, index, genome)
    found = align_pairs(pairs, index)
    cls = materialize(pair_classes(found), "classes")
    dist = found["proper"].groupBy("pair").agg(F.min("dist").alias("d")).agg(F.avg("d")).first()[0] or 0.0
    mean_len = pairs.agg(F.avg((F.length("seq1") + F.length("seq2")) / 2)).first()[0] or 0.0
    if "contigs" in index:
        found["genome_pairs"] = materialize(genome_fallback(pairs, found, index["contigs"], postings=index["contig_postings"]), "genome_pairs")
    lifted = not on_transcripts and {"exons", "chroms"} <= set(index)
    records = sam_records(pairs, found, index, lifted)
    if bam_path:
        bam.write_bam(records, bam_path, _references(index, lifted), level)
    done = _finish(spark, index, cls, dist + mean_len, mean_len, out, bootstraps, seed, prefix)
    return done | found | {"summary": align.mapping_summary(found["outcomes"]), "unpaired": read_source.unpaired(both), "sam": records}


def quantify_single(spark: SparkSession, index: dict[str, DataFrame], paths: list[str], out: str, bootstraps: int = 0, bam_path: str | None = None, level: int = -1, seed: int = 0, genome: str | None = None, prefix: str = "", on_transcripts: bool = False) -> dict[str, DataFrame]:
    """Quantifies single reads: the strand with fewer errors wins, ties count together."""
    lanes = None
    for lane, p in enumerate(paths, 1):
        x = read_source.with_ordinals(read_source.scan(spark, p)).filter("ordinal IS NOT NULL")
        x = read_source.sound(x).select((F.lit(lane).cast("long") * (1 << 40) + F.col("ordinal")).alias("read"), "name", F.upper("seq").alias("seq"), fake_quality(F.col("seq"), F.col("qual")).alias("qual"))
        lanes = x if lanes is None else lanes.unionByName(x)
    reads = materialize(lanes, "reads")
    index = _contigs(spark, index, genome)
    hits = materialize(align.map_reads(reads.select("read", "seq"), index["transcripts"], index["postings"], ["read"]), "hits")
    cls = materialize(quant.classes(hits, "read", "tid", "err"), "classes")
    mean_len = reads.agg(F.avg(F.length("seq"))).first()[0] or 0.0
    more = None
    if "contigs" in index:
        rest = reads.select("read", "seq").join(hits.select("read").distinct(), "read", "left_anti")
        more = materialize(genome_hits(rest, index["contigs"], index["contig_postings"], ["read"]), "genome")
    lifted = not on_transcripts and {"exons", "chroms"} <= set(index)
    records = single_records(reads, hits, index, lifted, more)
    if bam_path:
        bam.write_bam(records, bam_path, _references(index, lifted), level)
    mapped = hits.select("read").distinct()
    summary = reads.join(mapped.withColumn("hit", F.lit(True)), "read", "left").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("mapped"))
    summary = summary.select("total", "mapped", (F.col("total") - F.col("mapped")).alias("unmapped"), (F.col("mapped") / F.greatest("total", F.lit(1))).alias("mapped_ratio"))
    return _finish(spark, index, cls, mean_len, mean_len, out, bootstraps, seed, prefix) | {"hits": hits, "summary": summary, "sam": records}


def _finish(spark, index, cls, mean, mean_read, out, bootstraps, seed, prefix="") -> dict[str, DataFrame]:
    targets = index["transcripts"].select("tid", "name", "gene_id", "len")
    ab = materialize(quant.abundance(targets.select("tid", "len"), cls, mean), "abundance").join(targets.select("tid", F.col("name").alias("target_id"), "gene_id"), "tid")
    base = f"{out}/{prefix}"
    tables.write_abundance(ab, f"{base}abundance.tsv")
    genes = quant.gene_rollup(ab, index["genes"].select("gene_id", F.col("ensembl_id"), F.col("name").alias("gene_name")))
    tables.write_genes(genes.select(F.col("ensembl_id").alias("gene_id"), "gene_name", "est_counts", "tpm"), f"{base}abundance.gene.tsv")
    if bootstraps:
        reps = materialize(quant.bootstrap(targets.select("tid", "len"), cls, bootstraps, seed), "replicates")
        aux = {"num_bootstrap": bootstraps, "mean_fragment_length": mean, "mean_read_length": mean_read, "index_version": tables.INDEX_VERSION, "start_time": datetime.datetime.now(datetime.timezone.utc).isoformat()}
        tables.write_bootstrap(reps, aux, f"{base}bootstrap")
        if tables.has_hdf5() and "://" not in out:
            tables.write_bootstrap_hdf5(ab, reps, aux, f"{base}abundance.h5")
    return {"abundance": ab, "genes": genes, "classes": cls}
