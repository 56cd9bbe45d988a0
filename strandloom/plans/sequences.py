"""Queries over sequences: bases, k-mers, seeds, chains and hits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.operators import align, graph, intervals, kmers
from strandloom.runtime import materialize, read_table


def _transcripts(spark, sf):
    return read_table(spark, sf, "transcripts").select("tid", "gene_id", "chr_id", "len", F.upper("seq").alias("seq"))


def _reads(spark, sf):
    """Sound reads, once each: re-delivered rows agree but for their load time."""
    rows = read_table(spark, sf, "reads").filter("seq IS NOT NULL").select("read_id", F.upper("seq").alias("seq"))
    return rows.distinct()


def base_codes(spark, sf):
    t = _transcripts(spark, sf)
    return t.select("tid", S.codes(F.col("seq")).alias("codes"), S.reverse_complement(F.col("seq")).alias("revcomp"))


def reverse_quality(spark, sf):
    r = read_table(spark, sf, "reads").filter("seq IS NOT NULL").select("read_id", "seq", "qual").distinct()
    q = S.fake_quality(F.col("seq"), F.col("qual"))
    return r.select("read_id", q.alias("qual"), F.reverse(q).alias("rev_qual"), S.reverse_complement(F.col("seq")).alias("rev_seq"))


def read_filters(spark, sf):
    """Reads by run and lane: all, with name and sequence, long enough for a seed."""
    r = read_table(spark, sf, "reads").select("read_id", "run_id", "lane", "name", F.length("seq").alias("n")).distinct()
    named = F.col("name").isNotNull() & F.col("n").isNotNull()
    return r.groupBy("run_id", "lane").agg(F.count(F.lit(1)).alias("n_reads"), F.count_if(named).alias("n_named"), F.count_if(named & (F.col("n") >= S.K)).alias("n_seedable"))


def kmer_pack(spark, sf):
    """Number of k-mers of each transcript, their smallest and largest code and the exclusive or of all."""
    k = kmers.kmers(_transcripts(spark, sf), ["tid"], "seq")
    return k.groupBy("tid").agg(F.count(F.lit(1)).alias("n_kmers"), F.min("kmer").alias("low"), F.max("kmer").alias("high"), F.bit_xor("kmer").alias("mixed"))


def kmer_unpack(spark, sf):
    """The smallest k-mer of each transcript as text, and its reverse complement's code."""
    low = kmer_pack(spark, sf).select("tid", "low")
    return low.select("tid", S.kmer_text(F.col("low")).alias("kmer"), S.reverse_code(F.col("low")).alias("rev_code"))


def kmer_index(spark, sf):
    """How many k-mers have so many postings on so many transcripts, and the exclusive or of their codes."""
    f = kmers.frequencies(kmers.postings(_transcripts(spark, sf)))
    return f.groupBy("n_postings", "n_targets").agg(F.count(F.lit(1)).alias("n_kmers"), F.bit_xor("kmer").alias("mixed"))


def kmer_capped(spark, sf):
    """Postings per transcript after each k-mer is held to its first four."""
    return kmers.capped(kmers.postings(_transcripts(spark, sf)), 4).groupBy("tid").agg(F.count(F.lit(1)).alias("n_postings"))


def _hits(spark, sf):
    t = _transcripts(spark, sf)
    reads = kmers.both_strands(_reads(spark, sf).filter(F.length("seq") >= S.K))
    return kmers.seed_hits(reads, kmers.postings(t), ["read_id", "strand"])


def _postings(t):
    """Postings of the targets, written once for the stages that read them."""
    return materialize(kmers.postings(t), "postings")


def seed_join(spark, sf):
    return _hits(spark, sf).groupBy("read_id", "strand", "tid", "diag").agg(F.count(F.lit(1)).alias("n_seeds"))


def _chains(spark, sf):
    return align.chains(_hits(spark, sf), ["read_id", "strand"])


def chain(spark, sf):
    c = _chains(spark, sf)
    return c.select("read_id", "strand", "tid", F.col("chain").cast("int").alias("chain"), "n_seeds", "off", "pos", "last_off", "last_pos")


def best_hit(spark, sf):
    """Targets of most seeds of each read, ties kept."""
    n = _hits(spark, sf).groupBy("read_id", "strand", "tid").agg(F.count(F.lit(1)).alias("n_seeds"))
    return align.best(n.withColumn("lost", -F.col("n_seeds")), ["read_id"], "lost").drop("lost")


def _seeded(spark, sf):
    """Reads by the targets of any of their seeds."""
    return _hits(spark, sf).select("read_id", "tid").distinct()


def mate_guided_semi(spark, sf):
    """Targets of odd reads that the read after them hits too."""
    h = _seeded(spark, sf)
    mates = h.filter("read_id % 2 = 0").select((F.col("read_id") - 1).alias("read_id"), "tid")
    return align.guided(h.filter("read_id % 2 = 1"), mates, ["read_id", "tid"])


def topk_hits(spark, sf):
    """At most two targets of each read, of most seeds first."""
    n = _hits(spark, sf).groupBy("read_id", "tid").agg(F.count(F.lit(1)).alias("n_seeds"))
    return align.first_hits(n, ["read_id"], [F.desc("n_seeds"), "tid"], 2)


def unseeded_anti(spark, sf):
    """Reads that are long enough but hit nothing, by length."""
    r = _reads(spark, sf).filter(F.length("seq") >= S.K)
    return r.join(_seeded(spark, sf), "read_id", "left_anti").groupBy(F.length("seq").alias("len")).agg(F.count(F.lit(1)).alias("n_reads"))


def map_reads(spark, sf):
    """Best alignments of all reads over both strands, by seeds, chains and dynamic programming."""
    t = _transcripts(spark, sf)
    hits = align.map_reads(_reads(spark, sf), t, _postings(t), ["read_id"])
    from strandloom.functions import sam

    return hits.select("read_id", "strand", "tid", "pos", "err", sam.cigar_text(F.col("cigar")).alias("cigar"), sam.md_text(F.col("cigar")).alias("md"), sam.edit_count(F.col("cigar")).alias("nm"))


def map_reads_exact(spark, sf):
    """Reads by the transcripts that ``map_reads`` finds them on without an error."""
    t = _transcripts(spark, sf)
    hits = align.map_reads(_reads(spark, sf), t, _postings(t), ["read_id"])
    return hits.filter("err = 0").select("read_id", "strand", "tid").distinct()


def multi_seed(spark, sf):
    """Chains of at least two seeds, of one in reads of at most two k-mers."""
    c = _chains(spark, sf).join(_reads(spark, sf).select("read_id", F.length("seq").alias("len")), "read_id")
    return align.seeded_enough(c, F.col("len")).select("read_id", "strand", "tid", F.col("chain").cast("int").alias("chain"), "n_seeds", "len")


def bubbles(spark, sf):
    """Edges of the transcripts' graph of 10-mers that stay after parallel paths are reduced to the best covered one."""
    e = materialize(graph.edges(_transcripts(spark, sf), k=10, strands=False), "edges")
    return graph.without_bubbles(e).select(S.kmer_text(F.col("src"), 10).alias("src"), S.kmer_text(F.col("dst"), 10).alias("dst"), "cover")


def unitig_totals(spark, sf):
    """Number of unitigs and of the edges within them."""
    return unitigs(spark, sf).agg(F.count(F.lit(1)).alias("n_contigs"), F.sum(F.col("len") - 30).cast("long").alias("n_links"))


def sw_rescue(spark, sf):
    """The read after each hit read, looked for near the hit by local alignment."""
    t = _transcripts(spark, sf)
    r = _reads(spark, sf)
    hits = align.best(_chains(spark, sf).withColumn("err", -F.col("n_seeds")), ["read_id"]).select(F.col("read_id").alias("pair"), "tid", "pos")
    mates = r.select((F.col("read_id") - 1).alias("pair"), "seq").join(hits.select("pair").distinct(), "pair", "left_semi")
    return align.rescue(hits, mates, t, "pair").select("pair", "tid", "mate_pos", "pos", "err")


def rescue_exact(spark, sf):
    """Hits near which local alignment finds the read after them without an error."""
    return sw_rescue(spark, sf).filter("err = 0").select("pair", "tid", "mate_pos").distinct()


def edit_distance(spark, sf):
    """Edits between the whole sequences of transcripts of one gene."""
    t = _transcripts(spark, sf).select("gene_id", "tid", F.col("seq").alias("s"))
    u = t.select("gene_id", F.col("tid").alias("tid2"), F.col("s").alias("s2"))
    both = t.join(u, "gene_id").filter("tid < tid2").repartition("tid", "tid2")  # genes differ in how many pairs they have
    return both.select("tid", "tid2", F.levenshtein("s", "s2").cast("long").alias("edits"))


def dbg_edges(spark, sf):
    """Cover of the edges of the reads' de Bruijn graph, summed up by how often they stand."""
    e = graph.edges(_reads(spark, sf), k=30)
    return e.groupBy("cover").agg(F.count(F.lit(1)).alias("n_edges"), F.bit_xor("src").alias("sources"), F.bit_xor("dst").alias("targets"))


def dbg_simplified(spark, sf):
    """Edges of the transcripts' graph that stay after weak edges and tips are gone, by out-degree."""
    strong = materialize(graph.without_weak(graph.edges(_transcripts(spark, sf), k=30, strands=False)), "edges")
    e = graph.without_tips(strong)
    d = e.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    return d.groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"), F.bit_xor("src").alias("mixed"))


def unitigs(spark, sf):
    """Unbranched paths of the transcripts' de Bruijn graph."""
    return graph.unitigs(graph.edges(_transcripts(spark, sf), k=30, strands=False)).select("contig", F.length("contig").alias("len"), F.round("cover", 6).alias("cover"))


def fusion_halves(spark, sf):
    """Contigs of each whole transcript and the whole next one: the transcript of most seeds of each half."""
    t = _transcripts(spark, sf)
    a = t.select(F.col("tid").alias("contig"), F.col("seq").alias("x"))
    b = t.select((F.col("tid") - 1).alias("contig"), F.col("seq").alias("y"))
    contigs = a.join(b, "contig").select("contig", F.concat("x", "y").alias("seq"))
    return graph.half_targets(contigs, kmers.postings(t), "contig", "seq", S.K).select("contig", "half", "tid", "n", "first", "last")


def _genome(spark, sf):
    """Transcripts laid out on their chromosomes, 100 bases apart, and the contigs that they make."""
    t = _transcripts(spark, sf).filter("chr_id IS NOT NULL").withColumn("n", F.length("seq"))
    w = Window.partitionBy("chr_id").orderBy("tid").rowsBetween(Window.unboundedPreceding, -1)
    laid = t.withColumn("start", F.coalesce(F.sum(F.col("n") + 100).over(w), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("start", "seq")))
    contigs = laid.groupBy(F.col("chr_id").alias("tid")).agg(F.concat_ws("N" * 100, F.transform(parts, lambda x: x["seq"])).alias("seq"))
    return laid, materialize(contigs, "contigs")


def genome_exact(spark, sf):
    """Reads by the chromosomes that the search on the genome finds them on without an error."""
    _, contigs = _genome(spark, sf)
    hits = align.map_reads(_reads(spark, sf), contigs, kmers.without_frequent(_postings(contigs), 1_000_000), ["read_id"])
    return hits.filter("err = 0").select("read_id", "strand", F.col("tid").alias("chr_id")).distinct()


def fusion_rows(spark, sf):
    """Fusion rows of the contigs of each transcript and the next one, transcripts being laid out on their chromosomes."""
    laid, _ = _genome(spark, sf)
    t = _transcripts(spark, sf)
    both = t.select(F.col("tid").alias("contig"), F.col("seq").alias("x")).join(t.select((F.col("tid") - 1).alias("contig"), F.col("seq").alias("y")), "contig")
    contigs = both.select("contig", F.concat("x", "y").alias("seq"))
    halves = materialize(graph.half_targets(contigs, kmers.postings(t), "contig", "seq", S.K), "halves")
    exons = laid.select("tid", "chr_id", F.lit(0).alias("lo"), F.col("n").alias("hi"), "start")
    genes = read_table(spark, sf, "genes").select("gene_id", "ensembl_id", "strand", "name")
    rows = graph.fusion_rows(halves, contigs, exons, t.select("tid", "gene_id"), genes, "contig")
    return rows.select("contig", "chr_id1", "place1", "ensembl_id1", "strand1", "name1", "chr_id2", "place2", "ensembl_id2", "strand2", "name2", F.length("seq").alias("len"))


def longest_contig(spark, sf):
    """The longest sequence of each gene, of equals the first in order."""
    return graph.longest_contigs(_transcripts(spark, sf).select("gene_id", F.col("seq").alias("contig")), ["gene_id"])


def exon_snap(spark, sf):
    """Places near the borders of transcripts on their gene, moved to borders less than ten bases away."""
    t = _transcripts(spark, sf)
    e = intervals.exon_offsets(t, "gene_id", ["tid"], "len").select(F.col("gene_id").alias("tid"), "lo", "hi")
    p = e.select("tid", (F.col("hi") + F.col("hi") % 17 - 8).alias("pos")).distinct()
    return graph.snap_to_exons(p, e)


_R = "r AS (SELECT DISTINCT read_id, upper(seq) AS seq FROM reads WHERE seq IS NOT NULL)"
_POST = """t AS (SELECT tid, upper(seq) AS seq FROM transcripts),
pk AS (SELECT tid, i::INT AS pos, substr(seq, (i + 1)::INT, 31) AS kmer FROM t, unnest(range(0, length(seq) - 30)) x(i)),
p AS (SELECT tid, pos, kmer FROM pk WHERE NOT regexp_matches(kmer, '[^ACGT]'))"""
_CODE = "list_reduce(list_transform(string_split(translate({0}, 'ACGT', '0123'), ''), lambda c: c::BIGINT), lambda a, c: a * 4 + c)"
_HITS = f"""{_POST}, {_R},
s AS (SELECT read_id, 0 AS strand, seq FROM r WHERE length(seq) >= 31 UNION ALL SELECT read_id, 1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM r WHERE length(seq) >= 31),
o AS (SELECT read_id, strand, seq, unnest(list_distinct(list_append(range(0, length(seq) - 30, 14), length(seq) - 31)))::INT AS off FROM s),
h AS (SELECT read_id, strand, off, tid, pos, pos - off AS diag FROM (SELECT read_id, strand, off, substr(seq, off + 1, 31) AS kmer FROM o) JOIN p USING (kmer))"""
_EDGE = """m AS (SELECT substr(s, i::INT, 31) AS m FROM ({0}), unnest(range(1, length(s) - 29)) x(i)),
e AS (SELECT m[:30] AS src, m[2:] AS dst, count(*) AS cover FROM m WHERE NOT regexp_matches(m, '[^ACGT]') GROUP BY m)"""

QUERIES = {
    "base_codes": (base_codes, "SELECT tid, regexp_replace(translate(upper(seq), 'ACGT', '0123'), '[^0-3]', '4', 'g') AS codes, reverse(translate(upper(seq), 'ACGT', 'TGCA')) AS revcomp FROM transcripts"),
    "reverse_quality": (
        reverse_quality,
        "SELECT DISTINCT read_id, coalesce(qual, repeat('A', length(seq))) AS qual, reverse(coalesce(qual, repeat('A', length(seq)))) AS rev_qual, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) AS rev_seq FROM reads WHERE seq IS NOT NULL",
    ),
    "read_filters": (
        read_filters,
        """SELECT run_id, lane, count(*) AS n_reads, count(*) FILTER (name IS NOT NULL AND n IS NOT NULL) AS n_named, count(*) FILTER (name IS NOT NULL AND n >= 31) AS n_seedable
FROM (SELECT DISTINCT read_id, run_id, lane, name, length(seq) AS n FROM reads) GROUP BY 1, 2""",
    ),
    "kmer_pack": (kmer_pack, f"WITH {_POST}, c AS (SELECT tid, {_CODE.format('kmer')} AS code FROM p) SELECT tid, count(*) AS n_kmers, min(code) AS low, max(code) AS high, bit_xor(code) AS mixed FROM c GROUP BY 1"),
    "kmer_unpack": (
        kmer_unpack,
        f"WITH {_POST}, c AS (SELECT tid, min(kmer) AS kmer FROM p GROUP BY 1) SELECT tid, kmer, {_CODE.format(chr(34) + 'rc' + chr(34))} AS rev_code FROM (SELECT tid, kmer, reverse(translate(kmer, 'ACGT', 'TGCA')) AS rc FROM c)",
    ),
    "kmer_index": (kmer_index, f"WITH {_POST}, f AS (SELECT kmer, count(*) AS n_postings, count(DISTINCT tid) AS n_targets FROM p GROUP BY 1) SELECT n_postings::BIGINT AS n_postings, n_targets, count(*) AS n_kmers, bit_xor({_CODE.format('kmer')}) AS mixed FROM f GROUP BY 1, 2"),
    "kmer_capped": (kmer_capped, f"WITH {_POST}, k AS (SELECT tid, row_number() OVER (PARTITION BY kmer ORDER BY tid, pos) AS n FROM p) SELECT tid, count(*) AS n_postings FROM k WHERE n <= 4 GROUP BY 1"),
    "seed_join": (seed_join, f"WITH {_HITS} SELECT read_id, strand, tid, diag, count(*) AS n_seeds FROM h GROUP BY ALL"),
    "chain": (
        chain,
        f"""WITH {_HITS},
b AS (SELECT *, CASE WHEN lag(off) OVER w IS NULL OR off <= lag(off) OVER w OR abs(diag - lag(diag) OVER w) > 7 THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY read_id, strand, tid ORDER BY pos, off)),
g AS (SELECT *, sum(new) OVER (PARTITION BY read_id, strand, tid ORDER BY pos, off ROWS UNBOUNDED PRECEDING)::INT AS chain FROM b)
SELECT read_id, strand, tid, chain, count(*) AS n_seeds, min(off) AS off, min(pos) AS pos, max(off) AS last_off, max(pos) AS last_pos FROM g GROUP BY read_id, strand, tid, chain""",
    ),
    "best_hit": (
        best_hit,
        f"WITH {_HITS}, n AS (SELECT read_id, strand, tid, count(*) AS n_seeds FROM h GROUP BY ALL) SELECT read_id, strand, tid, n_seeds FROM n QUALIFY rank() OVER (PARTITION BY read_id ORDER BY n_seeds DESC) = 1",
    ),
    "mate_guided_semi": (
        mate_guided_semi,
        f"WITH {_HITS}, d AS (SELECT DISTINCT read_id, tid FROM h) SELECT read_id, tid FROM d WHERE read_id % 2 = 1 AND EXISTS (SELECT 1 FROM d m WHERE m.read_id = d.read_id + 1 AND m.tid = d.tid)",
    ),
    "topk_hits": (
        topk_hits,
        f"WITH {_HITS}, n AS (SELECT read_id, tid, count(*) AS n_seeds FROM h GROUP BY ALL) SELECT read_id, tid, n_seeds FROM n QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY n_seeds DESC, tid) <= 2",
    ),
    "unseeded_anti": (
        unseeded_anti,
        f"WITH {_HITS} SELECT length(seq)::INT AS len, count(*) AS n_reads FROM r WHERE length(seq) >= 31 AND read_id NOT IN (SELECT read_id FROM h) GROUP BY 1",
    ),
    "map_reads": (map_reads, None),
    "map_reads_exact": (
        map_reads_exact,
        f"""WITH {_HITS} SELECT DISTINCT s.read_id, s.strand, p.tid FROM s JOIN p ON p.kmer = left(s.seq, 31) JOIN t ON t.tid = p.tid AND substr(t.seq, p.pos + 1, length(s.seq)) = s.seq""",
    ),
    "multi_seed": (
        multi_seed,
        f"""WITH {_HITS},
b AS (SELECT *, CASE WHEN lag(off) OVER w IS NULL OR off <= lag(off) OVER w OR abs(diag - lag(diag) OVER w) > 7 THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY read_id, strand, tid ORDER BY pos, off)),
g AS (SELECT *, sum(new) OVER (PARTITION BY read_id, strand, tid ORDER BY pos, off ROWS UNBOUNDED PRECEDING)::INT AS chain FROM b),
n AS (SELECT read_id, strand, tid, chain, count(*) AS n_seeds FROM g GROUP BY ALL)
SELECT n.*, length(r.seq) AS len FROM n JOIN r USING (read_id) WHERE n_seeds >= 2 OR floor(length(r.seq) / 31) <= 2""",
    ),
    "sw_rescue": (sw_rescue, None),
    "rescue_exact": (
        rescue_exact,
        f"""WITH {_HITS},
b AS (SELECT *, CASE WHEN lag(off) OVER w IS NULL OR off <= lag(off) OVER w OR abs(diag - lag(diag) OVER w) > 7 THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY read_id, strand, tid ORDER BY pos, off)),
g AS (SELECT *, sum(new) OVER (PARTITION BY read_id, strand, tid ORDER BY pos, off ROWS UNBOUNDED PRECEDING)::INT AS chain FROM b),
n AS (SELECT read_id, strand, tid, chain, count(*) AS n_seeds, min(pos) AS pos FROM g GROUP BY read_id, strand, tid, chain QUALIFY rank() OVER (PARTITION BY read_id ORDER BY count(*) DESC) = 1)
SELECT DISTINCT n.read_id AS pair, n.tid, n.pos AS mate_pos FROM n JOIN r ON r.read_id = n.read_id + 1 JOIN t ON t.tid = n.tid WHERE length(r.seq) > 0 AND contains(substr(t.seq, greatest(n.pos - 1000, 0) + 1, 2000 + length(r.seq)), r.seq)""",
    ),
    "edit_distance": (
        edit_distance,
        "SELECT a.tid, b.tid AS tid2, levenshtein(upper(a.seq), upper(b.seq)) AS edits FROM transcripts a JOIN transcripts b ON a.gene_id = b.gene_id AND a.tid < b.tid",
    ),
    "dbg_edges": (
        dbg_edges,
        f"WITH {_R}, {_EDGE.format('SELECT seq AS s FROM r UNION ALL SELECT reverse(translate(seq, ' + repr('ACGT') + ', ' + repr('TGCA') + ')) FROM r')} SELECT cover, count(*) AS n_edges, bit_xor({_CODE.format('src')}) AS sources, bit_xor({_CODE.format('dst')}) AS targets FROM e GROUP BY 1",
    ),
    "dbg_simplified": (
        dbg_simplified,
        f"""WITH {_EDGE.format('SELECT upper(seq) AS s FROM transcripts')},
w AS (SELECT src, dst, cover FROM (SELECT *, max(cover) OVER (PARTITION BY src) AS a, max(cover) OVER (PARTITION BY dst) AS b FROM e) WHERE cover >= 0.2 * a AND cover >= 0.2 * b),
x AS (SELECT src, dst FROM w WHERE cover <= 1 AND ((dst NOT IN (SELECT src FROM w) AND src IN (SELECT src FROM w GROUP BY 1 HAVING count(*) > 1))
  OR (src NOT IN (SELECT dst FROM w) AND dst IN (SELECT dst FROM w GROUP BY 1 HAVING count(*) > 1)))),
k AS (SELECT src, count(*) AS degree FROM w ANTI JOIN x USING (src, dst) GROUP BY 1)
SELECT degree, count(*) AS n_nodes, bit_xor({_CODE.format('src')}) AS mixed FROM k GROUP BY 1""",
    ),
    "unitigs": (unitigs, None),
    "fusion_halves": (
        fusion_halves,
        f"""WITH {_POST}, c AS (SELECT a.tid AS contig, a.seq || b.seq AS seq, (length(a.seq) + length(b.seq)) // 2 AS h FROM t a JOIN t b ON b.tid = a.tid + 1),
hf AS (SELECT contig, 0 AS half, left(seq, h) AS s FROM c UNION ALL SELECT contig, 1, substr(seq, h + 1) FROM c),
n AS (SELECT contig, half, p.tid, count(*) AS n, min(pos) AS first, max(pos) + 31 AS last FROM (SELECT contig, half, substr(s, i::INT, 31) AS kmer FROM hf, unnest(range(1, length(s) - 29)) x(i)) JOIN p USING (kmer) GROUP BY ALL)
SELECT contig, half, tid, n, first, last FROM n QUALIFY row_number() OVER (PARTITION BY contig, half ORDER BY n DESC, tid) = 1""",
    ),
    "fusion_rows": (
        fusion_rows,
        f"""WITH {_POST}, c AS (SELECT a.tid AS contig, a.seq || b.seq AS seq, (length(a.seq) + length(b.seq)) // 2 AS h FROM t a JOIN t b ON b.tid = a.tid + 1),
hf AS (SELECT contig, 0 AS half, left(seq, h) AS s FROM c UNION ALL SELECT contig, 1, substr(seq, h + 1) FROM c),
n AS (SELECT contig, half, p.tid, count(*) AS n, min(pos) AS first, max(pos) + 31 AS last FROM (SELECT contig, half, substr(s, i::INT, 31) AS kmer FROM hf, unnest(range(1, length(s) - 29)) x(i)) JOIN p USING (kmer) GROUP BY ALL),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY contig, half ORDER BY n DESC, tid) = 1),
ld AS (SELECT tid, gene_id, chr_id, length(seq) AS len, coalesce(sum(length(seq) + 100) OVER (PARTITION BY chr_id ORDER BY tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM transcripts WHERE chr_id IS NOT NULL),
q AS (SELECT contig, half, ld.chr_id, ld.gene_id, CASE WHEN half = 0 THEN last ELSE first END AS pos, len, start FROM b JOIN ld USING (tid)),
w AS (SELECT contig, half, chr_id, gene_id, (start + CASE WHEN pos < 10 AND pos <= len - pos THEN 0 WHEN len - pos < 10 THEN len ELSE pos END)::BIGINT AS place FROM q),
g AS (SELECT w.*, ensembl_id, strand, name FROM w JOIN genes USING (gene_id))
SELECT x.contig, x.chr_id AS chr_id1, x.place AS place1, x.ensembl_id AS ensembl_id1, x.strand AS strand1, x.name AS name1, y.chr_id AS chr_id2, y.place AS place2, y.ensembl_id AS ensembl_id2, y.strand AS strand2, y.name AS name2, length(c.seq)::INT AS len
FROM g x JOIN g y ON x.contig = y.contig AND x.half = 0 AND y.half = 1 AND x.gene_id <> y.gene_id JOIN c ON c.contig = x.contig""",
    ),
    "longest_contig": (longest_contig, "SELECT gene_id, upper(seq) AS contig FROM transcripts QUALIFY row_number() OVER (PARTITION BY gene_id ORDER BY length(seq) DESC, upper(seq)) = 1"),
    "genome_exact": (
        genome_exact,
        f"""WITH {_HITS} SELECT DISTINCT s.read_id, s.strand, tr.chr_id FROM s JOIN p ON p.kmer = left(s.seq, 31) JOIN t ON t.tid = p.tid AND substr(t.seq, p.pos + 1, length(s.seq)) = s.seq JOIN transcripts tr ON tr.tid = t.tid WHERE tr.chr_id IS NOT NULL""",
    ),
    "unitig_totals": (
        unitig_totals,
        f"""WITH {_EDGE.format('SELECT upper(seq) AS s FROM transcripts')},
l AS (SELECT src, dst FROM e WHERE src <> dst AND src IN (SELECT src FROM e GROUP BY 1 HAVING count(*) = 1) AND dst IN (SELECT dst FROM e GROUP BY 1 HAVING count(*) = 1))
SELECT (SELECT count(*) FROM l WHERE src NOT IN (SELECT dst FROM l)) AS n_contigs, (SELECT count(*) FROM l)::BIGINT AS n_links""",
    ),
    "bubbles": (
        bubbles,
        r"""WITH m AS (SELECT substr(s, i::INT, 11) AS m FROM (SELECT upper(seq) AS s FROM transcripts), unnest(range(1, length(s) - 9)) x(i)),
e AS (SELECT m[:10] AS src, m[2:] AS dst, count(*) AS cover FROM m WHERE NOT regexp_matches(m, '[^ACGT]') GROUP BY m),
o AS (SELECT src AS m FROM e GROUP BY 1 HAVING count(*) = 1 INTERSECT SELECT dst FROM e GROUP BY 1 HAVING count(*) = 1),
q AS (SELECT a.src AS s, b.dst AS t, a.dst AS m, least(a.cover, b.cover) AS cover FROM e a JOIN e b ON a.dst = b.src JOIN o ON o.m = a.dst),
k AS (SELECT m FROM q QUALIFY row_number() OVER (PARTITION BY s, t ORDER BY cover DESC, m) > 1)
SELECT src, dst, cover FROM e WHERE src NOT IN (SELECT m FROM k) AND dst NOT IN (SELECT m FROM k)""",
    ),
    "exon_snap": (
        exon_snap,
        """WITH e AS (SELECT gene_id AS tid, sum(len) OVER w - len AS lo, sum(len) OVER w AS hi FROM transcripts WINDOW w AS (PARTITION BY gene_id ORDER BY tid)),
p AS (SELECT DISTINCT tid, hi + hi % 17 - 8 AS pos FROM e), b AS (SELECT tid, lo AS border FROM e UNION SELECT tid, hi FROM e),
n AS (SELECT p.tid, pos, border, abs(border - pos) AS d FROM p LEFT JOIN b USING (tid) QUALIFY row_number() OVER (PARTITION BY p.tid, pos ORDER BY d, border) = 1)
SELECT tid, pos::BIGINT AS pos, (CASE WHEN d < 10 THEN border ELSE pos END)::BIGINT AS snapped FROM n""",
    ),
}
