"""Queries through files: tables written in each format and read again, and the index made from a genome and its annotation."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import sam
from strandloom.functions import seq as S
from strandloom.operators import generative, intervals, kmers, quant
from strandloom.runtime import materialize, read_table, shared_dir
from strandloom.sources import annotation, bam, files, tables
from strandloom.sources import reads as R


def _path(spark, label: str) -> str:
    return f"{shared_dir(spark)}/strandloom-{label}-{uuid.uuid4().hex}"


def _sound_reads(spark, sf):
    r = read_table(spark, sf, "reads").filter("name IS NOT NULL AND length(seq) > 0 AND length(qual) = length(seq)")
    return r.select("read_id", "lane", "mate", "name", "seq", "qual").distinct()


def _fastq(rows):
    return rows.select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual").alias("value"))


def gzip_scan(spark, sf):
    """Reads written as gzipped FASTQ and scanned again."""
    path = _path(spark, "gzip")
    _fastq(_sound_reads(spark, sf)).write.option("compression", "gzip").text(path)
    return R.scan(spark, f"{path}/part-*").select("name", "seq", "qual", "problem")


def fasta_scan(spark, sf):
    """Transcripts written as FASTA of several lines each and scanned again in small splits, told by the first byte."""
    path = _path(spark, "fasta")
    lines = F.regexp_replace("seq", "(.{1,70})", "$1\n")
    read_table(spark, sf, "transcripts").select(F.concat(F.lit(">"), "name", F.lit("\n"), F.regexp_replace(lines, "\n$", "")).alias("value")).write.text(path)
    return R.scan(spark, f"{path}/part-*", split=1 << 16).select("name", "seq", "problem")


def _lane_files(spark, sf):
    """One FASTQ file for each lane and mate, in order of read_id."""
    path = _path(spark, "lanes")
    r = _sound_reads(spark, sf).filter("lane IS NOT NULL AND mate IS NOT NULL")
    ordered = r.repartition("lane", "mate").sortWithinPartitions("lane", "mate", "read_id")
    ordered.select("lane", "mate", _fastq_value().alias("value")).write.partitionBy("lane", "mate").text(path)
    return path, sorted(x.lane for x in r.select("lane").distinct().collect())


def _fastq_value():
    return F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual")


def paired_scan(spark, sf):
    """Mates of all lanes, zipped by their number; what has no mate is told."""
    path, lanes = _lane_files(spark, sf)
    both = [files.expand(f"{path}/lane={n}/mate={m}/part-*")[0] for n in lanes for m in (1, 2)]
    z = R.zipped(spark, both[::2], both[1::2])
    lane = F.element_at(F.array(*[F.lit(int(n)) for n in lanes]), F.col("lane"))
    return z.select(lane.alias("lane"), "ordinal", "name1", "name2", F.coalesce("problem1", "problem2").alias("problem"))


def single_scan(spark, sf):
    """Reads of all lanes with the number that each has in its lane and mate."""
    path, lanes = _lane_files(spark, sf)
    df = R.sound(R.with_ordinals(R.scan(spark, f"{path}/lane=*/mate=*/part-*", split=1 << 16)))
    at = [F.regexp_extract("file", f"{k}=(\\d+)", 1).cast("int").alias(k) for k in ("lane", "mate")]
    return df.select(*at, "ordinal", "name", F.upper("seq").alias("seq"))


def _laid_out(spark, sf):
    """Transcripts as the only exon of a gene each, 100 bases apart on their chromosome."""
    t = read_table(spark, sf, "transcripts").filter("chr_id IS NOT NULL").select("tid", "gene_id", "chr_id", F.length("seq").alias("len"), F.upper("seq").alias("seq"))
    w = Window.partitionBy("chr_id").orderBy("tid").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("start", F.coalesce(F.sum(F.col("len") + 100).over(w), F.lit(0)))


def _genome_files(spark, sf):
    """A genome and its annotation: chromosomes of the transcripts with gaps of N between them."""
    t = _laid_out(spark, sf)
    path = _path(spark, "genome")
    parts = F.array_sort(F.collect_list(F.struct("start", "seq")))
    chroms = t.groupBy("chr_id").agg(F.concat_ws("N" * 100, F.transform(parts, lambda x: x["seq"])).alias("seq"))
    chroms.orderBy("chr_id").coalesce(1).select(F.concat(F.lit(">chr"), "chr_id", F.lit(" some text\n"), F.regexp_replace("seq", "(.{1,60})", "$1\n")).alias("value")).write.text(f"{path}/fasta")
    own = F.concat(F.lit('gene_id "T'), "tid", F.lit('"; gene_name "N'), "gene_id", F.lit('"; transcript_id "t'), "tid", F.lit('";'))
    rows = t.withColumn("feature", F.explode(F.array(F.lit("gene"), F.lit("transcript"), F.lit("exon"))))
    rows.select(F.concat_ws("\t", F.concat(F.lit("chr"), "chr_id"), F.lit("x"), "feature", F.col("start") + 1, F.col("start") + F.col("len"), F.lit("."), F.lit("+"), F.lit("."), own).alias("value")).write.text(f"{path}/gtf")
    return files.expand(f"{path}/fasta/part-*")[0], f"{path}/gtf"


def genome_scan(spark, sf):
    """Contigs of a genome in order, with their length and where they begin in the joined genome."""
    fasta, _ = _genome_files(spark, sf)
    c = annotation.genome(spark, fasta)
    return intervals.chromosome_offsets(c.select("chr_id", "name", "len"), "chr_id", "len").select("chr_id", "name", "len", "offset")


def gtf_scan(spark, sf):
    """Features of an annotation with their attributes."""
    _, gtf = _genome_files(spark, sf)
    return annotation.gtf(spark, gtf).select("seqname", "feature", "start", "end", "strand", "gene", "gene_name", "transcript")


def _built(spark, sf):
    from strandloom.plans import pipeline

    fasta, gtf = _genome_files(spark, sf)
    return pipeline.build_index(spark, fasta, gtf, _path(spark, "index"), with_genome=True)


def built_transcripts(spark, sf):
    """Transcripts cut out of the genome by their exons, as the index has them."""
    i = _built(spark, sf)
    g = i["genes"].select("gene_id", "ensembl_id", F.col("name").alias("gene_name"))
    e = i["exons"].groupBy("tid").agg(F.count(F.lit(1)).alias("n_exons"), F.min("start").alias("start"))
    return i["transcripts"].join(g, "gene_id").join(e, "tid").select("name", "ensembl_id", "gene_name", "len", "n_exons", "start", "seq")


def contig_index(spark, sf):
    """Saved postings of contigs: k-mers and their places, counted by contig."""
    i = _built(spark, sf)
    p = i["contig_postings"].groupBy("tid").agg(F.count(F.lit(1)).alias("n_postings"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    return i["contigs"].join(p, "tid").select("name", "len", "n_postings", "first", "last")


def index_roundtrip(spark, sf):
    """Postings of the transcripts, saved bucketed by k-mer and loaded again."""
    t = read_table(spark, sf, "transcripts").select("tid", "name", "gene_id", "len", F.upper("seq").alias("seq"))
    path = _path(spark, "index")
    tables.save_index({"transcripts": t}, path, kmers.postings(t))
    i = tables.load_index(spark, path)
    return i["postings"].join(i["transcripts"].select("tid", "gene_id"), "tid").groupBy("tid", "gene_id").agg(F.count(F.lit(1)).alias("n_postings"), F.bit_xor("kmer").alias("mixed"), F.max("pos").alias("last"))


def transcripts_fasta(spark, sf):
    """Transcripts written as the index writes them, one line of sequence each, in order of tid."""
    path = _path(spark, "out")
    tables.write_fasta(read_table(spark, sf, "transcripts"), path, order="tid")
    return spark.read.text(path).select(F.col("value").alias("line"))


def _sample(spark, sf):
    """Abundance of the classes, after three plain rounds."""
    t = read_table(spark, sf, "transcripts").select("tid", "len", S.first_token(F.col("name")).alias("target_id"), "gene_id")
    c = read_table(spark, sf, "classes").filter("size(refs) > 0 AND n > 0").select("class_id", F.array_sort(F.array_distinct("refs")).alias("refs"), "n").distinct()
    c = materialize(c.groupBy("refs").agg(F.sum("n").alias("n")), "classes")
    return t, c


def abundance_file(spark, sf):
    """Unique reads of the targets as the lines of an abundance file."""
    t, c = _sample(spark, sf)
    u = t.join(quant.unique_counts(c), "tid", "left").select("tid", "target_id", F.coalesce("unique_map", F.lit(0)).alias("unique_map"), F.col("len").alias("length"), F.lit(1.5).alias("eff_length"), F.coalesce("unique_map", F.lit(0)).cast("double").alias("est_counts"), F.lit(0.25).alias("tpm"))
    path = _path(spark, "out")
    tables.write_abundance(u, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def gene_file(spark, sf):
    """Unique reads by gene as the lines of a gene file."""
    t, c = _sample(spark, sf)
    genes = read_table(spark, sf, "genes").select("gene_id", "ensembl_id", F.col("name").alias("gene_name"))
    u = t.join(quant.unique_counts(c), "tid", "left").withColumn("est_counts", F.coalesce("unique_map", F.lit(0)).cast("double")).withColumn("tpm", F.lit(0.5))
    g = quant.gene_rollup(u, genes)
    path = _path(spark, "out")
    tables.write_genes(g.select(F.col("ensembl_id").alias("gene_id"), "gene_name", "est_counts", "tpm"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def bootstrap_files(spark, sf):
    """Replicates written by number, with their parameters beside them."""
    t, c = _sample(spark, sf)
    path = _path(spark, "out")
    tables.write_bootstrap(quant.bootstrap(t.select("tid", "len"), c, 3, 7), {"num_bootstrap": 3}, path)
    b = spark.read.parquet(f"{path}/bootstrap").groupBy("bs").agg(F.count(F.lit(1)).alias("n_targets"), F.round(F.sum("est_counts"), 3).alias("total"))
    a = spark.read.text(f"{path}/aux").select(F.get_json_object("value", "$.num_bootstrap").cast("int").alias("num_bootstrap"))
    return b.crossJoin(F.broadcast(a))  # one row


def model_files(spark, sf):
    """Parameters of a model saved, loaded and written as a result file."""
    t = read_table(spark, sf, "transcripts").select("tid", "len", S.first_token(F.col("name")).alias("trans_id"))
    path = _path(spark, "model")
    tables.save_model(spark, generative.uniform(t), f"{path}/model.json")
    m = tables.load_model(spark, f"{path}/model.json")
    r = generative.result(spark, m, 1000.0).join(t.select("tid", "trans_id"), "tid")
    rows = r.select("tid", "trans_id", F.col("length").alias("trans_length"), F.col("eff_length").alias("effective_len"), "read_count", "tpm", "fpkm")
    tables.write_model_result(rows, f"{path}/result.tsv")
    cells = F.split("value", "\t")
    back = spark.read.text(f"{path}/result.tsv").filter(~F.col("value").startswith("#"))
    return back.select(cells[0].alias("trans_id"), cells[1].cast("int").alias("trans_length"), *[F.round(cells[k].cast("double"), 3).alias(c) for k, c in ((2, "effective_len"), (3, "read_count"), (4, "tpm"))])


def sam_roundtrip(spark, sf):
    """Reads as unmapped SAM text and read again."""
    r = _sound_reads(spark, sf)
    rows = r.select(
        S.strip_mate(S.first_token(F.col("name"))).alias("qname"), sam.flag(unmapped=F.lit(True), first=F.col("mate") == 1, last=F.col("mate") == 2).alias("flag"), F.lit("*").alias("rname"), F.lit(0).alias("pos"), F.lit(0).alias("mapq"), F.lit("*").alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"),
        F.lit(0).alias("tlen"), "seq", "qual", F.lit(None).cast("int").alias("nm"), F.lit(None).cast("string").alias("md"), F.lit(None).cast("int").alias("score"),
    )
    path = _path(spark, "sam")
    bam.sam_lines(rows).write.text(path)
    return bam.read_sam(spark, path).select("qname", "flag", "rname", "pos", "seq", "qual", "nm")


def md_tags(spark, sf):
    """Operations made of the qualities (F matches, a comma differs, a colon is deleted) over the bases of the read, as MD, NM and match count."""
    r = read_table(spark, sf, "reads").filter("length(qual) = length(seq)").select("read_id", F.upper("seq").alias("seq"), "qual").distinct()
    marks = F.regexp_replace(F.translate("qual", "F,:", "=XD"), "[^=XD]", "=")
    runs = F.regexp_extract_all(marks, F.lit(r"((.)\2*)"), F.lit(1))
    ends = F.transform(runs, lambda x, i: F.struct(x.alias("x"), F.aggregate(F.slice(runs, 1, i), F.lit(0), lambda s, y: s + F.length(y)).alias("at")))
    cigar = F.transform(ends, lambda e: F.struct(F.substring(e["x"], 1, 1).alias("op"), F.length(e["x"]).alias("len"), F.when(F.substring(e["x"], 1, 1) == "=", "").otherwise(F.substring(F.col("seq"), e["at"] + 1, F.length(e["x"]))).alias("ref")))
    r = r.select("read_id", cigar.alias("c"))
    return r.select("read_id", sam.md_text(F.col("c")).alias("md"), sam.edit_count(F.col("c")).cast("int").alias("nm"), sam.match_count(F.col("c")).cast("int").alias("score"))


_SOUND = "s AS (SELECT DISTINCT read_id, lane, mate, name, seq, qual FROM reads WHERE name IS NOT NULL AND length(seq) > 0 AND length(qual) = length(seq))"
_LANES = f"{_SOUND}, o AS (SELECT *, row_number() OVER (PARTITION BY lane, mate ORDER BY read_id) - 1 AS k FROM s WHERE lane IS NOT NULL AND mate IS NOT NULL)"
_LAID = "t AS (SELECT tid, gene_id, chr_id, length(seq) AS n, upper(seq) AS seq, coalesce(sum(length(seq) + 100) OVER (PARTITION BY chr_id ORDER BY tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM transcripts WHERE chr_id IS NOT NULL)"
_UNIQUE = "c0 AS (SELECT DISTINCT class_id, list_sort(list_distinct(refs)) AS refs, n FROM classes WHERE len(refs) > 0 AND n > 0), u AS (SELECT refs[1] AS tid, sum(n)::BIGINT AS u FROM c0 WHERE len(refs) = 1 GROUP BY 1)"
_KMERS = "pk AS (SELECT tid, gene_id, i::INT AS pos, substr(upper(seq), (i + 1)::INT, 31) AS kmer FROM transcripts, unnest(range(0, length(seq) - 30)) x(i)), p AS (SELECT * FROM pk WHERE NOT regexp_matches(kmer, '[^ACGT]'))"
_CODE = "list_reduce(list_transform(string_split(translate(kmer, 'ACGT', '0123'), ''), lambda c: c::BIGINT), lambda a, c: a * 4 + c)"

QUERIES = {
    "gzip_scan": (gzip_scan, f"WITH {_SOUND} SELECT name, seq, qual, NULL::VARCHAR AS problem FROM s"),
    "fasta_scan": (fasta_scan, "SELECT name, seq, NULL::VARCHAR AS problem FROM transcripts"),
    "paired_scan": (
        paired_scan,
        f"""WITH {_LANES}, a AS (SELECT * FROM o WHERE mate = 1), b AS (SELECT * FROM o WHERE mate = 2)
SELECT coalesce(a.lane, b.lane) AS lane, coalesce(a.k, b.k) AS ordinal, a.name AS name1, b.name AS name2, CASE WHEN a.k IS NULL OR b.k IS NULL THEN 'missing' END AS problem FROM a FULL JOIN b ON a.lane = b.lane AND a.k = b.k""",
    ),
    "single_scan": (single_scan, f"WITH {_LANES} SELECT lane, mate::INT AS mate, k AS ordinal, name, upper(seq) AS seq FROM o"),
    "genome_scan": (
        genome_scan,
        f"WITH {_LAID}, n AS (SELECT (row_number() OVER (ORDER BY chr_id) - 1)::INT AS k, 'chr' || chr_id AS name, max(start + n)::BIGINT AS len FROM t GROUP BY chr_id) SELECT k AS chr_id, name, len, coalesce(sum(len) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM n",
    ),
    "gtf_scan": (
        gtf_scan,
        f"""WITH {_LAID} SELECT 'chr' || chr_id AS seqname, f AS feature, start, start + n AS "end", '+' AS strand, 'T' || tid AS gene, 'N' || gene_id AS gene_name, 't' || tid AS transcript FROM t, unnest(['gene', 'transcript', 'exon']) x(f)""",
    ),
    "built_transcripts": (built_transcripts, f"WITH {_LAID} SELECT 't' || tid || ':T' || tid AS name, 'T' || tid AS ensembl_id, 'N' || gene_id AS gene_name, n::INT AS len, 1::BIGINT AS n_exons, start, seq FROM t"),
    "contig_index": (
        contig_index,
        f"""WITH {_LAID}, k AS (SELECT chr_id, (start + i)::INT AS pos, substr(seq, (i + 1)::INT, 31) AS kmer FROM t, unnest(range(0, n - 30)) x(i)), s AS (SELECT * FROM k WHERE NOT regexp_matches(kmer, '[^ACGT]')),
c AS (SELECT chr_id, max(start + n)::INT AS len FROM t GROUP BY 1), g AS (SELECT chr_id, count(*) AS n_postings, min(pos) AS first, max(pos) AS last FROM s GROUP BY 1)
SELECT 'chr' || chr_id AS name, len, n_postings, first, last FROM g JOIN c USING (chr_id)""",
    ),
    "index_roundtrip": (index_roundtrip, f"WITH {_KMERS} SELECT tid, gene_id, count(*) AS n_postings, bit_xor({_CODE}) AS mixed, max(pos) AS last FROM p GROUP BY 1, 2"),
    "transcripts_fasta": (transcripts_fasta, "SELECT unnest(['>' || name, seq]) AS line FROM transcripts"),
    "abundance_file": (
        abundance_file,
        f"""WITH {_UNIQUE} SELECT concat_ws(chr(9), string_split(name, ' ')[1], coalesce(u, 0), len, '1.500000', printf('%.6f', coalesce(u, 0)::DOUBLE), '0.250000') AS line FROM transcripts LEFT JOIN u USING (tid)
UNION ALL SELECT '#' || concat_ws(chr(9), 'target_id', 'unique_map', 'length', 'eff_length', 'est_counts', 'tpm')""",
    ),
    "gene_file": (
        gene_file,
        f"""WITH {_UNIQUE} SELECT concat_ws(chr(9), ensembl_id, coalesce(any_value(g.name), ''), printf('%.6f', sum(coalesce(u, 0))::DOUBLE), printf('%.6f', count(*) * 0.5)) AS line FROM transcripts t LEFT JOIN u USING (tid) JOIN genes g USING (gene_id) GROUP BY gene_id, ensembl_id
UNION ALL SELECT '#' || concat_ws(chr(9), 'gene_id', 'gene_name', 'est_counts', 'tpm')""",
    ),
    "bootstrap_files": (bootstrap_files, f"WITH {_UNIQUE} SELECT i::INT AS bs, (SELECT count(*) FROM transcripts) AS n_targets, round((SELECT sum(n) FROM c0)::DOUBLE, 3) AS total, 3 AS num_bootstrap FROM range(1, 4) r(i)"),
    "model_files": (
        model_files,
        """WITH e AS (SELECT tid, string_split(name, ' ')[1] AS trans_id, len, least(len, 1000) AS m FROM transcripts), f AS (SELECT *, ((m + 1) * (len + 1) - m * (m + 1) / 2) / 1001 AS eff FROM e),
g AS (SELECT *, CASE WHEN eff >= 1 THEN eff ELSE 0 END AS eff1, 1.0::DOUBLE / ((SELECT count(*) FROM transcripts) + 1) AS p FROM f), r AS (SELECT *, CASE WHEN eff1 > 0 THEN p / eff1 ELSE 0 END AS rate FROM g)
SELECT trans_id, len AS trans_length, round(eff1, 3)::DOUBLE AS effective_len, round(p * 1000, 3) AS read_count, round(rate * 1e6 / sum(rate) OVER (), 3) AS tpm FROM r""",
    ),
    "sam_roundtrip": (
        sam_roundtrip,
        rf"WITH {_SOUND} SELECT regexp_replace(regexp_extract(name, '^(\S*)', 1), '/[12]$', '') AS qname, 4 + CASE mate WHEN 1 THEN 64 WHEN 2 THEN 128 ELSE 0 END AS flag, '*' AS rname, 0 AS pos, seq, qual, NULL::INT AS nm FROM s",
    ),
    "md_tags": (
        md_tags,
        r"""WITH r AS (SELECT DISTINCT read_id, upper(seq) AS seq, regexp_replace(translate(qual, 'F,:', '=XD'), '[^=XD]', '=', 'g') AS m FROM reads WHERE length(qual) = length(seq)),
b AS (SELECT read_id, m, list_transform(range(1, length(m) + 1), lambda i: CASE substr(m, i::INT, 1) WHEN '=' THEN '=' WHEN 'X' THEN substr(seq, i::INT, 1) ELSE (CASE WHEN i > 1 AND substr(m, (i - 1)::INT, 1) = 'D' THEN '' ELSE '^' END) || lower(substr(seq, i::INT, 1)) END) AS l FROM r),
t AS (SELECT read_id, m, regexp_extract_all(array_to_string(l, ''), '=+|\^[a-z]+|[A-Z]') AS x FROM b)
SELECT read_id, upper(array_to_string(list_transform(x, lambda v, i: CASE WHEN left(v, 1) = '=' THEN length(v)::VARCHAR ELSE (CASE WHEN i > 1 AND left(x[i - 1], 1) = '=' THEN '' ELSE '0' END) || v END), '')) || CASE WHEN left(x[len(x)], 1) = '=' THEN '' ELSE '0' END AS md,
  length(replace(m, '=', ''))::INT AS nm, length(regexp_replace(m, '[^=]', '', 'g'))::INT AS score FROM t""",
    ),
}
