"""Queries over classes and abundance: EM, rates, gene sums, model, scans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import seq as S
from strandloom.functions import stats
from strandloom.operators import align, generative, kmers, quant
from strandloom.plans.sequences import _HITS
from strandloom.runtime import materialize, read_table, shared_dir
from strandloom.sources import bam, reads as read_source
from strandloom.streaming import class_counts


def _targets(spark, sf):
    return read_table(spark, sf, "transcripts").select("tid", "len")


def _classes(spark, sf):
    """Sound classes once each, targets sorted and distinct; equal sets are one class."""
    c = read_table(spark, sf, "classes").filter("size(refs) > 0 AND n > 0").select("class_id", F.array_sort(F.array_distinct("refs")).alias("refs"), "n").distinct()
    return c.groupBy("refs").agg(F.sum("n").alias("n"))


def _abundance(spark, sf):
    """Rows once each, by trimmed target, with sound counts only."""
    a = read_table(spark, sf, "abundance").select("cell_id", "bs", F.trim("target_id").alias("target_id"), "length", "eff_length", F.nanvl("est_counts", F.lit(None).cast("double")).alias("est_counts"), "tpm")
    return a.distinct()


def class_set_counts(spark, sf):
    c = _classes(spark, sf)
    return c.select(F.concat_ws(",", F.transform("refs", lambda x: x.cast("string"))).alias("refs"), "n")


def em_rounds(spark, sf):
    """Three rounds of expectation-maximisation as DataFrames, then TPM."""
    targets = _targets(spark, sf)
    r = stats.tpm(quant.rounds(targets, _classes(spark, sf), 3, every=5))
    return r.join(targets, "tid").select("tid", F.round("tpm", 4).alias("tpm"), F.round(F.col("rate") * F.col("len"), 4).alias("est_counts"))


def em_squarem(spark, sf):
    a = quant.abundance(_targets(spark, sf), _classes(spark, sf), 250.0)
    return a.filter("est_counts > 0").select("tid", "unique_map", "length", "eff_length", F.round("est_counts", 4).alias("est_counts"), F.round("tpm", 4).alias("tpm"))


def em_accelerated(spark, sf):
    """Two accelerated rounds as DataFrames."""
    targets = _targets(spark, sf)
    r = quant.squarem_rounds(targets, _classes(spark, sf), least=2, most=2)
    return r.join(targets, "tid").select("tid", F.round(F.col("rate") * F.col("len"), 4).alias("est_counts"))


def reads_to_abundance(spark, sf):
    """From reads to abundance: seeds, chains, alignments, classes, accelerated EM."""
    t = read_table(spark, sf, "transcripts").select("tid", "len", F.upper("seq").alias("seq"))
    r = read_table(spark, sf, "reads").filter("seq IS NOT NULL").select("read_id", F.upper("seq").alias("seq")).distinct()
    hits = align.map_reads(r, t, materialize(kmers.postings(t), "postings"), ["read_id"])
    cls = materialize(quant.classes(hits, "read_id", "tid", "err"), "classes")
    a = quant.abundance(t.select("tid", "len"), cls, 100.0)
    return a.select("tid", "unique_map", "length", "eff_length", F.round("est_counts", 4).alias("est_counts"), F.round("tpm", 4).alias("tpm"))


def exact_reads_to_abundance(spark, sf):
    """From reads to counts by the reads that map without an error: search, classes and three rounds of EM."""
    t = read_table(spark, sf, "transcripts").select("tid", "len", F.upper("seq").alias("seq"))
    r = read_table(spark, sf, "reads").filter("seq IS NOT NULL").select("read_id", F.upper("seq").alias("seq")).distinct()
    hits = align.map_reads(r, t, materialize(kmers.postings(t), "postings"), ["read_id"]).filter("err = 0")
    cls = materialize(quant.classes(hits, "read_id", "tid", "err"), "classes")
    targets = t.select("tid", "len")
    ab = quant.rounds(targets, cls, 3, every=5).join(targets, "tid").join(quant.unique_counts(cls), "tid", "left")
    return ab.select("tid", F.coalesce("unique_map", F.lit(0)).cast("long").alias("unique_map"), F.round(F.col("rate") * F.col("len"), 5).alias("est_counts"))


def bootstrap(spark, sf):
    """Totals of four replicates, and how many targets of no class got counts."""
    c = _classes(spark, sf)
    b = quant.bootstrap(_targets(spark, sf), c, 4, seed=1)
    known = c.select(F.explode("refs").alias("tid"), F.lit(True).alias("known")).distinct()
    stray = F.count_if(F.col("known").isNull() & (F.col("est_counts") > 1e-6))
    return b.join(known, "tid", "left").groupBy("bs").agg(F.count(F.lit(1)).alias("n_targets"), F.round(F.sum("est_counts"), 2).alias("total"), stray.alias("n_stray"))


def class_unique(spark, sf):
    return quant.unique_counts(_classes(spark, sf))


def tpm_norm(spark, sf):
    """TPM anew from counts and lengths within each cell and replicate, beside its rank there."""
    w = Window.partitionBy("cell_id", "bs")
    a = _abundance(spark, sf).filter("est_counts IS NOT NULL AND length > 0").withColumn("rate", F.col("est_counts") / F.col("length"))
    total = F.sum("rate").over(w)
    return a.select("cell_id", "bs", "target_id", F.round(F.when(total > 0, F.col("rate") * 1e6 / total).otherwise(0.0), 4).alias("tpm"))


def fpkm_tpm(spark, sf):
    """FPKM over all rows of a target, from shares of the counts and mean effective lengths."""
    per = _abundance(spark, sf).groupBy("target_id").agg(F.sum("est_counts").alias("c"), F.avg("eff_length").alias("e"))
    out = stats.fpkm(per.withColumn("c", F.coalesce("c", F.lit(0.0))).withColumn("e", F.coalesce("e", F.lit(0.0))), "c", "e")
    return out.select("target_id", F.round("fpkm", 4).alias("fpkm"))


def _with_gene(spark, sf):
    t = read_table(spark, sf, "transcripts").select(S.first_token(F.col("name")).alias("target_id"), "gene_id")
    return _abundance(spark, sf).join(t, "target_id")


def gene_rollup(spark, sf):
    """Counts and TPM by gene, with the gene's Ensembl id."""
    genes = read_table(spark, sf, "genes").select("gene_id", "ensembl_id")
    g = quant.gene_rollup(_with_gene(spark, sf), genes)
    return g.select("gene_id", "ensembl_id", F.round(F.coalesce("est_counts", F.lit(0.0)), 3).alias("est_counts"), F.round("tpm", 3).alias("tpm"))


def gene_levels(spark, sf):
    """Counts by target, gene and over all."""
    t = quant.two_levels(_with_gene(spark, sf), "gene_id", "target_id", "est_counts")
    return t.select("gene_id", "target_id", F.round(F.coalesce("est_counts", F.lit(0.0)), 3).alias("est_counts"), "level")


def replicate_spread(spark, sf):
    """Sample standard deviation of a target's counts over cells and replicates."""
    a = _abundance(spark, sf)
    return a.groupBy("target_id").agg(F.count("est_counts").alias("n"), F.round(F.stddev_samp("est_counts"), 5).alias("sd"))


def round_change(spark, sf):
    """How far the second round moves from the first."""
    targets, c = _targets(spark, sf), _classes(spark, sf)
    one = quant.round_of(targets, c, quant.start_rates(targets))
    two = quant.round_of(targets, c, one)
    both = one.withColumnRenamed("rate", "old").join(two.withColumnRenamed("rate", "new"), "tid")
    out = stats.relative_change(both, "old", "new")
    return out.select(F.round("max_change", 6).alias("max_change"), "n_above_1e3", "n_above_1e7")


def _model_table(spark, sf):
    """The written alignments of the model, and the number of reads without a mapped one."""
    a = read_table(spark, sf, "f_align").filter("trans_id >= 0").select("align_id", "read_id", "trans_id", "pos", "f_len", "dis", "ori").distinct()
    n_unmapped = read_table(spark, sf, "reads").select("read_id").distinct().join(a.select("read_id"), "read_id", "left_anti").count()
    r = read_table(spark, sf, "reads").select(F.col("read_id").alias("read"), "len").distinct()
    rows = a.select(F.col("read_id").alias("read"), F.col("trans_id").alias("tid"), F.col("pos").alias("bucket"), "f_len", "dis", "ori").join(r, "read")
    return generative.prepare(rows), float(n_unmapped)


def generative_model(spark, sf):
    """Abundance by the generative model over the alignment table; reads without any mapped alignment are noise."""
    table, n_unmapped = _model_table(spark, sf)
    model = generative.fit(_targets(spark, sf), table, n_unmapped)
    if not model.converged:
        raise RuntimeError("the generative model's weights haven't converged")
    return generative.result(spark, model, table.count() + n_unmapped).filter("read_count > 0.01").select("tid", "length", *[F.round(c, 3).alias(c) for c in ("eff_length", "read_count", "tpm", "fpkm")])


def model_step(spark, sf):
    """One round of the generative model from uniform distributions: weights (key -1 is noise), fragment lengths, orientation and mismatches."""
    table, n_unmapped = _model_table(spark, sf)
    m = generative.step(generative.uniform(_targets(spark, sf)), table, n_unmapped)
    rows = [("weight", int(k), float(v)) for k, v in zip([-1, *m.tids.tolist()], m.p) if v > 1e-9]
    rows += [("length", k, float(v)) for k, v in enumerate(m.length) if v > 1e-9] + [("forward", 0, float(m.forward)), ("mismatch", 0, float(m.mismatch))]
    return spark.createDataFrame(rows, "kind string, key int, value double").select("kind", "key", F.round("value", 8).alias("value"))


def noise_likelihoods(spark, sf):
    """Log-likelihood of reads as noise, by length, and start buckets of the middle of transcripts."""
    t = _targets(spark, sf)
    return t.select("tid", F.round(F.log10(S.noise_likelihood(F.least(F.col("len"), F.lit(150)))), 6).alias("noise"), S.bucket(F.floor(F.col("len") / 2), F.col("len")).alias("middle"))


def fastq_scan(spark, sf):
    """Reads written as FASTQ and scanned again in small splits."""
    r = read_table(spark, sf, "reads").filter("name IS NOT NULL AND length(seq) > 0 AND length(qual) = length(seq)").select("read_id", "name", "seq", "qual").distinct()
    path = f"{shared_dir(spark)}/strandloom-fastq-{np.random.default_rng().integers(1 << 60):x}"
    r.select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), "seq", F.lit("+"), "qual").alias("value")).write.text(path)
    files = path.removeprefix("file://") + "/part-*"
    back = read_source.scan(spark, files, split=1 << 18)
    return back.select("name", "seq", "qual", "problem")


def bam_roundtrip(spark, sf):
    """Alignments written as BAM and read again."""
    t = read_table(spark, sf, "transcripts").select("tid", S.first_token(F.col("name")).alias("rname"), "len")
    refs = [(x.rname, x.len) for x in t.orderBy("tid").collect()]
    a = read_table(spark, sf, "f_align").filter("trans_id >= 0").select("read_id", F.col("trans_id").alias("tid"), "pos", "dis", "ori").distinct()
    r = read_table(spark, sf, "reads").filter("seq IS NOT NULL").select("read_id", F.upper("seq").alias("seq"), "len").distinct()
    rows = a.join(r, "read_id").join(t.drop("len"), "tid").select(
        F.concat(F.lit("r"), "read_id").alias("qname"), F.when(F.col("ori") == 1, 0).otherwise(16).alias("flag"), "rname", "pos", F.lit(70).alias("mapq"), F.concat(F.col("len").cast("string"), F.lit("M")).alias("cigar"),
        F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), "seq", F.lit("*").alias("qual"), F.col("dis").alias("nm"), F.col("len").cast("string").alias("md"), (F.col("len") - F.col("dis")).alias("score"),
    )
    path = f"{shared_dir(spark)}/strandloom-{np.random.default_rng().integers(1 << 60):x}.bam"
    bam.write_bam(rows, path, refs)
    return bam.read_bam(spark, path)


def stream_classes(spark, sf):
    """Counts of the classes as a stream over the table's files, in one go."""
    return class_counts.counted_once(spark, f"{sf}/classes.parquet")


_C = """c0 AS (SELECT DISTINCT class_id, list_sort(list_distinct(refs)) AS refs, n FROM classes WHERE len(refs) > 0 AND n > 0), c AS (SELECT refs, sum(n)::BIGINT AS n FROM c0 GROUP BY 1)"""
_AB = "a AS (SELECT DISTINCT cell_id, bs, trim(target_id) AS target_id, length, eff_length, CASE WHEN isnan(est_counts) THEN NULL ELSE est_counts END AS est_counts, tpm FROM abundance)"
_G = f"{_AB}, tg AS (SELECT string_split(name, ' ')[1] AS target_id, gene_id FROM transcripts), ag AS (SELECT a.*, gene_id FROM a JOIN tg USING (target_id))"


def _round(k: int) -> str:
    return f"""s{k} AS (SELECT m.refs, sum(rate) AS total FROM m JOIN r{k - 1} USING (tid) GROUP BY 1),
g{k} AS (SELECT tid, sum(n * rate / total) AS got FROM m JOIN r{k - 1} USING (tid) JOIN s{k} USING (refs) WHERE total > 0 GROUP BY 1),
r{k} AS (SELECT t.tid, coalesce(got, 0) / len AS rate FROM transcripts t LEFT JOIN g{k} USING (tid))"""


_EM = f"{_C}, m AS (SELECT refs, n, unnest(refs) AS tid FROM c), r0 AS (SELECT tid, 1.0::DOUBLE / (SELECT count(*) FROM transcripts) AS rate FROM transcripts)"

def _step(new: str, old: str) -> str:
    """The table ``new`` of rates after one plain round from ``old``."""
    return f"""s_{new} AS MATERIALIZED (SELECT m.refs, sum(rate) AS total FROM m JOIN {old} USING (tid) GROUP BY 1),
g_{new} AS MATERIALIZED (SELECT tid, sum(n * rate / total) AS got FROM m JOIN {old} USING (tid) JOIN s_{new} USING (refs) WHERE total > 0 GROUP BY 1),
{new} AS MATERIALIZED (SELECT t.tid, coalesce(got, 0) / len AS rate FROM transcripts t LEFT JOIN g_{new} USING (tid))"""


def _accelerated(k: int) -> str:
    """The table ``q<k>`` of rates after accelerated round k."""
    old = "r0" if k == 1 else f"q{k - 1}"
    return f"""{_step(f'a{k}', old)}, {_step(f'b{k}', f'a{k}')},
d{k} AS MATERIALIZED (SELECT tid, x.rate AS x, b.rate AS x2, a.rate - x.rate AS r, (b.rate - a.rate) - (a.rate - x.rate) AS v FROM {old} x JOIN a{k} a USING (tid) JOIN b{k} b USING (tid)),
w{k} AS MATERIALIZED (SELECT least(-(stddev_samp(r) / stddev_samp(v)), -1.0) AS al, stddev_samp(v) AS sv FROM d{k}),
j{k} AS MATERIALIZED (SELECT tid, CASE WHEN sv > 0 AND x - 2 * al * r + al * al * v > 0 THEN x - 2 * al * r + al * al * v ELSE x2 END AS rate FROM d{k}, w{k}),
{_step(f'q{k}', f'j{k}')}"""


_MODEL = """a0 AS (SELECT DISTINCT align_id, read_id, trans_id AS tid, pos, f_len, dis, ori FROM f_align WHERE trans_id >= 0),
rl AS (SELECT read_id, max(len) AS rlen FROM (SELECT DISTINCT read_id, len FROM reads) GROUP BY 1),
a AS (SELECT a0.*, rlen, t.len AS n, least(t.len, 1000) AS m FROM a0 JOIN rl USING (read_id) JOIN transcripts t USING (tid) WHERE pos IS NOT NULL AND f_len IS NOT NULL AND dis IS NOT NULL AND ori IS NOT NULL AND rlen IS NOT NULL AND pos BETWEEN 1 AND 64
  AND read_id NOT IN (SELECT read_id FROM a0 GROUP BY 1 HAVING count(*) >= 1000)),
c AS (SELECT (SELECT count(*) FROM transcripts) + 1 AS k),
l AS (SELECT *, CASE WHEN greatest(least(f_len, 1000), 0) <= m THEN 1.0 / (m + 1) ELSE 0 END::DOUBLE * 0.5::DOUBLE * pow(0.5::DOUBLE, rlen) / n / greatest(greatest(least((n - f_len + 1) * 64.0 / n, 64), 0) / 64, 1e-12) AS lik FROM a),
j AS (SELECT *, greatest(lik / k, 1e-300) AS joint, pow(0.25::DOUBLE, rlen) / k AS noise FROM l, c),
o AS (SELECT *, greatest(sum(joint) OVER (PARTITION BY read_id) + noise, 1e-300) AS total FROM j),
p AS (SELECT *, CASE WHEN joint / total >= 1e-6 THEN joint / total ELSE 0 END AS post FROM o),
un AS (SELECT count(*) AS n FROM (SELECT DISTINCT read_id FROM reads) WHERE read_id NOT IN (SELECT read_id FROM a0)),
wt AS (SELECT tid AS key, sum(post) AS v FROM p GROUP BY 1 UNION ALL SELECT -1, (SELECT coalesce(sum(x), 0) FROM (SELECT max(noise / total) AS x FROM p GROUP BY read_id)) + (SELECT n FROM un)),
x AS (SELECT greatest(least(f_len, 1000), 0) AS f, sum(post) AS x FROM p GROUP BY 1), y AS (SELECT m, sum(post) * 1001 / (m + 1) AS y FROM p GROUP BY 1),
pd AS (SELECT f, x / could AS v FROM (SELECT f, x, (SELECT sum(y) FROM y WHERE y.m >= x.f) AS could FROM x) WHERE could > 0),
out_ AS (SELECT 'weight' AS kind, key::INT AS key, v / sum(v) OVER () AS value FROM wt UNION ALL SELECT 'length', f::INT, v / sum(v) OVER () FROM pd
  UNION ALL SELECT 'forward', 0, sum(post) FILTER (ori = 1) / sum(post) FROM p UNION ALL SELECT 'mismatch', 0, sum(post * dis) / sum(post * rlen) FROM p)"""

QUERIES = {
    "class_set_counts": (class_set_counts, f"WITH {_C} SELECT array_to_string(refs, ',') AS refs, n FROM c"),
    "class_unique": (class_unique, f"WITH {_C} SELECT refs[1] AS tid, sum(n)::BIGINT AS unique_map FROM c WHERE len(refs) = 1 GROUP BY 1"),
    "em_rounds": (
        em_rounds,
        f"WITH {_EM}, {_round(1)}, {_round(2)}, {_round(3)} SELECT tid, round(rate * 1e6 / sum(rate) OVER (), 4) AS tpm, round(rate * len, 4) AS est_counts FROM r3 JOIN transcripts USING (tid)",
    ),
    "em_squarem": (em_squarem, None),
    "em_accelerated": (em_accelerated, f"WITH {_EM}, {_accelerated(1)}, {_accelerated(2)} SELECT tid, round(rate * len, 4) AS est_counts FROM q2 JOIN transcripts USING (tid)"),
    "reads_to_abundance": (reads_to_abundance, None),
    "exact_reads_to_abundance": (
        exact_reads_to_abundance,
        f"""WITH {_HITS}, x AS (SELECT DISTINCT s.read_id, p.tid FROM s JOIN p ON p.kmer = left(s.seq, 31) JOIN t ON t.tid = p.tid AND substr(t.seq, p.pos + 1, length(s.seq)) = s.seq),
c AS (SELECT refs, count(*) AS n FROM (SELECT read_id, list_sort(list(tid)) AS refs FROM x GROUP BY 1) GROUP BY 1), m AS (SELECT refs, n, unnest(refs) AS tid FROM c),
r0 AS (SELECT tid, 1.0::DOUBLE / (SELECT count(*) FROM transcripts) AS rate FROM transcripts), {_round(1)}, {_round(2)}, {_round(3)}, u AS (SELECT refs[1] AS tid, n FROM c WHERE len(refs) = 1)
SELECT tid, coalesce(n, 0)::BIGINT AS unique_map, round(rate * len, 5) AS est_counts FROM r3 JOIN transcripts USING (tid) LEFT JOIN u USING (tid)""",
    ),
    "bootstrap": (bootstrap, f"WITH {_C} SELECT i::INT AS bs, (SELECT count(*) FROM transcripts) AS n_targets, round((SELECT sum(n) FROM c)::DOUBLE, 2) AS total, 0::BIGINT AS n_stray FROM range(1, 5) r(i)"),
    "round_change": (
        round_change,
        f"""WITH {_EM}, {_round(1)}, {_round(2)}, d AS (SELECT CASE WHEN r2.rate > 0 THEN abs(r2.rate - r1.rate) / r2.rate ELSE 0 END AS x FROM r1 JOIN r2 USING (tid))
SELECT round(max(x), 6) AS max_change, count(*) FILTER (x > 1e-3) AS n_above_1e3, count(*) FILTER (x > 1e-7) AS n_above_1e7 FROM d""",
    ),
    "tpm_norm": (
        tpm_norm,
        f"WITH {_AB}, x AS (SELECT *, est_counts / length AS rate FROM a WHERE est_counts IS NOT NULL AND length > 0) SELECT cell_id, bs, target_id, round(CASE WHEN sum(rate) OVER w > 0 THEN rate * 1e6 / sum(rate) OVER w ELSE 0 END, 4) AS tpm FROM x WINDOW w AS (PARTITION BY cell_id, bs)",
    ),
    "fpkm_tpm": (
        fpkm_tpm,
        f"WITH {_AB}, p AS (SELECT target_id, coalesce(sum(est_counts), 0) AS c, coalesce(avg(eff_length), 0) AS e FROM a GROUP BY 1) SELECT target_id, round(CASE WHEN e > 1e-9 THEN c / (SELECT sum(c) FROM p) * 1e9 / e ELSE 0 END, 4) AS fpkm FROM p",
    ),
    "gene_rollup": (
        gene_rollup,
        f"WITH {_G} SELECT gene_id, any_value(ensembl_id) AS ensembl_id, round(coalesce(sum(est_counts), 0), 3) AS est_counts, round(sum(tpm), 3) AS tpm FROM ag JOIN genes USING (gene_id) GROUP BY 1",
    ),
    "gene_levels": (
        gene_levels,
        f"WITH {_G} SELECT gene_id, target_id, round(coalesce(sum(est_counts), 0), 3) AS est_counts, grouping(gene_id, target_id)::INT AS level FROM ag GROUP BY ROLLUP (gene_id, target_id)",
    ),
    "replicate_spread": (replicate_spread, f"WITH {_AB} SELECT target_id, count(est_counts) AS n, round(stddev_samp(est_counts), 5) AS sd FROM a GROUP BY 1"),
    "noise_likelihoods": (
        noise_likelihoods,
        "SELECT tid, round(log10(pow(0.25, least(len, 150))), 6) AS noise, (floor(floor(len / 2) * 64 / len) + 1)::INT AS middle FROM transcripts",
    ),
    "generative_model": (generative_model, None),
    "model_step": (model_step, f"WITH {_MODEL} SELECT kind, key, round(value, 8) AS value FROM out_ WHERE value > 1e-9 OR kind IN ('forward', 'mismatch')"),
    "fastq_scan": (
        fastq_scan,
        "SELECT name, seq, qual, NULL::VARCHAR AS problem FROM (SELECT DISTINCT read_id, name, seq, qual FROM reads WHERE name IS NOT NULL AND length(seq) > 0 AND length(qual) = length(seq))",
    ),
    "bam_roundtrip": (
        bam_roundtrip,
        """SELECT 'r' || a.read_id AS qname, CASE WHEN ori = 1 THEN 0 ELSE 16 END AS flag, string_split(t.name, ' ')[1] AS rname, pos, 70 AS mapq, r.len || 'M' AS cigar, '*' AS rnext, 0 AS pnext, 0 AS tlen, r.seq, '*' AS qual, dis AS nm, r.len::VARCHAR AS md, r.len - dis AS score
FROM (SELECT DISTINCT read_id, trans_id, pos, dis, ori FROM f_align WHERE trans_id >= 0) a JOIN (SELECT DISTINCT read_id, upper(seq) AS seq, len FROM reads WHERE seq IS NOT NULL) r USING (read_id) JOIN transcripts t ON t.tid = trans_id""",
    ),
    "stream_classes": (
        stream_classes,
        "SELECT array_to_string(list_sort(list_distinct(refs)), ',') AS refs, count(*) AS n_rows, sum(n)::BIGINT AS n FROM classes WHERE len(refs) > 0 AND n > 0 GROUP BY 1",
    ),
}
