"""Genome FASTA and GTF, and the transcriptome that they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.seq import first_token
from strandloom.sources.reads import scan, with_ordinals

GTF = "seqname string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string"


def genome(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Contigs ``chr_id``, ``name``, ``len``, ``seq`` in file order; ``first`` keeps so many of them."""
    df = with_ordinals(scan(spark, path)).select(F.col("ordinal").cast("int").alias("chr_id"), first_token(F.col("name")).alias("name"), F.length("seq").cast("long").alias("len"), "seq")
    return df.filter(F.col("chr_id") < first) if first else df


def attribute(name: str):
    return F.nullif(F.regexp_extract("attributes", rf'(?:^|[\s;]){name} "?([^";]+)"?', 1), F.lit(""))


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """Rows of gene, transcript and exon features; ``start`` from 0, ``end`` exclusive. Rows without their keys are left out."""
    rows = spark.read.schema(GTF).csv(path, sep="\t", comment="#", quote="")
    kept = rows.filter(F.col("feature").isin("gene", "transcript", "exon")).select(
        "seqname", "feature", (F.col("start") - 1).alias("start"), "end", "strand", attribute("gene_id").alias("gene"), attribute("gene_name").alias("gene_name"), attribute("transcript_id").alias("transcript")
    )
    return kept.filter(F.col("gene").isNotNull() & ((F.col("feature") == "gene") | F.col("transcript").isNotNull()) & F.col("start").isNotNull() & F.col("end").isNotNull())


def transcriptome(contigs: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """``genes``, ``exons`` and ``transcripts`` of the contigs at hand.

    Exons are cut out where their contig lies (a join on the contig), then
    joined in order of place within each transcript; the sequence follows the
    plus strand whatever the strand of the gene. Features of unknown contigs
    are left out.
    """
    known = rows.join(contigs.select(F.col("name").alias("seqname")), "seqname", "left_semi")
    g = known.filter("feature = 'gene'").groupBy("gene").agg(F.first("strand").alias("strand"), F.first("gene_name").alias("name"), F.min("start").alias("start"), F.max("end").alias("end"), F.first("seqname").alias("chr"))
    e = known.filter("feature = 'exon'").select("gene", "transcript", "seqname", "start", "end").distinct()
    cut = e.join(contigs.select(F.col("name").alias("seqname"), "chr_id", "seq"), "seqname").withColumn("part", F.substring("seq", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))).drop("seq")
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "part")))
    t = cut.groupBy("transcript", "gene", "chr_id").agg(ordered.alias("x")).select("transcript", "gene", "chr_id", F.concat_ws("", F.transform("x", lambda v: v["part"])).alias("seq"))
    t = t.withColumn("name", F.concat_ws(":", "transcript", "gene")).withColumn("len", F.length("seq"))
    return {"genes": g, "exons": cut.drop("part"), "transcripts": t}


def numbered(df: DataFrame, name: str, to: str) -> DataFrame:
    """Adds a dense INT id in order of ``name``; only the distinct names are numbered, by ranges, and joined back."""
    from strandloom.operators.ordinals import number_rows

    names = number_rows(df.select(name).distinct(), [], [name], "__n")
    return df.join(names.select(name, (F.col("__n") - 1).cast("int").alias(to)), name).select(*df.columns, to)
