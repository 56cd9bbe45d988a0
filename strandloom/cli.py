"""Command line: ``build`` (genome and annotation), ``index`` (transcripts), ``quant``, ``model``."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandloom.plans import pipeline
from strandloom.runtime import materialize, release, ship
from strandloom.sources import tables


def _level(text: str) -> int:
    n = int(text)
    if n not in (-1, *range(1, 10)):
        raise argparse.ArgumentTypeError("-1 or 1 to 9")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="index of a genome and its annotation")
    b.add_argument("--fasta", required=True)
    b.add_argument("--gtf", required=True)
    b.add_argument("--outdir", required=True)
    b.add_argument("--contigs", type=int, help="only the first so many contigs")
    b.add_argument("--with-genome", action="store_true", help="save the contigs' index too")
    i = sub.add_parser("index", help="index of transcripts")
    i.add_argument("-t", dest="transcripts", required=True)
    i.add_argument("-o", dest="out", required=True)
    i.add_argument("-g", dest="genome", help="genome FASTA whose index is saved too")
    q = sub.add_parser("quant", help="abundance of reads")
    q.add_argument("-1", dest="left", nargs="+", required=True)
    q.add_argument("-2", dest="right", nargs="+", default=[])
    q.add_argument("-i", dest="index", required=True)
    q.add_argument("-o", dest="out", default="./quant")
    q.add_argument("-b", dest="bootstraps", type=int, default=0)
    q.add_argument("-w", dest="bam", help="write alignments to this BAM file")
    q.add_argument("-z", dest="level", type=_level, default=-1)
    q.add_argument("-f", dest="genome", help="genome FASTA for reads that the transcriptome doesn't hold; not needed if the index holds it")
    q.add_argument("-p", dest="prefix", default="", help="prefix of the output files")
    q.add_argument("--on-transcripts", action="store_true", help="places of the BAM file on transcripts, as the model wants them, even if exons are known")
    q.add_argument("--seed", type=int, default=0)
    m = sub.add_parser("model", help="abundance by the generative model from a BAM file")
    m.add_argument("bam")
    m.add_argument("-o", dest="out", default="./model")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "quant" and args.right and len(args.right) != len(args.left):
        parser().error("-1 and -2 need as many files")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    ship(spark)
    logging.info("%s", vars(args))
    try:
        _run(spark, args)
    finally:
        release(spark)  # outputs are written; nothing reads the intermediate tables any more
    return 0


def _run(spark: SparkSession, args) -> None:
    if args.command == "build":
        pipeline.build_index(spark, args.fasta, args.gtf, args.outdir, args.contigs, args.with_genome)
    elif args.command == "index":
        pipeline.index_transcripts(spark, args.transcripts, args.out, args.genome)
    elif args.command == "quant":
        index = tables.load_index(spark, args.index)
        if args.right:
            done = pipeline.quantify_pairs(spark, index, args.left, args.right, args.out, args.bootstraps, args.bam, args.level, args.seed, args.genome, args.prefix, args.on_transcripts)
            for r in done["unpaired"].collect():
                logging.warning("%d pairs left out: %s", r.n, {k: v for k, v in r.asDict().items() if k != "n"})
        else:
            done = pipeline.quantify_single(spark, index, args.left, args.out, args.bootstraps, args.bam, args.level, args.seed, args.genome, args.prefix, args.on_transcripts)
        logging.info("%s", done["summary"].first().asDict())
    else:
        model(spark, args.bam, args.out)


def model(spark: SparkSession, path: str, out: str):
    """Fits the generative model to a BAM file grouped by read name."""
    from strandloom.functions import sam
    from strandloom.functions.seq import bucket
    from strandloom.operators import generative
    from strandloom.sources import bam

    refs = spark.createDataFrame([(k, n, length) for k, (n, length) in enumerate(bam.references(path))], "tid int, rname string, len int")
    rows = materialize(bam.read_bam(spark, path), "bam")
    lengths = rows.groupBy("qname").agg(F.sum(F.when(sam.has(F.col("flag"), sam.SECONDARY), 0).otherwise(F.length("seq"))).cast("int").alias("read_len"))
    kept = rows.filter(sam.kept_by_model(F.col("flag"), F.col("tlen"))).join(refs.withColumnRenamed("len", "ref_len"), "rname").join(lengths, "qname")
    aligns = kept.select(F.xxhash64("qname").alias("read"), F.col("read_len").alias("len"), "tid", bucket(F.col("pos") - 1, F.col("ref_len")).alias("bucket"), F.col("tlen").alias("f_len"), F.coalesce("nm", F.lit(0)).alias("dis"), F.when(sam.has(F.col("flag"), sam.REVERSE), 0).otherwise(1).alias("ori"))
    table = generative.prepare(aligns)
    n = table.count()
    unmapped = rows.select("qname").distinct().count() - n
    m = generative.fit(refs.select("tid", "len"), table, float(unmapped))
    result = generative.result(spark, m, n + unmapped).join(refs.select("tid", F.col("rname").alias("trans_id")), "tid")
    named = result.select("tid", "trans_id", F.col("length").alias("trans_length"), F.col("eff_length").alias("effective_len"), "read_count", "tpm", "fpkm")
    tables.write_model_result(named, f"{out}/result.tsv")
    tables.save_model(spark, m, f"{out}/model.json")
    return named


if __name__ == "__main__":
    sys.exit(main())
