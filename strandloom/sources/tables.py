"""Result tables: abundance, genes, bootstrap replicates, model parameters, index."""

from __future__ import annotations

import importlib.util
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import kmers


def _tsv(df: DataFrame, path: str, order: str, header: list[str]) -> None:
    """One file in order; result tables have a row per target or gene, not per read."""
    numbers = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    cols = [F.format_string("%.6f", c).alias(c) if c in numbers else F.col(c).cast("string").alias(c) for c in header]
    rows = df.select(F.col(order).alias("k"), F.lit(1).alias("body"), F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in cols]).alias("value"))
    head = df.sparkSession.range(1).select(F.lit(None).cast(df.schema[order].dataType).alias("k"), F.lit(0).alias("body"), F.lit("#" + "\t".join(header)).alias("value"))
    head.unionByName(rows).repartition(1).sortWithinPartitions("body", "k").select("value").write.mode("overwrite").text(path)


def write_abundance(df: DataFrame, path: str) -> None:
    """``target_id unique_map length eff_length est_counts tpm`` in order of ``tid``, six decimals."""
    _tsv(df, path, "tid", ["target_id", "unique_map", "length", "eff_length", "est_counts", "tpm"])


def write_genes(df: DataFrame, path: str) -> None:
    _tsv(df, path, "gene_id", ["gene_id", "gene_name", "est_counts", "tpm"])


def write_model_result(df: DataFrame, path: str) -> None:
    _tsv(df, path, "tid", ["trans_id", "trans_length", "effective_len", "read_count", "tpm", "fpkm"])


def write_bootstrap(replicates: DataFrame, aux: dict, path: str) -> None:
    """Replicates by ``bs`` as Parquet, beside them the run's parameters."""
    replicates.write.mode("overwrite").partitionBy("bs").parquet(f"{path}/bootstrap")
    spark = replicates.sparkSession
    spark.createDataFrame([(json.dumps(aux),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/aux")


def write_bootstrap_hdf5(targets: DataFrame, replicates: DataFrame, aux: dict, path: str) -> None:
    """The same as one HDF5 file, where h5py is installed."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("HDF5 needs h5py; use write_bootstrap for Parquet") from e
    t = targets.orderBy("tid").toPandas()
    with h5py.File(path, "w") as f:
        f.create_dataset("est_counts", data=t["est_counts"], compression="gzip", compression_opts=6)
        for k, v in {**aux, "ids": t["target_id"].astype("S"), "lengths": t["length"], "eff_lengths": t["eff_length"]}.items():
            f.create_dataset(f"aux/{k}", data=v)
        for (bs,) in replicates.select("bs").distinct().orderBy("bs").collect():
            x = replicates.filter(F.col("bs") == bs).orderBy("tid").toPandas()["est_counts"]
            f.create_dataset(f"bootstrap/bs{bs}", data=x, compression="gzip", compression_opts=6)


def save_model(spark: SparkSession, model, path: str) -> None:
    spark.createDataFrame([(json.dumps(model.to_json()),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str):
    from strandloom.operators.generative import Model

    return Model.from_json(json.loads(spark.read.text(path, wholetext=True).first()[0]))


INDEX_VERSION = 2


def has_hdf5() -> bool:
    return importlib.util.find_spec("h5py") is not None


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def save_index(tables: dict[str, DataFrame], path: str, postings: DataFrame) -> None:
    """The tables as Parquet, the postings bucketed by k-mer."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    kmers.write_index(postings, f"{path}/postings")


def save_genome(contigs: DataFrame, postings: DataFrame, path: str) -> None:
    """Contigs beside an index, with postings bucketed by k-mer."""
    contigs.write.mode("overwrite").parquet(f"{path}/contigs")
    kmers.write_index(postings, f"{path}/contig_postings")


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that the index has."""
    found = {n: spark.read.parquet(f"{path}/{n}") for n in ("transcripts", "genes", "exons", "chroms", "contigs") if _exists(spark, f"{path}/{n}")}
    return found | {n: kmers.read_index(spark, f"{path}/{n}") for n in ("postings", "contig_postings") if _exists(spark, f"{path}/{n}")}


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq", order: str | None = None) -> None:
    rows = df.orderBy(order) if order else df
    rows.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)
