"""K-mer inverted index over target sequences, and seed lookup in it."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.seq import K
from strandloom.operators import skew
from strandloom.runtime import materialize

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def pack(codes: np.ndarray, k: int) -> np.ndarray:
    """The code of the k-mer that begins at each place, from digits 0-3; k <= 31.

    Codes of 1, 2, 4, ... bases are doubled up and those in the binary form of
    k joined, so the work per place grows with the logarithm of k.
    """
    n = len(codes) - k + 1
    out, done, width, part = np.zeros(max(n, 0), np.int64), 0, 1, codes.astype(np.int64)
    while done < k and n > 0:
        if k & width:
            out = (out << (2 * width)) | part[done:done + n]
            done += width
        if done < k:
            part = (part[: len(part) - width] << (2 * width)) | part[width:]
            width *= 2
    return out


def _pack_rows(k: int, stride: int, last: bool):
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            keep = [i for i, t in enumerate(texts) if t is not None and len(t) >= k]
            joined = np.frombuffer("".join(texts[i] for i in keep).encode("latin-1", "replace"), np.uint8)
            codes = _CODE[joined]
            lengths = np.array([len(texts[i]) for i in keep], np.int64)
            begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(keep) else np.empty(0, np.int64)
            count = (lengths - k) // stride + 1
            extra = ((lengths - k) % stride > 0) if last else np.zeros(len(keep), bool)
            row = np.repeat(np.arange(len(keep)), count + extra)
            first = np.concatenate([[0], np.cumsum(count + extra)[:-1]]) if len(keep) else np.empty(0, np.int64)
            at = np.minimum((np.arange(len(row)) - first[row]) * stride, lengths[row] - k)
            if not len(row):
                continue
            place = begin[row] + at
            bad = np.concatenate([[0], np.cumsum(codes > 3)])
            sound = bad[place + k] == bad[place]
            row, at, place = row[sound], at[sound], place[sound]
            take = pa.array(np.array(keep, np.int64)[row])
            cols = [batch.column(i).take(take) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(at.astype(np.int32)), pa.array(pack(codes & 3, k)[place])], names=[*batch.schema.names[:-1], "at", "kmer"])

    return run


def kmers(df: DataFrame, key: list[str], seq: str, k: int = K, stride: int = 1, last: bool = False) -> DataFrame:
    """Columns ``key``, ``at`` (from 0) and ``kmer`` (LONG); k-mers with other characters than ACGT (any case) are left out.

    ``last`` adds the k-mer that ends the sequence where the stride misses it.
    Sequences of a batch are laid end to end and packed at once; nothing is
    shuffled. Null and short sequences have no k-mers.
    """
    if not 1 <= k <= 31:
        raise ValueError("k must be 1 to 31")
    rows = df.select(*key, F.col(seq).alias("__s")).filter(F.length("__s") >= k)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("at", T.IntegerType()), T.StructField("kmer", T.LongType())])
    return rows.mapInArrow(_pack_rows(k, stride, last), schema)


def postings(targets: DataFrame, tid: str = "tid", seq: str = "seq", k: int = K) -> DataFrame:
    """The inverted index ``(kmer, tid, pos)``; ``pos`` is the first base's place.

    Written with ``write_index`` it is bucketed by k-mer, so that seed joins
    read it without a shuffle.
    """
    return kmers(targets, [tid], seq, k).select("kmer", F.col(tid).alias("tid"), F.col("at").alias("pos"))


def _combined(batches):
    """Postings of each k-mer and target within a batch."""
    for b in batches:
        kmer, tid = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        if len(kmer):
            o = np.lexsort((tid, kmer))
            k, t = kmer[o], tid[o]
            first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array(t[first]), pa.array(np.diff(np.r_[first, len(k)]))], names=["kmer", "tid", "n"])


def frequencies(index: DataFrame) -> DataFrame:
    """Postings and targets of each k-mer.

    Postings are combined by target before they move, so a k-mer has a row per
    target and batch at most; they are partitioned by k-mer once, and both aggregates run there.
    """
    rows = index.select("kmer", F.col("tid").cast("int").alias("tid")).mapInArrow(_combined, "kmer long, tid int, n long").repartition("kmer")
    per = rows.groupBy("kmer", "tid").agg(F.sum("n").alias("n"))
    return per.groupBy("kmer").agg(F.sum("n").alias("n_postings"), F.count(F.lit(1)).alias("n_targets"))


def without_frequent(index: DataFrame, most: int) -> DataFrame:
    """The index without k-mers that have more than ``most`` postings.

    Low-complexity k-mers would join with everything; counting them is a hash
    aggregate with map-side partials, and the anti-join's side is those few.
    """
    heavy = index.groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("kmer")
    return index.join(heavy, "kmer", "left_anti")


def capped(index: DataFrame, most: int) -> DataFrame:
    """At most ``most`` postings of each k-mer, the first by target and place.

    The rank limit is applied on the map side too (Spark's window group limit),
    so a k-mer of a third of all postings sends a few rows per task.
    """
    w = Window.partitionBy("kmer").orderBy("tid", "pos")
    return index.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def write_index(index: DataFrame, path: str, buckets: int = 64) -> None:
    """The postings as Parquet files bucketed and sorted by k-mer; ``read_index`` joins them without a shuffle."""
    spark = index.sparkSession
    table = f"strandloom_{uuid.uuid4().hex}"
    index.select("kmer", "tid", "pos").repartition(buckets, "kmer").write.mode("overwrite").bucketBy(buckets, "kmer").sortBy("kmer").option("path", path).saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}-buckets")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The postings that ``write_index`` wrote, known to be bucketed; the catalog entry ends with the session's."""
    buckets = spark.read.parquet(f"{path}-buckets").first()[0]
    table = f"strandloom_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {table} (kmer BIGINT, tid INT, pos INT) USING parquet CLUSTERED BY (kmer) SORTED BY (kmer) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def seed_hits(reads: DataFrame, index: DataFrame, key: list[str], seq: str = "seq", k: int = K, stride: int = 14, spread: bool = False) -> DataFrame:
    """Columns ``key``, ``off`` (place on the read), ``tid``, ``pos`` and ``diag`` (pos - off).

    ``spread``: seeds are written once and counted; those of k-mers with more
    seeds than a part of a task's are joined by k-mer and salt, the rest as they are, so
    that poly-A doesn't wait for one task and a bucketed index isn't shuffled.
    """
    seeds = kmers(reads, key, seq, k, stride, last=True).withColumnRenamed("at", "off")
    if spread:
        joined = skew.balanced_join(materialize(seeds, "seeds"), index, "kmer", [*key, "off"])
    else:
        joined = seeds.join(index, "kmer")
    return joined.select(*key, "off", "tid", "pos", (F.col("pos") - F.col("off")).alias("diag"))


def both_strands(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """Each read as it is (``strand`` 0) and as its reverse complement (1)."""
    from strandloom.functions.seq import reverse_complement

    turned = F.explode(F.array(F.struct(F.lit(0).alias("strand"), F.col(seq).alias("s")), F.struct(F.lit(1).alias("strand"), reverse_complement(F.col(seq)).alias("s"))))
    return reads.withColumn("__x", turned).withColumn("strand", F.col("__x.strand")).withColumn(seq, F.col("__x.s")).drop("__x")
