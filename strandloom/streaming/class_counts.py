"""Counts of equivalence classes over a stream of class files.

Counting is monotone, so the state is one row per class and no watermark is
needed for right results; the sink may be any that takes updates.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.runtime import shared_dir
from strandloom.sources import files


def running_counts(rows: DataFrame) -> DataFrame:
    """``refs`` (as text), ``n_rows`` and ``n`` of each class seen so far; works on streams and tables alike."""
    sound = rows.filter("size(refs) > 0 AND n > 0")
    refs = F.concat_ws(",", F.transform(F.array_sort(F.array_distinct("refs")), lambda x: x.cast("string")))
    return sound.groupBy(refs.alias("refs")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n"))


def start(spark: SparkSession, path: str, sink, schema=None, **trigger):
    """Streams the Parquet files of ``path``; ``sink(counts, epoch)`` gets the changed classes of each batch."""
    stream = spark.readStream.schema(schema or spark.read.parquet(path).schema).parquet(path)
    check = f"{shared_dir(spark)}/strandloom-stream-{uuid.uuid4().hex}"
    return running_counts(stream).writeStream.outputMode("update").option("checkpointLocation", check).foreachBatch(sink).trigger(**(trigger or {"availableNow": True})).start()


def counted_once(spark: SparkSession, path: str) -> DataFrame:
    """The counts after all files that are there now, as a table."""
    out = f"{shared_dir(spark)}/strandloom-counts-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out)

    # a single file is streamed through a pattern that matches only it
    where, _, name = path.rstrip("/").rpartition("/")
    source = path if files.is_folder(path) else where
    stream = spark.readStream.schema(schema)
    if source != path:
        stream = stream.option("pathGlobFilter", name)
    check = f"{out}-check"
    q = running_counts(stream.parquet(source)).writeStream.outputMode("update").option("checkpointLocation", check).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
    kept = spark.read.parquet(out)
    return kept.groupBy("refs").agg(F.max_by("n_rows", "epoch").alias("n_rows"), F.max_by("n", "epoch").alias("n"))
