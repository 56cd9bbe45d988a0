"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import functools
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=2)
def tokenizer(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    """A byte-level BPE tokenizer from a file of ranks; kept for the life of the process."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _shipped(spark, vocabulary: str) -> str:
    """The name by which tasks find the file: it goes to every executor once per application, so only the driver needs the path."""
    sc = spark.sparkContext
    sent = getattr(sc, "_strandloom_vocabularies", None)
    if sent is None:
        sent = sc._strandloom_vocabularies = set()
    if vocabulary not in sent:
        sc.addFile(vocabulary)
        sent.add(vocabulary)
    return os.path.basename(vocabulary)


def with_tokens(df: DataFrame, text_col: str, keep: list, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of tokens of the whole text.

    A null or empty text has 0 tokens. The text itself doesn't leave the task.
    """
    chosen = df.select(F.col(text_col).alias("__text"), *keep)
    fields = chosen.schema.fields[1:]

    name = _shipped(df.sparkSession, vocabulary)

    def run(batches):
        from pyspark import SparkFiles

        encode = tokenizer(SparkFiles.get(name), pattern).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], names=[*b.schema.names[1:], "tokens"])

    from pyspark.sql import types as T

    return chosen.mapInArrow(run, T.StructType([*fields, T.StructField("tokens", T.LongType())]))
