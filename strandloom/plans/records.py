"""Queries over raw lines and skewed keys (problems 1 and 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import malformed, skew
from strandloom.runtime import read_table


def _parsed(spark, sf):
    return malformed.parse_lines(read_table(spark, sf, "raw_reads"))


def p1_found(spark, sf):
    return malformed.fault_rows(_parsed(spark, sf)).withColumnRenamed("id", "raw_id")


def p1_valid_reads(spark, sf):
    return malformed.valid_rows(_parsed(spark, sf)).withColumnRenamed("id", "raw_id")


def p1_fault_counts(spark, sf):
    """Faults by reason, and the number of valid lines as reason ``valid``."""
    reason = F.explode(F.when(F.size("faults") == 0, F.array(F.lit("valid"))).otherwise(F.col("faults")))
    return _parsed(spark, sf).select(reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_lines"))


def _align_totals(spark, sf):
    mapped = read_table(spark, sf, "f_align").filter(F.col("trans_id") >= 0)
    return skew.two_stage_totals(mapped, "trans_id", ["align_id"])


def _abundance_totals(spark, sf):
    rows = read_table(spark, sf, "abundance").select("cell_id", "bs", F.trim("target_id").alias("target_id"), "est_counts")
    return skew.two_stage_totals(rows, "target_id", ["cell_id", "bs"], ["est_counts"])


def p3_found(spark, sf):
    a = skew.keys_above(_align_totals(spark, sf), "trans_id", 0.02)
    b = skew.keys_above(_abundance_totals(spark, sf), "target_id", 0.02)
    return a.select(F.lit("f_align").alias("src"), F.col("trans_id").cast("string").alias("key_value")).unionByName(
        b.select(F.lit("abundance").alias("src"), F.col("target_id").alias("key_value"))
    )


def p3_align_counts(spark, sf):
    return _align_totals(spark, sf)


def p3_abundance_sums(spark, sf):
    return _abundance_totals(spark, sf).select("target_id", "n_rows", F.round("sum_est_counts", 3).alias("sum_est_counts"))


_LINES = r"""
raw AS (SELECT raw_id, CASE WHEN right(line, 1) = chr(13) THEN left(line, length(line) - 1) ELSE line END AS s FROM raw_reads),
cut AS (SELECT raw_id, s, regexp_full_match(s, '(?s)(?:[^",]*|"(?:[^"]|"")*")(?:,(?:[^",]*|"(?:[^"]|"")*"))*') AS quoted_well,
  regexp_full_match(s, '(?s)(?:[^",]*|"(?:[^"]|"")*")(?:,(?:[^",]*|"(?:[^"]|"")*")){4}') AS five FROM raw),
f AS (SELECT raw_id, s, quoted_well, five, regexp_extract(s, '(?s)\A([^",]*|"(?:[^"]|"")*"),([^",]*|"(?:[^"]|"")*"),([^",]*|"(?:[^"]|"")*"),([^",]*|"(?:[^"]|"")*"),([^",]*|"(?:[^"]|"")*")\z', ['n', 'q', 'l', 'a', 'm']) AS x FROM cut),
u AS (SELECT raw_id, s, quoted_well, five, list_transform([x.n, x.q, x.l, x.a, x.m], lambda v: CASE WHEN left(v, 1) = '"' THEN replace(substr(v, 2, length(v) - 2), '""', '"') ELSE v END) AS v FROM f),
c AS (SELECT raw_id, v, CASE
    WHEN s IS NULL THEN ['columns']
    WHEN NOT quoted_well THEN ['quoting']
    WHEN NOT five THEN ['columns']
    ELSE list_filter([
      CASE WHEN regexp_full_match(v[1], '[!-~]+') THEN '' ELSE 'name' END,
      CASE WHEN regexp_full_match(v[2], '[ACGTNacgtn]+') THEN '' ELSE 'seq' END,
      CASE WHEN regexp_full_match(v[3], '[!-~]*') AND length(v[3]) = length(v[2]) THEN '' ELSE 'qual' END,
      CASE WHEN regexp_full_match(v[4], '[1-8]') THEN '' ELSE 'lane' END,
      CASE WHEN regexp_full_match(v[5], '[12]') THEN '' ELSE 'mate' END], lambda r: r <> '') END AS faults FROM u)
"""

_TOTALS = {
    "align": "a AS (SELECT trans_id, count(DISTINCT align_id) AS n_rows FROM f_align WHERE trans_id >= 0 GROUP BY 1)",
    "abundance": """b AS (SELECT target_id, count(*) AS n_rows, coalesce(sum(est_counts), 0) AS total FROM (
  SELECT cell_id, bs, trim(target_id) AS target_id, max(CASE WHEN isnan(est_counts) THEN NULL ELSE est_counts END) AS est_counts
  FROM abundance GROUP BY ALL) GROUP BY 1)""",
}

QUERIES = {
    "p1_found": (p1_found, f"WITH {_LINES} SELECT raw_id, unnest(faults) AS reason FROM c"),
    "p1_valid_reads": (
        p1_valid_reads,
        f"WITH {_LINES} SELECT raw_id, v[1] AS name, v[2] AS seq, v[3] AS qual, v[4]::INT AS lane, v[5]::TINYINT AS mate, length(v[2])::INT AS len FROM c WHERE len(faults) = 0",
    ),
    "p1_fault_counts": (
        p1_fault_counts,
        f"WITH {_LINES} SELECT reason, count(*) AS n_lines FROM (SELECT unnest(CASE WHEN len(faults) = 0 THEN ['valid'] ELSE faults END) AS reason FROM c) GROUP BY 1",
    ),
    "p3_found": (
        p3_found,
        f"""WITH {_TOTALS['align']}, {_TOTALS['abundance']}
SELECT 'f_align' AS src, trans_id::VARCHAR AS key_value FROM a WHERE n_rows >= 0.02 * (SELECT sum(n_rows) FROM a)
UNION ALL SELECT 'abundance', target_id FROM b WHERE n_rows >= 0.02 * (SELECT sum(n_rows) FROM b)""",
    ),
    "p3_align_counts": (p3_align_counts, f"WITH {_TOTALS['align']} SELECT trans_id, n_rows FROM a"),
    "p3_abundance_sums": (
        p3_abundance_sums,
        f"WITH {_TOTALS['abundance']} SELECT target_id, n_rows, round(total, 3) AS sum_est_counts FROM b",
    ),
}
