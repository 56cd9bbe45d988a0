"""Queries over emails (problems 6, 7 and 8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.llm import leakage, mixing, residue, tokens
from strandloom.runtime import read_table


def _leaks(spark, sf):
    return leakage.leaks(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items"), "doc_id", "text", "item_id", "text")


def p6_found(spark, sf):
    return _leaks(spark, sf).filter(F.col("run") >= 12).select("doc_id", "item_id")


def p6_leaks(spark, sf):
    return _leaks(spark, sf)


def _mix(spark, sf, size=None):
    size = size or (lambda docs, keep: tokens.with_tokens(docs, "text", keep))
    return mixing.mix(read_table(spark, sf, "documents"), read_table(spark, sf, "mix_targets"), "doc_id", "source", size)


def p7_found(spark, sf):
    return _mix(spark, sf).short_sources()


def p7_mix(spark, sf):
    return _mix(spark, sf).documents().drop("whole")


def p7_shares(spark, sf):
    return _mix(spark, sf).report()


def _by_chars(spark, sf):
    """The mix whose sizes are characters, which SQL can count."""
    return _mix(spark, sf, lambda docs, keep: docs.select(*keep, F.length("text").alias("tokens")))


def p7_mix_by_chars(spark, sf):
    """For each source the least and most repeats of its documents, and how many there are where all are used."""
    used = _by_chars(spark, sf).documents()
    per = used.groupBy("source").agg(F.min("repeats").alias("least"), F.max("repeats").alias("most"), F.count(F.lit(1)).alias("n"), F.min("whole").alias("whole"))
    return per.select("source", F.col("least").cast("int").alias("least"), F.col("most").cast("int").alias("most"), F.when(F.col("whole"), F.col("n")).alias("n_docs"))


def p7_shares_by_chars(spark, sf):
    """For each source whether it falls short, its characters if so, and else whether the mix meets the target to the largest document."""
    mix = _by_chars(spark, sf)
    r = mix.report()
    largest = mix.table.agg(F.max("tokens")).first()[0] or 0
    off = F.abs(F.col("used_tokens") - F.col("target_share") * F.lit(mix.total))
    return r.select("source", "short", (~F.col("short") & (off <= F.lit(largest))).alias("met"), F.when(F.col("short"), F.col("used_tokens")).cast("long").alias("chars"))


def p7_short_by_chars(spark, sf):
    """The sources that fall short when sizes are characters, which SQL can count."""
    return _by_chars(spark, sf).short_sources()


def _residue(spark, sf):
    return residue.find(residue.gather(read_table(spark, sf, "documents"), "doc_id", "text"))


def p8_found(spark, sf):
    return _residue(spark, sf).select("doc_id").distinct()


def p8_kinds(spark, sf):
    return _residue(spark, sf)


def p8_clean(spark, sf):
    return residue.clean(read_table(spark, sf, "documents"), "doc_id", _residue(spark, sf)).select("doc_id", "text", "source", "lang")


_CHARS = r"""d AS (SELECT regexp_replace(lower(trim(source)), '[\s_-]+', '_', 'g') AS s, sum(length(text)) AS n, count(*) AS n_docs FROM documents GROUP BY 1),
m AS (SELECT t.source, coalesce(d.n, 0) AS own, coalesce(n_docs, 0) AS n_docs, max_repeats AS most, target_share * (SELECT sum(length(text)) FROM documents) AS want FROM mix_targets t LEFT JOIN d ON d.s = t.source)"""

QUERIES = {
    "p6_found": (p6_found, None),
    "p6_leaks": (p6_leaks, None),
    "p7_found": (p7_found, None),
    "p7_mix": (p7_mix, None),
    "p7_shares": (p7_shares, None),
    "p8_found": (p8_found, None),
    "p8_kinds": (p8_kinds, None),
    "p8_clean": (p8_clean, None),
    "p7_mix_by_chars": (
        p7_mix_by_chars,
        rf"""WITH {_CHARS}, p AS (SELECT source, n_docs, most, CASE WHEN own * most <= want THEN most ELSE floor(want / own)::INT END AS full_times, own * most > want AND want - floor(want / own) * own > 0 AS more FROM m WHERE own > 0)
SELECT source, greatest(full_times, 1)::INT AS least, (full_times + CASE WHEN more THEN 1 ELSE 0 END)::INT AS most, CASE WHEN full_times > 0 THEN n_docs END AS n_docs FROM p""",
    ),
    "p7_shares_by_chars": (
        p7_shares_by_chars,
        rf"""WITH {_CHARS} SELECT source, own * most < want AS short, NOT own * most < want AS met, CASE WHEN own * most < want THEN own * most END::BIGINT AS chars FROM m""",
    ),
    "p7_short_by_chars": (
        p7_short_by_chars,
        r"""WITH d AS (SELECT regexp_replace(lower(trim(source)), '[\s_-]+', '_', 'g') AS s, sum(length(text)) AS n FROM documents GROUP BY 1)
SELECT t.source FROM mix_targets t LEFT JOIN d ON d.s = t.source
WHERE coalesce(d.n, 0) * max_repeats < target_share * (SELECT sum(length(text)) FROM documents)""",
    ),
}
