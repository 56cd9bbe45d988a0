"""Queries over reads, names and classes (problems 2, 4 and 5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.llm import heavy_hitters, pairs, shared_spans
from strandloom.runtime import materialize, read_table


def _frequent_reads(spark, sf):
    reads = read_table(spark, sf, "reads").select("read_id", F.upper("seq").alias("seq"))
    return heavy_hitters.frequent_values(reads, "seq", "read_id", share=0.002, at_least=10)


def p2_found(spark, sf):
    return _frequent_reads(spark, sf).select(F.col("value").alias("seq"))


def p2_counts(spark, sf):
    return _frequent_reads(spark, sf).select(F.col("value").alias("seq"), "n_rows")


def _name_spans(spark, sf):
    return shared_spans.shared_stretches(read_table(spark, sf, "transcripts"), "tid", "name")


def _read_spans(spark, sf):
    reads = read_table(spark, sf, "reads").select("read_id", F.upper("seq").alias("seq"))
    return shared_spans.shared_stretches(reads, "read_id", "seq", breaks="N")


def p4_found(spark, sf):
    a = _name_spans(spark, sf).select(F.lit("name").alias("src"), F.col("id").alias("rec_id"), "span_from", "span_to")
    b = _read_spans(spark, sf).select(F.lit("read").alias("src"), F.col("id").alias("rec_id"), "span_from", "span_to")
    return a.unionByName(b)


def p4_name_shares(spark, sf):
    """How much of each transcript's header line also stands in another one."""
    spans = _name_spans(spark, sf).groupBy("id").agg(F.sum(F.col("span_to") - F.col("span_from")).alias("shared"))
    names = read_table(spark, sf, "transcripts").select(F.col("tid").cast("long").alias("id"), F.length("name").alias("len"))
    shared = F.coalesce("shared", F.lit(0))
    return names.join(spans, "id", "left").select(F.col("id").alias("tid"), shared.alias("shared"), F.round(shared / F.col("len"), 6).alias("part"))


def p4_read_shares(spark, sf):
    """How much of each read also stands in another one; reads without a sequence have no share."""
    spans = _read_spans(spark, sf).groupBy("id").agg(F.sum(F.col("span_to") - F.col("span_from")).alias("shared"))
    reads = read_table(spark, sf, "reads").filter("seq IS NOT NULL").select(F.col("read_id").alias("id"), F.length("seq").alias("len")).distinct()
    shared = F.coalesce("shared", F.lit(0))
    part = F.when(F.col("len") > 0, F.round(shared / F.col("len"), 6)).otherwise(F.lit(0.0))
    return reads.join(spans, "id", "left").select(F.col("id").alias("read_id"), shared.alias("shared"), part.alias("part"))


def _class_sets(spark, sf):
    return materialize(pairs.baskets(read_table(spark, sf, "classes"), "class_id", "refs", "n"), "baskets")


def p5_found(spark, sf):
    return pairs.associated(_class_sets(spark, sf), 0.0005, 8, 5).select(F.col("a").cast("long").alias("ref_a"), F.col("b").cast("long").alias("ref_b"))


def p5_pairs(spark, sf):
    t = pairs.lift_table(_class_sets(spark, sf))
    return t.select(F.col("a").alias("ref_a"), F.col("b").alias("ref_b"), "w_ab", "k_ab", F.round("lift", 6).alias("lift"))


_HITS = """c AS (SELECT upper(seq) AS seq, count(DISTINCT read_id) AS n_rows FROM reads WHERE seq IS NOT NULL GROUP BY 1),
h AS (SELECT seq, n_rows FROM c WHERE n_rows >= greatest(10, 0.002 * (SELECT count(DISTINCT read_id) FROM reads WHERE seq IS NOT NULL)))"""

_SPANS = """w AS (SELECT src, rec_id, i::BIGINT AS pos, substr(s, (i + 1)::INT, 50) AS x FROM
  (SELECT 'name' AS src, tid::BIGINT AS rec_id, name AS s FROM transcripts
   UNION ALL SELECT DISTINCT 'read', read_id, upper(seq) FROM reads) r, unnest(range(0, length(s) - 49)) t(i)),
k AS (SELECT src, x FROM w WHERE src = 'name' OR NOT contains(x, 'N') GROUP BY 1, 2 HAVING count(DISTINCT rec_id) > 1),
h AS (SELECT DISTINCT src, rec_id, pos FROM w SEMI JOIN k USING (src, x)),
b AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY src, rec_id ORDER BY pos) <= 50 THEN 0 ELSE 1 END AS new FROM h),
g AS (SELECT *, sum(new) OVER (PARTITION BY src, rec_id ORDER BY pos) AS island FROM b),
sp AS (SELECT src, rec_id, min(pos) AS span_from, max(pos) + 50 AS span_to FROM g GROUP BY src, rec_id, island)"""

_SETS = """s AS (SELECT class_id, list_sort(list_distinct(any_value(refs))) AS items, max(n) AS n FROM classes WHERE len(refs) > 0 AND n > 0 GROUP BY 1),
t AS (SELECT sum(n) AS total FROM s),
e AS (SELECT class_id, n, unnest(items) AS item FROM s),
m AS (SELECT item, sum(n) AS w FROM e GROUP BY 1),
p AS (SELECT x.item AS a, y.item AS b, sum(x.n) AS w_ab, count(*) AS k_ab FROM e x JOIN e y ON x.class_id = y.class_id AND x.item < y.item GROUP BY 1, 2),
l AS (SELECT a, b, w_ab, k_ab, w_ab * total::DOUBLE / (ma.w::DOUBLE * mb.w) AS lift, total FROM p JOIN m ma ON ma.item = a JOIN m mb ON mb.item = b CROSS JOIN t)"""

QUERIES = {
    "p2_found": (p2_found, f"WITH {_HITS} SELECT seq FROM h"),
    "p2_counts": (p2_counts, f"WITH {_HITS} SELECT seq, n_rows FROM h"),
    "p4_found": (p4_found, f"WITH {_SPANS} SELECT src, rec_id, span_from, span_to FROM sp"),
    "p4_name_shares": (
        p4_name_shares,
        f"""WITH {_SPANS} SELECT tid::BIGINT AS tid, coalesce(n, 0)::BIGINT AS shared, round(coalesce(n, 0) / length(name), 6) AS part FROM transcripts
LEFT JOIN (SELECT rec_id, sum(span_to - span_from) AS n FROM sp WHERE src = 'name' GROUP BY 1) ON rec_id = tid""",
    ),
    "p4_read_shares": (
        p4_read_shares,
        f"""WITH {_SPANS} SELECT read_id, coalesce(n, 0)::BIGINT AS shared, CASE WHEN len > 0 THEN round(coalesce(n, 0) / len, 6) ELSE 0 END AS part FROM (SELECT DISTINCT read_id, length(seq) AS len FROM reads WHERE seq IS NOT NULL)
LEFT JOIN (SELECT rec_id, sum(span_to - span_from) AS n FROM sp WHERE src = 'read' GROUP BY 1) ON rec_id = read_id""",
    ),
    "p5_found": (p5_found, f"WITH {_SETS} SELECT a::BIGINT AS ref_a, b::BIGINT AS ref_b FROM l WHERE w_ab >= 0.0005 * total AND lift >= 8 AND k_ab >= 5"),
    "p5_pairs": (p5_pairs, f"WITH {_SETS} SELECT a AS ref_a, b AS ref_b, w_ab::BIGINT AS w_ab, k_ab, round(lift, 6) AS lift FROM l"),
}
