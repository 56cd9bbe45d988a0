from strandloom.llm import leakage as L
from tests.llm.test_leakage import corpus, truth


def test_runs_are_found_whatever_their_cosine(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    rows = L.leaks(d, i, "doc_id", "text", "item_id", "text", cosine=0.95).collect()
    assert {(r.doc_id, r.item_id) for r in rows if r.run >= 12} == truth(docs, items)
