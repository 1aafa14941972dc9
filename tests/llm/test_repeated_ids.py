"""Different texts under one doc_id."""

from tallyforge.llm import op01_ngram_join as op01


def test_classes_of_one_id_all_link(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    near = b + " more"
    c = " ".join(f"c{i}" for i in range(60))
    rows = [(1, a), (1, b), (5, b), (7, near), (8, a + " end"), (9, c), (-3, c), (-3, "alone in the world of words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = op01.ngram_jaccard_components(docs, 3, 90)
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(-3, -3), (-3, -3), (1, 1), (1, 1), (5, 1), (7, 1), (8, 1), (9, -3)]
