"""The classifier without labels, and its bound on features."""

import random

from tallyforge.llm import op03_quality as op03


def _docs(spark, n):
    rng = random.Random(n)
    return spark.createDataFrame([(i, " ".join(f"w{rng.randrange(50)}" for _ in range(30)) + (" nasty" if i % 2 else "")) for i in range(n)], "doc_id long, text string")


def test_all_documents_stay_without_labels(spark):
    docs = _docs(spark, 20)
    for labels in ([], [(None, 1, 0)], [(99, 1, 0)]):
        assert op03.select(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 20


def test_fit_takes_no_more_features_than_it_may(spark):
    docs = _docs(spark, 200)
    labels = docs.selectExpr("doc_id", "1 as quality", "cast(doc_id % 2 as int) as toxic")
    whole, few = (op03.train(docs, labels, op03.GRADE, op03.TOP, most_features=n) for n in (1 << 30, 2000))
    assert len(few.used) < len(whole.used)
    got = {r.doc_id: r.tail_probability for r in op03.score(docs, whole).collect()}
    assert all((p >= 0.5) == (i % 2 == 0) for i, p in got.items())
    again = op03.train(docs.repartition(7), labels, op03.GRADE, op03.TOP)
    assert again.used.tolist() == whole.used.tolist() and again.weights.tolist() == whole.weights.tolist()
