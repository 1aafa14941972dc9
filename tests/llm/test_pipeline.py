"""The pipeline, stage by stage, against brute-force versions of its stages."""

import random
import re

import corpus_pipeline
from tallyforge.llm import op02_mixing as op02
from tallyforge.llm import op03_quality as op03
from test_operators import brute_components, brute_lines, words

BAD = " nasty nasty"


def _tables(spark, folder):
    rng = random.Random(21)
    items = [(k, words(rng, 30, 5000)) for k in range(4)]
    docs, labels = [], []
    for i in range(600):
        text = "\n".join(words(rng, rng.randrange(8, 25), 800) for _ in range(3))
        if i % 3 == 0:
            text += BAD
        if i % 20 == 7:
            text += "\n" + items[i % 4][1]
        if i % 13 == 5:
            text += "\nthis is the line that all of them share at the end"
        if i % 17 == 4 and docs:
            old = docs[-1][1].split(" ")
            old[3] = "changed"
            text = " ".join(old)
        docs.append((i, text, ["en", "de", "fr"][i % 3], f"src{i % 5}", len(text)))
        if i % 4 != 1:
            labels.append((i, 1, int(BAD in text)))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {d[0]: d[1] for d in docs}, dict(items)


def test_stages_equal_brute_force(spark, tmp_path):
    folder = f"file://{tmp_path}"
    texts, items = _tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, results = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        results[name] = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns[: len(columns)] == columns
    quality = results["quality"]
    right = sum((i in quality) == (BAD not in t) for i, t in texts.items())
    assert right >= 0.95 * len(texts), right
    assert all(texts[i] == t for i, t in quality.items())

    gone = brute_lines(quality.items(), 80, 5)
    cut = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in quality.items()}
    assert results["lines"] == {i: t for i, t in cut.items() if t.strip()}

    lines = results["lines"]
    kept = {i for i, _, c in brute_components(lines.items(), 5, 80) if i == c}
    assert set(results["near_duplicates"]) == kept

    grams = {tuple(w[j : j + 5]): k for k, t in items.items() for w in [re.findall(r"\w+", t.lower())] for j in range(len(w) - 4)}
    clean = set()
    for i in kept:
        w = re.findall(r"\w+", lines[i].lower())
        covered = {}
        for j in range(len(w) - 4):
            if (g := tuple(w[j : j + 5])) in grams:
                covered.setdefault(grams[g], set()).update(g)
        if not any(len(c) >= 0.5 * len(set(items[k].split())) for k, c in covered.items()):
            clean.add(i)
    assert set(results["decontamination"]) == clean

    before = spark.read.parquet(f"{folder}/3")
    drawn = op02.weigh(before, op02.TARGETS, op02.KEEP).where("kept")
    assert set(results["mixing"]) == {r.doc_id for r in drawn.collect()} < clean
    assert {r.doc_id: r.text for r in corpus_pipeline.run(spark, folder).collect()} == results["mixing"]
    assert op03.TOP == 2
