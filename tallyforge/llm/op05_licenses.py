"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

DataFrame functions only. Templates fall into classes of length; for a class of at most S words, windows of 2 S words
start every S words, so each occurrence lies within one. A window is the set of its three-word shingles. If it contains
``least`` of a template's shingles, their Jaccard is at least a known J (the class's smallest template against a full
window), and with ``b`` bands of one MinHash the chance to miss it is (1 - J)^b; b is chosen so that this is below
``miss``. Retrieved templates are verified by exact containment.

Before windows are hashed, texts and windows that can't hold a template are left out, without loss: for each template a
few words are chosen such that more than ``1 - least`` of its shingles have one of them; a match has one too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.shared import Scratch

# Notices by which texts state their license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
SHINGLE = 3


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def _shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def anchors(templates: Mapping[str, str], least: float) -> list[str]:
    """Words one of which every match has: longest first, as many as more than ``1 - least`` of the shingles need."""
    out: set[str] = set()
    for text in templates.values():
        words = words_of(text)
        shingles, hit = _shingles(words), set()
        for w in sorted(set(words), key=lambda w: (w not in out, -len(w), w)):
            if len(hit) > (1 - least) * len(shingles) + 1e-9:
                break
            out.add(w)
            hit |= {s for s in shingles if w in s}
    return sorted(out)


def classes(templates: Mapping[str, str], least: float, miss: float) -> list[tuple[int, dict[str, str], int]]:
    """(stride, templates, bands) by length: a class holds templates of over stride / 2 to stride words."""
    out: dict[int, dict[str, str]] = {}
    for name, text in templates.items():
        n = len(words_of(text))
        out.setdefault(max(8, 1 << math.ceil(math.log2(n))), {})[name] = text
    found = []
    for stride, group in sorted(out.items()):
        full = 2 * stride - SHINGLE + 1
        low = min(least * len(_shingles(words_of(t))) / (full + (1 - least) * len(_shingles(words_of(t)))) for t in group.values())
        found.append((stride, group, math.ceil(math.log(miss) / math.log(1 - low))))
    return found


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_NORMAL = "trim(regexp_replace(lower(coalesce({0}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))"


def _hashes(words: str) -> str:
    """SQL: distinct shingle hashes of an array of words; fewer words than a shingle are one shingle."""
    return f"array_distinct(transform(sequence(0, greatest(size({words}) - {SHINGLE}, 0)), i -> xxhash64(array_join(slice({words}, i + 1, {SHINGLE}), ' '))))"


def _bands(shingles: str, bands: int) -> str:
    return f"transform(sequence(1, {bands}), b -> struct(b AS band, array_min(transform({shingles}, x -> xxhash64(x, b))) AS low))"


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = 0.8, miss: float = 1e-7) -> DataFrame:
    """doc_id, license, containment, first_window of each document and template that one of its windows contains:
    containment is the best share of the template's shingles in a window, first_window the word where the first
    matching window starts.

    A null, empty or blank text matches nothing. Rows that repeat a doc_id (null too) give one row a license, the best
    of them. Templates of fewer than three words aren't allowed. Other columns are ignored.
    """
    spark = docs.sparkSession
    if any(len(words_of(t)) < SHINGLE for t in templates.values()):
        raise ValueError(f"a template needs {SHINGLE} words")
    own = lambda group: "array(" + ", ".join(_quoted(w) for w in anchors(group, least)) + ")"
    base = docs.select("doc_id", F.expr(f"split({_NORMAL.format('text')}, ' ')").alias("w")).where(f"arrays_overlap(w, {own(templates)})")
    base = Scratch(spark, "licenses").keep(base, "texts")  # each class reads the few texts that are left
    out = None
    for stride, group, bands in classes(templates, least, miss):
        values = ", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in group.items())
        known = spark.sql(f"SELECT license, split({_NORMAL.format('text')}, ' ') AS w FROM VALUES {values} AS t(license, text)")
        known = known.select("license", F.expr(_hashes("w")).alias("t")).select("license", "t", F.expr(f"inline({_bands('t', bands)})"))
        windows = base.select("doc_id", F.expr(f"explode(transform(sequence(0, greatest(size(w) - 1, 0), {stride}), s -> struct(s, slice(w, s + 1, {2 * stride}) AS w)))").alias("x"))
        windows = windows.where(f"arrays_overlap(x.w, {own(group)})").select("doc_id", F.col("x.s").alias("s"), F.expr(_hashes("x.w")).alias("h"))
        met = windows.select("doc_id", "s", "h", F.expr(f"inline({_bands('h', bands)})")).join(F.broadcast(known), ["band", "low"])
        met = met.withColumn("containment", F.expr("size(array_intersect(h, t)) / cast(size(t) as double)")).where(F.col("containment") >= least)
        part = met.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("s").cast("long").alias("first_window"))
        out = part if out is None else out.union(part)
    return out.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first_window").alias("first_window"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against all templates."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    rows = ", ".join("('{}', '{}', {})".format(n, t.replace("'", "''"), s) for s, g, _ in classes(TEMPLATES, 0.8, 1e-7) for n, t in g.items())
    return f"""
WITH t0(license, text, s) AS (VALUES {rows}),
tw AS (SELECT license, s, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM t0),
t AS (SELECT DISTINCT license, s, unnest(list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1:i + 3], ' '))) AS g FROM tw),
n AS (SELECT license, count(*) AS n FROM t GROUP BY license),
dw AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents),
d AS (SELECT doc_id, unnest(list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1:i + 3], ' '))) AS g, unnest(range(len(w) - 2)) AS p FROM dw WHERE len(w) > 2),
m AS (SELECT doc_id, license, s, d.g, p FROM d JOIN t ON t.g = d.g),
k AS (SELECT doc_id, license, s, g, p, p // s AS k FROM m UNION ALL SELECT doc_id, license, s, g, p, p // s - 1 FROM m WHERE p >= s),
c AS (SELECT doc_id, license, k * s AS a, count(DISTINCT g) AS c FROM k WHERE p <= k * s + 2 * s - 3 GROUP BY ALL)
SELECT doc_id, c.license, CAST(max(c / n) AS DOUBLE) AS containment, CAST(min(a) AS BIGINT) AS first_window
FROM c JOIN n USING (license) WHERE c / n >= 0.8 GROUP BY doc_id, c.license
"""


SQL = _sql()
