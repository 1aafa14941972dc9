"""Sheets, paged sources, snapshots, candidates, splits and schedules against brute force or golden cases."""

import random
import zipfile
from itertools import combinations
from threading import Event

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyforge.operators import identity, research, rules, state
from tallyforge.sources import files, sheets
from tallyforge.sources.paged import read_paged
from tallyforge.streaming.schedule import poll

CALLS: list = []


def fake_fetch(task, year, month, start, size):
    """Pages of a report of 7 rows in even months, none in odd ones; every first call of a page fails once."""
    import os

    mark = f"/tmp/paged-{os.getppid()}-{task}-{year}-{month}-{start}"
    if not os.path.exists(mark):
        open(mark, "w").close()
        raise OSError("try again")
    os.unlink(mark)
    rows = [{"id": f"{task}{k}", "v": k if k % 2 else None} for k in range(7)] if month % 2 == 0 else []
    return {"total": len(rows), "data": rows[start : start + size]}


def test_paged_source(spark):
    rows = read_paged(spark, "tests.test_gaps:fake_fetch", ["a", "b"], "2023-12", "2024-02", ["id", "v"], page=3, pause=0).collect()
    assert sorted((r.task, r.year, r.month, r.id, r.v) for r in rows) == sorted((t, y, m, f"{t}{k}", str(k) if k % 2 else None) for t in "ab" for y, m in ((2023, 12), (2024, 2)) for k in range(7))


def test_sheets(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/new/x.xlsx"
    df = spark.createDataFrame([("a <&> \"b\"\x01", 1, 1.5, True), (None, None, None, None), (" é\n", -3, float("nan"), False)], "s string, n long, d double, b boolean").coalesce(1)
    assert sheets.write_sheet(df, path) == 3
    got = [tuple(r) for r in sheets.read_sheet(spark, path).collect()]
    assert got == [('a <&> "b"', "1", "1.5", "1"), (None, None, None, None), (" é\n", "-3", "nan", "0")]
    assert sheets.write_sheet(df.limit(0), f"file://{tmp_path}/empty.xlsx") == 0 and sheets.read_sheet(spark, f"file://{tmp_path}/empty.xlsx").count() == 0
    shared = f'<sst xmlns="{sheets._MAIN}"><si><t>name</t></si><si><r><t>x</t></r><r><t>y</t></r></si></sst>'
    rows = f'<worksheet xmlns="{sheets._MAIN}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="C2"><v>5</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "shared.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", shared)
        z.writestr("xl/worksheets/sheet1.xml", rows)
    table = sheets.read_sheet(spark, f"file://{tmp_path}/shared.xlsx")
    assert table.columns == ["name", "_1", "xy"] and [tuple(r) for r in table.collect()] == [(None, None, "5")]


def test_tables_of_more_rows_than_a_sheet(spark, tmp_path):
    path = f"file://{tmp_path}/many"
    df = spark.range(0, 23, 1, 4).selectExpr("id AS `a;b`", "if(id % 2 = 0, concat('<', id), null) AS b", "null AS b").where("id not between 6 and 11")
    for most, sizes in ((5, [5, 5, 5, 2]), (17, [17]), (16, [16, 1]), (1, [1] * 17), (None, [17])):
        assert sheets.write_sheets(df, path, most) == 17
        names = sorted(x.name for x in (tmp_path / "many").iterdir())
        assert names == [f"sheet-{k + 1:05d}.xlsx" for k in range(len(sizes))]
        got = [list(sheets.rows_of(str(tmp_path / "many" / x))) for x in names]
        assert [len(x) - 1 for x in got] == sizes and all(x[0] == ["a;b", "b", "b"] for x in got)
        assert [r for x in got for r in x[1:]] == [[str(i), None if i % 2 else f"<{i}", None] for i in range(23) if not 6 <= i <= 11]
    assert sheets.write_sheets(df, path, 5) == 17
    assert sorted(int(r[0]) for r in sheets.read_sheet(spark, path).toDF("a", "b", "c").collect()) == [i for i in range(23) if not 6 <= i <= 11]
    assert sheets.write_sheets(df.where("false"), path) == 0
    empty = sheets.read_sheet(spark, path)
    assert empty.columns == ["a;b", "b", "b"] and empty.count() == 0
    for most in (0, sheets.SHEET_ROWS + 1):
        with pytest.raises(ValueError, match="a sheet holds"):
            sheets.write_sheets(df, path, most)
    assert [x.name for x in tmp_path.iterdir()] == ["many"]
    sheets.write_sheet(spark.sql("SELECT 1 AS other"), f"{path}/sheet-00002.xlsx")
    with pytest.raises(Exception, match="one header"):
        sheets.read_sheet(spark, path).collect()


def test_sheet_query_on_more_rows_than_a_sheet(spark, tmp_path, monkeypatch):
    """The limit is lowered here, as the smallest tables hold fewer rows than a sheet."""
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(sheets, "SHEET_ROWS", 90)
    part = spark.read.parquet(f"{folder}/part.parquet")
    assert part.count() > 2 * 90
    got = entry.queries()["k3_sheet_sink"](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted((str(r.p_partkey), f'{r.p_name} <&> "x"', str(r.p_size)) for r in part.collect())
    with pytest.raises(Exception, match="a sheet holds 90 rows"):
        sheets.write_sheet(part, f"file://{tmp_path}/one.xlsx")
    assert not list(tmp_path.iterdir())


def test_strict_files_and_splits(spark, tmp_path):
    (tmp_path / "long.csv").write_text("a;b\n1;2\n1;2;3\n")
    with pytest.raises(Exception, match="over 2 fields"):
        files.read_strict(spark, [f"file://{tmp_path}/long.csv"]).collect()
    df = spark.range(24).selectExpr("id", "concat('c', id % 12) AS __category_key")
    with pytest.raises(ValueError, match="confirm"):
        files.write_by_category(df, f"file://{tmp_path}/many")
    assert len(files.write_by_category(df, f"file://{tmp_path}/many", confirmed=True, most_rows=1)) == 12
    assert len(list((tmp_path / "many").glob("_to=c3/*.csv"))) == 2


def test_damaged_snapshots_are_made_again(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", None)], "node string, text string")
    embed = lambda x: x.select("node", F.array(F.lit(1.0)).alias("vector"))
    made = [identity.snapshot(spark, f"file://{tmp_path}", rows, embed, "m")[1] for _ in range(2)]
    [folder] = tmp_path.iterdir()
    for part in (folder / "vectors").glob("part-*"):
        part.unlink()
    assert made == [False, True] and identity.snapshot(spark, f"file://{tmp_path}", rows, embed, "m")[1] is False


def test_lexical_candidates_equal_brute_force(spark):
    from difflib import SequenceMatcher

    rng = random.Random(4)
    words = [f"слово{k}" for k in range(25)]
    titles = {k: " ".join(rng.sample(words, rng.randrange(1, 5))) for k in range(60)}
    found = research.lexical_candidates(spark.createDataFrame(list(titles.items()), "id long, title string"), token_block=8, title_block=2)
    sets = {k: set(t.split()) for k, t in titles.items()}
    size = {w: sum(w in s for s in sets.values()) for w in words}
    same = {t: sum(t == u for u in titles.values()) for t in titles.values()}
    expected = {}
    for a, b in combinations(titles, 2):
        shared = sum(size[w] <= 8 for w in sets[a] & sets[b]) + (titles[a] == titles[b] and same[titles[a]] <= 2)
        both = len(sets[a] & sets[b])
        score = round(max(both / len(sets[a] | sets[b]), 0.65 * both / min(len(sets[a]), len(sets[b])) + 0.35 * SequenceMatcher(None, titles[a], titles[b]).ratio()), 6)
        if shared and score >= 0.46:
            expected[a, b] = (shared, score)
    assert expected and {(r.a, r.b): (r.shared, pytest.approx(r.similarity, abs=2e-6)) for r in found.collect()} == expected
    dropped = {(r.kind, r.value): r.records for r in research.dropped_blocks(spark.createDataFrame(list(titles.items()), "id long, title string"), 2, 8).collect()}
    assert dropped == {("token", w): n for w, n in size.items() if n > 8} | {("title", t): n for t, n in same.items() if n > 2}


def test_supplemental_sources(spark):
    rng = random.Random(5)
    rows = [(k, f"вещь{k % 20} тип{k % 7}", f"b{k % 9}", f"m{k % 3}", float(rng.randrange(1, 3)), 1.0, 1.0) for k in range(200)]
    records = spark.createDataFrame(rows, "id long, title string, brand string, marketplace string, unit_amount double, total_amount double, multipack_count double")
    known = records.select(F.col("id").alias("a"), (F.col("id") + 20).alias("b"))
    budgets = {s: n for s, n in zip(research.SOURCES[1:], (40, 30, 20, 10), strict=True)}
    found = research.supplemental(records, known, budgets, buckets=4).collect()
    by = {r[0]: r for r in rows}
    pairs = [(r.a, r.b) for r in found]
    assert len(set(pairs)) == len(pairs) == 100 and all(a < b and b - a != 20 for a, b in pairs)
    for r in found:
        x, y = by[r.a], by[r.b]
        if r.candidate_source == research.SOURCES[2]:
            assert x[2] == y[2] and x[4] == y[4]
        if r.candidate_source == research.SOURCES[3]:
            assert x[3] != y[3]
    assert found and {r.candidate_source for r in found} == set(budgets)


def test_record_split_drops_only_pairs_between_splits(spark):
    rng = random.Random(6)
    rows = [(f"r{rng.randrange(60)}", f"s{rng.randrange(60)}", rng.random() < 0.15) for _ in range(300)]
    pairs = spark.createDataFrame(rows, "a string, b string, positive boolean")
    kept, dropped = research.record_split(pairs, {"train": 0.6, "dev": 0.2, "test": 0.2})
    assert kept.count() + dropped.count() == 300 and research.leaking(kept).count() == 0
    assert dropped.where("positive").count() == 0 and kept.select("split").distinct().count() == 3
    small = spark.createDataFrame([(f"a{k}", f"b{k}", True) for k in range(40)], "a string, b string, positive boolean")
    kept, dropped = research.record_split(small, {"train": 0.5, "test": 0.5})
    assert kept.count() == 40 and dropped.count() == 0


def test_months_and_schedules():
    assert state.month_iter((2023, 12), (2024, 1)) == [(2023, 12), (2024, 1)] and state.next_month(2023, 12) == (2024, 1)
    with pytest.raises(ValueError, match="after"):
        state.month_iter((2024, 1), (2023, 12))
    stop, done = Event(), []

    def run(one):
        done.append(one)
        if one == "bad":
            raise RuntimeError("no")
        if len(done) >= 5:
            stop.set()

    assert poll(lambda: ["a", "bad"], run, stop, every=0.0) == 3 and done == ["a", "bad", "a", "bad", "a"]


def test_sample_audit(spark):
    rows = [{"active": 1, "priority": p, "category": "", "target_column": "T", "match_field": "n", "match_type": "contains", "pattern": x, "set_value": x, "mode": "fill_empty"} for p, x in ((1, "a"), (2, "ab"), (3, "z"))]
    df = spark.createDataFrame([("ab", "c")] * 9 + [("b", "c")], "n string, `Категория` string")
    found = {r.rule: (r.matched, r.applied, r.reason) for r in rules.sample_audit(df, rules.compiled(rows)).collect()}
    assert list(found.values()) == [(9, 9, "matches_too_many_rows_sample"), (9, 0, "matched_but_never_applied_sample"), (0, 0, "never_matched_sample")]
