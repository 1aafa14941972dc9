"""Each training-data operator against a brute-force version or a planted case, and on odd tables."""

import hashlib
import itertools
import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import op01_ngram_join as op01
from tallyforge.llm import op02_mixing as op02
from tallyforge.llm import op03_quality as op03
from tallyforge.llm import op04_line_dedup as op04
from tallyforge.llm import op05_licenses as op05
from tallyforge.llm import op06_fingerprints as op06
from tallyforge.llm import op07_pii as op07
from tallyforge.llm import op08_html as op08
from tallyforge.llm import op09_warc as op09
from tallyforge.llm import op10_decontaminate as op10
from tallyforge.llm.shared import Scratch, components, mix_keys, probes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, _gone string, probability double"


def documents(spark, rows):
    """(id, text) rows with more columns, some of which have names that operators use."""
    return spark.createDataFrame([(i, t, "en" if i is None or i % 2 else None, f"src{(i or 0) % 3}", len(t or ""), "x", "y", 0.5) for i, t in rows], SCHEMA)


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}x" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    long = words(rng, 30_000, 9000)
    return documents(spark, [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (5, long), (6, words(rng, 60)), (None, "null id text of some words"), (7, "é ü ß"), (8, "\n\n")]).repartition(2)


# 1


def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {(i, len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "percent", "size"), [(3, 90, 4096), (5, 80, 3)])
def test_ngram_join_equals_brute_force(spark, n, percent, size):
    rng = random.Random(n)
    base = [words(rng, 80) for _ in range(6)]
    rows = []
    for i in range(150):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(30)}"
        rows.append((i, " ".join(w) if i % 10 else ["", "a b", "A  B", "one two three"][i // 10 % 4]))
    found = op01.ngram_jaccard_components(documents(spark, rows), n, percent, group_size=size, queries_per_task=5)
    assert {tuple(r) for r in found.collect()} == brute_components(rows, n, percent)


def test_ngram_join_on_odd_rows(spark, odd):
    rows = [tuple(r) for r in op01.ngram_jaccard_components(odd).collect()]
    assert len(rows) == odd.count()
    assert {r for r in rows if r[0] in (1, 2, 3, 8)} == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (8, 0, 8)}
    assert len([r for r in rows if r[0] == 5 and r[2] == 5]) == 2
    assert [r[2] for r in rows if r[0] is None] == [None]
    assert op01.ngram_jaccard_components(odd.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rng = random.Random(1)
    text = words(rng, 100)
    rows = [(i, text) for i in range(4)] + [(9, words(rng, 100)), (None, text)]
    kept = op01.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (True, 0), (True, 9)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 40), (40, 45), (60, 60)]
    found = components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "t")
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(1, 21)} | {(45, 40), (50, 40)}


# 2


def test_raking_meets_all_margins():
    rng = np.random.default_rng(1)
    table = rng.integers(1, 100, (3, 4, 2)).astype(float)
    targets = [np.array([0.5, 0.3, 0.2]), np.full(4, 0.25), np.array([0.9, 0.1])]
    raked = op02.rake(table, targets)
    for k, t in enumerate(targets):
        assert np.allclose(raked.sum(axis=tuple(a for a in range(3) if a != k)), t)


def test_mixing_keeps_the_budget_and_draws_alike(spark):
    rng = random.Random(2)
    docs = documents(spark, [(i, words(rng, 50)) for i in range(600)])
    targets = {"source": {"src0": 1.0, "src1": 1.0, "src2": 2.0}, "lang": {"en": 0.7}, "topic": {}}
    rows = op02.weigh(docs, targets, 0.5).collect()
    assert len(rows) == 600
    total = sum(r.n_words for r in rows)
    assert abs(sum(r.n_words * r.probability for r in rows) / total - 0.5) < 0.01
    by = {s: sum(r.n_words * r.probability for r in rows if r.source == s) for s in ("src0", "src2")}
    assert abs(by["src2"] / by["src0"] - 2) < 0.05
    kept = op02.sample(docs, targets, 0.5)
    assert kept.columns[:-1] == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def test_mixing_on_odd_rows(spark, odd):
    assert op02.weigh(odd, op02.TARGETS, 0.5).count() == odd.count()
    assert op02.weigh(odd.limit(0), op02.TARGETS, 0.5).count() == 0
    assert op02.sample(odd.where("text is null"), op02.TARGETS, 0.5).count() == 0


# 3


def test_classifier_learns_held_out_grades(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        bad = i % 3
        text = words(rng, 60) + {0: "", 1: " nasty", 2: " ###junk### !!"}[bad] + " " + words(rng, 20)
        rows.append((i, text))
        labels.append((i, int(bad != 2), int(bad == 1)))
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = op03.train(docs, marks.where("doc_id < 600"), op03.GRADE, op03.TOP)
    got = {r.doc_id: r for r in op03.score(docs.where("doc_id >= 600"), model).collect()}
    right = sum((got[i].tail_probability >= 0.5) == (i % 3 == 0) for i in got)
    assert right >= 0.97 * len(got)
    assert all(0 <= r.expected_grade <= 2 for r in got.values())


def test_classifier_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, None), (6, None, 1), (None, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    chosen = op03.select(odd, labels)
    assert chosen.columns == odd.columns
    model = op03.train(odd, labels, op03.GRADE, op03.TOP)
    assert op03.score(odd, model, "s", "t").count() == odd.count()
    empty = op03.train(odd.limit(0), labels.limit(0), op03.GRADE, op03.TOP)
    assert op03.score(odd.limit(0), empty).count() == 0


# 4


def brute_lines(rows, percent, least):
    seen, out = [], set()
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            s = {x for x in re.split(r"[\x20\x09-\x0d]+", line.lower()) if x}
            if len(s) >= least:
                if any(100 * len(s & o) >= percent * len(s | o) for o in seen):
                    out.add((i, k))
                seen.append(s)
    return out


@pytest.mark.parametrize("hot", [1 << 18, 40])
def test_line_dedup_equals_brute_force(spark, hot):
    rng = random.Random(hot)
    base = [words(rng, n, 60) for n in (5, 6, 9, 14, 30, 60) for _ in range(4)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randrange(5)):
            w = rng.choice(base).split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(20)}"
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    found = op04.matched_lines(documents(spark, rows), first_tries=1, hot=hot)
    assert {tuple(r) for r in found.collect()} == brute_lines(rows, 80, 5)


def test_line_dedup_on_odd_rows(spark, odd):
    out = op04.dedup_lines(odd)
    assert out.columns == odd.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in odd.collect()}
    rows = [(1, "a b c d e f\nkeep this line here now"), (2, "A b c d e  f\nother words stand in this"), (3, "a b c d e f")]
    left = {r.doc_id: (r.text, r.n_chars) for r in op04.dedup_lines(documents(spark, rows)).collect()}
    assert left == {1: (rows[0][1], len(rows[0][1])), 2: ("other words stand in this", 25)}
    assert op04.dedup_lines(odd.limit(0)).count() == 0


def test_verification_cuts_only_wanted_lines_into_words(monkeypatch):
    class Rows:
        def mapInArrow(self, run, schema):  # noqa: N802
            self.run = run
            return self

    def sent(*keys):
        table = np.zeros(1 << 12, np.uint8)
        for probe in np.concatenate(probes(mix_keys(*(np.array(k) for k in keys)), 1 << 15)).tolist():
            table[probe >> 3] |= 1 << (probe & 7)
        return SimpleNamespace(value=table)

    texts = ["", "x y z\n\nsome Words some", None, "\n last line \n", "x y z", "\n"]
    cut, plain = [], op04.tk.words
    monkeypatch.setattr(op04.tk, "words", lambda data, offsets: cut.append(len(data)) or plain(data, offsets))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["doc_id", "text"])
    wanted = [(1, 2), (3, 1), (5, 1)]
    run = op04._token_arrays(Rows(), SimpleNamespace(value=np.zeros(1 << 10, np.uint32)), sent([1, 3, 5]), sent(*zip(*wanted, strict=True))).run
    got = {(r["doc_id"], r["line"]): set(r["tokens"]) for out in run(iter([batch])) for r in out.to_pylist()}
    one = {w: int(plain(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)])).hash.view(np.int64)[0]) for w in ("some", "words", "last", "line")}
    assert got == {(1, 2): {one["some"], one["words"]}, (3, 1): {one["last"], one["line"]}}
    assert sum(cut) == len("some Words some") + len(" last line ")


def test_lines_with_words_are_numbered_as_split_does():
    rng = random.Random(5)
    for _ in range(200):
        texts = ["".join(rng.choice("ab \n\té") for _ in range(rng.choice((0, 0, 1, 3, 12)))) for _ in range(rng.randrange(6))]
        raw = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        w = op04.tk.words(np.frombuffer(b"".join(raw), np.uint8), offsets)
        at, text, number = op04._lines(w, offsets)
        want = [(t, k, len(line.split())) for t, x in enumerate(texts) for k, line in enumerate(x.split("\n")) if line.split()]
        assert list(zip(text.tolist(), number.tolist(), np.diff(np.append(at, len(w.start))).tolist(), strict=True)) == want


# 5


def test_license_scan(spark, odd):
    rng = random.Random(5)
    planted = list(op05.TEMPLATES.items())
    rows = [(k, f"{words(rng, rng.randrange(80))}. {t}! {words(rng, rng.randrange(80))}") for k, (_, t) in enumerate(planted)] + [(99, words(rng, 200))]
    found = {(r.doc_id, r.license): r.containment for r in op05.scan(documents(spark, rows)).collect()}
    for k, (name, _) in enumerate(planted):
        assert found[k, name] == 1.0
    assert not any(d == 99 for d, _ in found)
    assert op05.scan(odd).count() == 0
    assert op05.scan(odd.limit(0)).count() == 0


# 6


def test_fingerprints_equal_brute_force(spark, odd):
    rng = random.Random(6)
    rows = [(3 * i, "".join(rng.choice("abcdefgh é\U0001f600") for _ in range(rng.choice((0, 1, 3, 8, 9, 10, 40, 400))))) for i in range(60)]
    found = {r.doc_id: r for r in op06.fingerprints(documents(spark, rows), rows_per_range=4).collect()}
    m = op06._multipliers(64)
    sign = lambda s: op06.entries(op06.numbered_kmers(np.frombuffer(s.encode("utf-32-le"), np.uint32), 9), m, 2)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        a, b, c = sign(t), sign(edited), sign(after)
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (op06._hex(a), op06._hex(b))
        assert (r.near_edited, r.near_next) == (op06.likeness(a, b), op06.likeness(a, c))
    assert op06.fingerprints(odd, rows_per_range=2).count() == odd.count()
    assert op06.fingerprints(odd.limit(0)).count() == 0
    assert op06.fingerprints(odd.where("doc_id = 4")).first().near_next == 1.0


def test_fingerprints_feel_order():
    m = op06._multipliers(64)
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij ") for _ in range(2000))
    p = lambda s: op06.entries(op06.numbered_kmers(np.frombuffer(s.encode("utf-32-le"), np.uint32), 9), m, 2)
    moved = text[1000:] + text[:1000]
    assert op06.likeness(p(text), p(moved)) < 0.75 < op06.likeness(p(text), p(text[:1990]))


# 7

_RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, rule in _RULES.items():
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], op07._RANK[s[2]]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(7)
    for _ in range(30_000):
        text = "".join(rng.choice("12 3.4-0@a.b@+() _%é9") for _ in range(rng.randrange(40)))
        assert op07.base_spans(text) == brute_spans(text), text


def test_repeated_tokens_share_labels(spark, odd):
    text = "Call +1 (988) 555-2485 or +1 (988) 555-2485. Later (988) 555-2485 was asked, and 12 of 30."
    docs = documents(spark, [(i, text) for i in range(30)] + [(100, "no data, room 12")])
    rows = {r.doc_id: r for r in op07.find(docs).collect()}
    assert rows[100].spans == "" and rows[100].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[0].n_phone == 2
    spans = rows[0].spans.split(",")
    assert len(spans) == 3 and spans[2].startswith("phone:") and text[int(spans[2].split(":")[1]) :].startswith(("555-2485", "(988) 555-2485"))
    assert op07.find(odd).count() == odd.count()
    assert op07.find(odd.limit(0)).count() == 0


def test_spans_of_long_runs_take_linear_time():
    import time

    start = time.process_time()
    op07.base_spans("1" * 300_000 + " " + "a" * 300_000 + "@" + "+1" * 100_000 + "1." * 100_000)
    assert time.process_time() - start < 20


# 8

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div id="cookie-banner"><p>We use cookies for the best of all.</p></div><aside><p>Related things of the day and more</p></aside>
<article><h1>The &amp; title</h1><p>First <b>bold</b>&nbsp;text <script>x("</p>")</script>of the
 article<br>goes on.<p>Short.</p><div class="ad">Buy it for the best price of all now</div><ul><li>one<li>two</ul><form><label>Mail</label><input></form>
<section id="comments"><p>I think that this is the best of it all</p></section></article><footer>&copy; the owner</footer></body></html>"""


def test_main_text():
    assert op08.main_text(PAGE) == "The & title\nFirst bold text of the article goes on.\nShort.\none\ntwo"
    assert op08.main_text("") == ""
    assert op08.main_text("<p>a < b &lt; c</p>") == "a < b < c"
    assert op08.main_text("<div><p>" + "The way of the world is that it was and will be for all. " * 6 + "</p></div><div><a href=x>one</a> <a href=y>two</a></div>").startswith("The way")
    assert op08.main_text("<" * 5000 + "'" * 5000 + '"<p>' * 2000) is not None


def test_extract_on_odd_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (None, None, "<p>x</p>", 2), (2, "u", "", 3), (2, "u", "", 3)], "page_id long, url string, html string, text long")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in op08.extract(pages).collect()) == [(0, "x", 1), (1, "", 0), (2, "", 0), (2, "", 0)]
    assert op08.extract(pages.limit(0)).count() == 0


# 9


def test_archives_round_trip(spark):
    rng = random.Random(9)
    bodies = ["", "<p>é</p>", "x" * 5, words(rng, 4000), "a\r\n\r\nWARC/1.0\r\n"]
    rows = [(i, f"http://h/{i}\n" if i % 3 else None, bodies[i % 5]) for i in range(40)] + [(None, "n", "x" * 5), (7, "again", bodies[2]), (41, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    scratch = Scratch(spark, "warc-test")
    archives = op09.write_archives(pages, scratch.path("a"), most_bytes=30_000)
    op09.normalise_archives(archives, scratch.path("a"), scratch.path("b"))
    found = op09.read_pages(archives, scratch.path("b")).collect()
    assert sorted((r.page_id if r.page_id is not None else -1, r.url or "", r.payload_bytes) for r in found) == sorted((i if i is not None else -1, u or "", len((t or "").encode())) for i, u, t in rows)
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for r in found:
        text = next(t or "" for i, u, t in rows if i == r.page_id and u == r.url)
        lead = first.get(text)
        if r.page_id is None or r.page_id == lead:
            assert (r.record_type, r.refers_to, r.html) == ("response", None, text)
        else:
            assert (r.record_type, r.refers_to, r.html) == ("revisit", lead, None)
    assert op09.write_archives(pages.limit(0), scratch.path("c")).count() == 0


def test_a_monolithic_file_is_split_into_members(tmp_path):
    writer = op09.MonolithicWriter(f"file://{tmp_path}/m")
    for i in range(5):
        writer.write(op09.page_record(i, f"http://h/{i}", b"x" * i * 1000, None))
    name = writer.close()
    assert op09.normalise(f"file://{tmp_path}/m", name, f"file://{tmp_path}/n") == 5
    import zlib

    data = (tmp_path / "n" / name).read_bytes()
    for at, length, record_id in op09.read_index(f"file://{tmp_path}/n", name):
        assert record_id.encode() in zlib.decompress(data[at : at + length], 31)


# 10


def brute_coverage(item, text, least):
    """Greedy tiling by trying every pair of positions."""
    free_p, free_t, covered = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                k = 0
                while p + k < len(item) and t + k < len(text) and free_p[p + k] and free_t[t + k] and item[p + k] == text[t + k]:
                    k += 1
                best = max(best, (k, -p, -t))
        k, p, t = best[0], -best[1], -best[2]
        if k < least:
            return covered
        covered += k
        free_p[p : p + k] = free_t[t : t + k] = [False] * k


def test_tiling_equals_brute_force():
    rng = random.Random(10)
    for _ in range(60):
        item = np.array([rng.randrange(12) for _ in range(rng.randrange(5, 30))], np.uint64)
        text = np.concatenate([item[10:], np.array([rng.randrange(12) for _ in range(20)], np.uint64), item[:10]])
        tiles = op10.tile(item, text, 3)
        assert len({x for p, _, k in tiles for x in range(p, p + k)}) == sum(k for *_, k in tiles)
        assert sum(k for *_, k in tiles) == brute_coverage(item.tolist(), text.tolist(), 3)


def test_reordered_passages_are_caught(spark, odd):
    rng = random.Random(11)
    items = [(k, words(rng, 40, 3000)) for k in range(5)]
    w = items[1][1].split()
    rows = [(1, words(rng, 50) + " " + items[0][1].upper() + ", " + words(rng, 50)), (2, " ".join(w[20:] + words(rng, 9).split() + w[:20])), (3, words(rng, 300, 3000)), (4, " ".join(w[:12]))]
    bench = spark.createDataFrame([*items, (9, None), (10, ""), (None, "x y z"), (11, "only two")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.share for r in op10.coverage(documents(spark, rows), bench, block_words=60).collect()}
    assert found == {(1, 0): 1.0, (2, 1): 1.0}
    kept = op10.decontaminate(documents(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {3, 4}
    assert op10.coverage(odd, bench).count() == 0
    assert op10.coverage(odd.limit(0), bench).count() == 0
    assert op10.coverage(odd, bench.limit(0)).count() == 0
