import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallygrid.llm import decontaminate, line_dedup

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_lines(docs, min_docs=5, min_chars=40):
    keys = lambda t: [(x, x.strip(" \t\n\x0b\x0c\r")) for x in t.split("\n")]
    fold = lambda k: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)
    held = defaultdict(set)
    for i, t in docs:
        for k in {fold(k) for _, k in keys(t or "")}:
            held[k].add(i)
    shared = {k: max(v) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for i, t in docs:
        lines = [(x, fold(k)) for x, k in keys(t or "")]
        left = [x for x, k in lines if k not in shared or shared[k] == i]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out)


def test_lines_match_brute_force(small, odd_docs):
    for docs, least in ((small("documents"), 5), (odd_docs, 5), (odd_docs, 2)):
        want = brute_lines([(r.doc_id, r.text) for r in docs.collect()], least)
        assert sorted(tuple(r) for r in line_dedup.line_report(docs, min_docs=least).collect()) == want


def test_lines_with_a_crowded_filter(small, monkeypatch):
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 16)
    monkeypatch.setattr(line_dedup.suspects, "__defaults__", (16,))
    docs = small("documents")
    assert sorted(tuple(r) for r in line_dedup.line_report(docs).collect()) == brute_lines([(r.doc_id, r.text) for r in docs.collect()])


def test_dedup_lines_keeps_columns_and_rows(odd_docs):
    out = line_dedup.dedup_lines(odd_docs)
    assert out.schema == odd_docs.schema and out.count() == odd_docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0] is None and texts[7] == "a\nb" and texts[10] == "" and texts[11].startswith("A line")
    assert line_dedup.dedup_lines(odd_docs.limit(0)).count() == 0


def brute_windows(docs, items, n=10):
    words = lambda t: WORD.findall((t or "").encode().lower())
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i : i + size])].add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for p in range(len(w) - size + 1):
                if (k := tuple(w[p : p + size])) in windows:
                    hit.update(range(p, p + size))
                    found |= windows[k]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def test_matches_brute_force(spark, small, odd_docs):
    items = [(r.item_id, r.text) for r in small("benchmark").collect()]
    own = spark.createDataFrame([(1, "Two, WORDS!"), (2, None), (3, ""), (4, "..."), (5, "word1 rest1 word2 rest2 word3 rest3 word4 rest4 word5 rest5 word6"), (6, "two words")], "item_id long, text string")
    for docs, bench in ((small("documents"), small("benchmark")), (odd_docs, own), (small("documents").union(small("documents")), own)):
        got = decontaminate.matches(docs, bench)
        want = brute_windows([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
        assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got.collect()), key=str) == want
        assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got.collect())
    assert items


def test_items_over_several_sets(small):
    docs, bench = small("documents"), small("benchmark")
    whole = decontaminate.matches(docs, bench).select("doc_id", "n_hit", "items")
    old, decontaminate.windows.__defaults__ = decontaminate.windows.__defaults__, (2000,)
    try:
        parts = decontaminate.matches(docs, bench).select("doc_id", "n_hit", "items")
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    finally:
        decontaminate.windows.__defaults__ = old


def test_remove(spark, odd_docs):
    items = spark.createDataFrame([(1, "two words"), (None, "one")], "item_id long, text string")
    left = decontaminate.remove(odd_docs, items)
    assert left.schema == odd_docs.schema and Counter(r.doc_id for r in left.collect()) == Counter(i for i in [*range(15), 11] if i not in (3, 4))
    cut = {r.doc_id: r.text for r in decontaminate.remove(odd_docs, items, how="spans").collect()}
    assert cut[4] == " " and cut[3] == "" and cut[0] is None and len(cut) == 15
    assert decontaminate.remove(odd_docs, items.limit(0)).count() == odd_docs.count()
    assert decontaminate.matches(odd_docs.limit(0), items).count() == 0
    assert decontaminate.matches(odd_docs, items).where(F.col("doc_id") == 3).first()["items"] == []


def test_repeated_rows_are_one_document(spark):
    line = "a line of more than forty code points, which several rows hold"
    rows = [(9, line), (9, line + "\nx"), (9, line), (9, line), (3, line), (4, "other"), (None, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup.line_report(docs).collect()} == {0}
    assert sorted((r.doc_id or 0, r.n_dropped) for r in line_dedup.line_report(docs, min_docs=2).collect()) == [(0, 1), (3, 1), (4, 0), (9, 0), (9, 0), (9, 0), (9, 0)]
