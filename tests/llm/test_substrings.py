import random
import re

import pytest

from tallygrid.llm import substrings


def brute(rows, length):
    """Per row: words, and which of them a window covers that starts in a document with a smaller id too."""
    first = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for s in range(len(words) - length + 1 if i is not None else 0):
            key = tuple(words[s : s + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for s in range(len(words) - length + 1 if i is not None else 0):
            if first[tuple(words[s : s + length])] < i:
                gone.update(range(s, s + length))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def run(spark, rows, length, parts=4, schema="doc_id long, text string"):
    out = substrings.remove_repeats(spark.createDataFrame(rows, schema).repartition(parts), length)
    return [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.repeats), r.text or "") for r in out.collect()]


def key(row):
    return tuple(str(x) for x in row)


@pytest.mark.parametrize("length", [4, 20, 50])
def test_against_brute_force(spark, length):
    rng = random.Random(length)
    passages = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(length - 2, 2 * length + 9))] for _ in range(12)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += [f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, length))]
            own = list(rng.choice(passages[:3] if i % 3 else passages))
            if rng.random() < 0.3:
                own[rng.randrange(len(own))] = "changed"
            words += own
        rows.append((rng.randrange(120), " ".join(words)))
    rows += [(7, "x " * 300), (9, "x " * 120 + "y " * 90), (3, "y " * 80), (None, "x " * 200)]
    assert sorted(run(spark, rows, length), key=key) == sorted(brute(rows, length), key=key)


def test_odd_documents(spark, odd_docs):
    got = substrings.remove_repeats(odd_docs)
    assert got.columns == [*odd_docs.columns, "n_words_", "repeats"]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = sorted(brute(rows, 50), key=key)
    assert sorted(((r.doc_id, r.n_words_, sum(s.end - s.start for s in r.repeats), r.text or "") for r in got.collect()), key=key) == want
    assert run(spark, [], 50) == []


def test_spans_are_maximal(spark):
    text = " ".join(f"a{i}" for i in range(200))
    rows = [("a", text), ("b", "new words " + text + " end"), ("c", text[:500] + " b " + text[500:])]
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string"))
    found = {r.doc_id: [(s.start, s.end) for s in r.repeats] for r in out.collect()}
    assert found["a"] == [] and found["b"] == [(2, 202)]
    assert sum(b - a for a, b in found["c"]) >= 198


def test_one_passage_in_every_document(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"start{i} " * (i % 7) + passage + f" end{i}") for i in range(400)]
    got = run(spark, rows, 50)
    assert sorted(got, key=key) == sorted(brute(rows, 50), key=key)
    assert all(n == (0 if i == 0 else 60) for i, _, n, _ in got)
