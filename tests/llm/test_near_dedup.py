import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import near_dedup, sketches
from tallygrid.llm.components import components
from tallygrid.llm.textkit import WordHashes


def brute(docs, width, percent):
    """Components over all pairs: smallest id of each."""
    sets, root = {}, {}
    for i, text in docs:
        words = (text or "").encode().lower().split()
        sets.setdefault(i, []).append({tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
        root[i] = i
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    flat = [(i, s) for i, own in sets.items() for s in own if s]
    for n, (i, a) in enumerate(flat):
        for j, b in flat[:n]:
            common = len(a & b)
            if 100 * common >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}, {i: [len(s) for s in own] for i, own in sets.items()}


def chain_docs(spark):
    """A base, copies of it with changed words, copies of copies, exact copies, and texts that share nothing."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 200)]
    rows = []
    for i in range(120):
        words = list(base)
        for k in rng.integers(0, 200, 1 + i % 12):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    last = base
    for i in range(120, 150):
        last = [f"y{i}" if k == (i * 7) % 200 else w for k, w in enumerate(last)]
        rows.append((i, " ".join(last)))
    rows += [(i, " ".join(f"z{i}_{k}" for k in range(50))) for i in range(150, 170)] + [(i, " ".join(base)) for i in range(170, 200)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("cell_rows", [4096, 16])
def test_components_match_all_pairs(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(near_dedup, "CELL_ROWS", cell_rows)
    docs = chain_docs(spark)
    want, sizes = brute([(r.doc_id, r.text) for r in docs.collect()], 3, 85)
    got = near_dedup.duplicates(docs, 3, 0.85).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == sizes[r.doc_id][0] and r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_texts(odd_docs):
    want, _ = brute([(r.doc_id, r.text if r.doc_id not in (5, 6, 14) else r.text[:0] + f"stand in {0 if r.doc_id != 6 else 0}") for r in odd_docs.collect()], 5, 80)
    got = {r.doc_id: r for r in near_dedup.duplicates(odd_docs).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert [got[i].n_shingles for i in range(5)] == [0, 0, 0, 1, 1]
    kept = near_dedup.keep_first(odd_docs)
    assert kept.schema == odd_docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in [*range(15), 11] if want[i] == i)
    assert near_dedup.duplicates(odd_docs.limit(0)).count() == 0


def test_null_id(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    rows = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.duplicates(docs, 3, 0.85).collect()}
    assert rows == {None: (None, True), 1: (1, True), 2: (1, False)}


def test_texts_of_one_id_share_a_component(spark):
    rows = [(5, "a b c d"), (5, "x y z w"), (3, "x y z w"), (8, "a b c d"), (9, ""), (9, "q r s t"), (2, "q r s t"), (7, ""), (7, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, _ = brute(rows, 3, 85)
    want = {**want, 5: 3, 8: 3}
    got = near_dedup.duplicates(docs, 3, 0.85).collect()
    assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)
    assert sorted(r.doc_id for r in near_dedup.keep_first(docs, 3, 0.85).collect()) == [2, 3, 6, 7, 7]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for n, share in ((2000, 0.9), (300, 0.5), (12, 0.75)):
        common = rng.integers(0, 1 << 62, int(n * share)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 62, n - len(common)).astype(np.uint64)])) for _ in range(2))
        similarity = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = sketches.sketch([a, b], 512)
        assert (x != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        assert abs((x == y).mean() - similarity) < 5 * np.sqrt(similarity * (1 - similarity) / 512)
    count, rows = sketches.bands(256, 0.85)
    assert count * rows <= 256 and (1 - 0.85**rows) ** count <= 1e-6
    assert [len(s) for s in sketches.shingle_sets([b"", b"A b", b"a B", b"a b c d"], 3, WordHashes())] == [0, 1, 1, 2]


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long").where(F.lit(True))).count() == 0
