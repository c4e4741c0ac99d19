import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import ngrams, quality, topk
from tallygrid.llm.eliasfano import EliasFano, Level

def learnt():
    return F.crc32(F.col("doc_id").cast("string")) % 10 != 0


def brute_scores(docs, weights=(2.0, 1.0)):
    texts = [(i, [*(t or "").encode().lower().split(), 0]) for i, t in docs]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts]
    one, two, three, learnt = Counter(), Counter(), Counter(), 0
    grams = lambda w: zip([1, 1, *w], [1, *w], w)
    for (_, w), h in zip(texts, held):
        if not h:
            learnt += 1
            for u, v, x in grams(w):
                one[x] += 1
                two[v, x] += 1
                three[u, v, x] += 1
    total, words = sum(one.values()), len(one)
    before = lambda v: learnt if v == 1 else one[v]
    before_two = lambda u, v: learnt if v == 1 else two[u, v]
    for (i, w), h in zip(texts, held):
        base = score = 0.0
        for u, v, x in grams(w):
            p = (one[x] + 0.1) / (total + 0.1 * (words + 1))
            base += math.log10(p)
            p = (two[v, x] + weights[0] * p) / (before(v) + weights[0])
            score += math.log10((three[u, v, x] + weights[1] * p) / (before_two(u, v) + weights[1]))
        yield i, h, len(w), sum(one[x] > 0 for x in w), total, pytest.approx(base, rel=1e-9), pytest.approx(score, rel=1e-6)


@pytest.mark.parametrize("block", [16 << 20, 20_000])
def test_scores_match_counts(small, odd_docs, monkeypatch, block):
    monkeypatch.setattr(ngrams, "BLOCK_BYTES", block)
    for docs in (small("documents"), odd_docs):
        docs = docs.coalesce(1)
        key = lambda r: (r[0], r[2])
        got = sorted((tuple(r) for r in ngrams.scores(docs, learnt()).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=key)
        assert got == sorted(brute_scores([(r.doc_id, r.text) for r in docs.collect()]), key=key)


def test_contexts_of_one_code_are_told_apart(spark, monkeypatch):
    """Word pairs that agree in 32 bits of their hash, seen or not, do not take each other's counts."""
    monkeypatch.setattr(ngrams, "BLOCK_BYTES", 8)
    words = [b"w%d" % i for i in range(600)]
    hashes = ngrams.WordHashes().of(words)
    two, one = np.repeat(hashes, len(words)), np.tile(hashes, len(words))
    codes = ngrams.mix(ngrams.mix(two) * ngrams.ODD + one) >> ngrams.HALF
    order = np.argsort(codes, kind="stable")
    same = np.flatnonzero(codes[order][1:] == codes[order][:-1])[:6]
    pairs = [tuple(f"{words[i // 600].decode()} {words[i % 600].decode()}" for i in (order[s], order[s + 1])) for s in same]
    assert len(pairs) == 6
    learn = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(200) if not zlib.crc32(str(i).encode()) % 10]
    texts = [t for a, b in pairs for t in (f"{a} x", f"{b} y", f"{b.split()[1]} x")]
    rows = [*zip(learn, texts), *zip(held, [f"{b} x" for _, b in pairs])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r) for r in ngrams.scores(docs, learnt()).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect())
    assert got == sorted(brute_scores(rows), key=lambda r: r[0])


class Steps:
    """Takes the place of a table and gives the function that a task runs."""

    def mapInArrow(self, run, schema):
        return run

    def groupBy(self, *names):
        return self

    def applyInArrow(self, run, schema):
        return run


def test_a_block_of_text_takes_little_memory():
    """Beyond its input, a task holds a few numbers for each token of a block or of a shard, not dozens."""
    rng, shards = np.random.default_rng(0), 4
    texts = [" ".join(f"w{i}" for i in (300_000 * rng.random(1_000) ** 3).astype(int)) for _ in range(1_000)]
    docs = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts, "learn": [i % 10 > 0 for i in range(len(texts))]})
    asked, tokens = ngrams._queries(Steps(), shards), 1_001_000
    tracemalloc.start()
    cells = pa.Table.from_batches(asked(iter([docs])))
    assert tracemalloc.get_traced_memory()[1] < 100 * tokens
    answer = ngrams._answers(Steps(), shards)
    for level in range(3):
        cell = cells.slice(level * shards, 1)
        assert cell.column("cell")[0].as_py() == level * shards
        keys = sum(len(ngrams.unpacked(b.as_py(), np.uint32)) for b in cell.column("counts"))
        begun = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        answer(cell)
        assert tracemalloc.get_traced_memory()[1] - begun < 180 * keys
    tracemalloc.stop()


def test_scores_of_nothing(odd_docs):
    assert ngrams.scores(odd_docs.limit(0), learnt()).count() == 0
    rows = ngrams.scores(odd_docs.coalesce(1), F.lit(False)).collect()
    assert all(r.held_out and r.n_known == 0 and r.score == pytest.approx(0.0) for r in rows)


def test_elias_fano_and_level():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 0), (1, 1 << 40), (5000, 300), (5000, 1 << 33), (3000, 3000)):
        values = np.sort(rng.integers(0, top + 1, n))
        coded = EliasFano(values)
        if n:
            assert (coded.get(np.arange(n)) == values).all()
        for probe in (values, values + 1, rng.integers(0, 2 * top + 2, 500)):
            place = coded.find(probe)
            assert ((place >= 0) == np.isin(probe, values)).all() and (values[place[place >= 0]] == probe[place >= 0]).all()
    keys = np.unique(rng.integers(0, 1 << 20, 4000).astype(np.uint64) << np.uint64(20))
    codes = np.arange(1, len(keys) + 1)
    level = Level(keys, codes)
    assert (level[keys] == codes).all() and (level[keys + np.uint64(1)] == 0).all()
    assert (Level(keys[:0], codes[:0])[keys] == 0).all()
    counts = np.array([0, 1, 5, 16383, 16384, 10**6, 10**9])
    assert np.allclose(ngrams.counted(ngrams.quantised(counts)), counts, rtol=3e-4)


def brute_top(rows, asks, k):
    usable = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, top = [], (1 << 63) - 1
    for at, (q, own) in enumerate(usable):
        if asks(q):
            scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for other, (i, v) in enumerate(usable) if other != at)
            out += [(q, r, i, max(-top - 1, min(top, -s))) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=12).astype(np.float32)]) for i in range(300)]
    rows += [(i, rows[i % 7][1]) for i in range(300, 340)]  # ties
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 12), (403, [float("inf")] * 12), (None, [1.0] * 12), (404, []), (420, [1.0, 2.0])]
    rows += [(5, [0.0] * 12), (5, rows[5][1]), (410, [1e6] * 12), (410, [1e6] * 11 + [-1e6]), (415, [1.0] * 11 + [-1e9])]  # repeated ids, large numbers
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score long")
    got = topk.search(frame.repartition(3), F.col("vec_id") % 5 == 0, 4)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, lambda i: i % 5 == 0, 4)
    assert topk.search(frame.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert topk.search(frame.where("vec_id = 10"), F.col("vec_id") % 5 == 0).count() == 0
    few = rows[:30] + [(100, [1e30] * 12)]
    named = spark.createDataFrame([(f"n{i}", v) for i, v in few], "vec_id string, embedding array<double>")
    got = topk.search(named, F.col("vec_id").endswith("0"), 3)
    assert sorted(tuple(r) for r in got.collect()) == brute_top([(f"n{i}", v) for i, v in few], lambda i: i.endswith("0"), 3)


def test_max_score_leaves_rows_and_probes_out():
    rng = np.random.default_rng(2)
    vectors = np.floor(256 * rng.normal(size=(3000, 16)) * np.geomspace(1, 0.01, 16))
    shard = topk.Shard(list(range(3000)), np.arange(3000), [v.astype("<f8").tobytes() for v in vectors])
    scores = vectors.astype(np.int64) @ vectors.astype(np.int64).T
    for q in range(40):
        want = sorted((-int(s), i) for i, s in enumerate(scores[q]) if i != q)[:5]
        for threshold in (None, -want[4][0]):
            assert shard.best(q, vectors[q].astype("<f8").tobytes(), 5, threshold) == [(-s, i) for s, i in want]
        assert shard.best(q, vectors[q].astype("<f8").tobytes(), 5, 1 - want[0][0]) == []
    assert shard.candidates < 0.6 * 120 * 3000 and shard.probes < 0.3 * 120 * 3000 * 16


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    rows = quality.scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    shuffled = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).repartition(5)
    first, again = ({r.doc_id: r.score for r in quality.scores(x, labels).collect()} for x in (docs, shuffled))
    assert first == again


def test_quality_odd_input(spark, odd_docs):
    labels = spark.createDataFrame([(i, i % 2 if i != 9 else None, 0) for i in range(15)] + [(3, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.scores(odd_docs, labels).collect()
    assert len(out) == odd_docs.count() and len({r.score for r in out if r.doc_id in (0, 1)}) == 1
    none = quality.scores(odd_docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    ones = quality.scores(odd_docs, labels.where("quality = 1")).collect()
    assert len({r.score for r in ones}) == 1 and ones[0].score > 0.5
    assert quality.scores(odd_docs.limit(0), labels).count() == 0
    assert quality.keep_good(odd_docs, odd_docs, labels.limit(0)).schema == odd_docs.schema
