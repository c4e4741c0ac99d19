import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallygrid.llm import phrases, quotient


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 255), st.integers(0, 255), st.integers(1, 700)), max_size=80), st.sampled_from([8, 20, 32, 44, 64]), st.integers(0, 6))
def test_filters_lose_nothing(rows, bits, range_bits):
    high, low = (np.array([r[i] * (1 << (bits - 8)) // (1 + r[1] % 3) for r in rows], np.uint64) for i in (0, 1))
    counts = np.array([r[2] for r in rows], np.int64)
    mixed = quotient.permute(high, low, bits)
    assert all((a == b).all() for a, b in zip(quotient.restore(*mixed, bits), (high, low)))
    whole = quotient.tally(*mixed, counts, bits)
    want = Counter()
    for h, l, c in zip(*(x.tolist() for x in mixed), counts.tolist()):
        want[h, l] += c
    back = [quotient.decode(quotient.encode(part, bits, range_bits), bits, range_bits, at) for at, part in quotient.ranges(whole, bits, range_bits)]
    got = {(h, l): c for p in back for h, l, c in zip(p.high.tolist(), p.low.tolist(), p.counts.tolist())}
    assert got == dict(want)
    ones = quotient.tally(*mixed, None, bits)
    assert dict(zip(zip(ones.high.tolist(), ones.low.tolist()), ones.counts.tolist())) == dict(Counter(zip(*(x.tolist() for x in mixed))))


def brute(rows, min_count, limit):
    f = {}
    total = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = f.setdefault(lang, Counter())
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                own.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, own in f.items():
        wanted = {p: a for p, a in own.items() if len(p) > 1 and a >= min_count}
        inside = Counter()
        for q, a in wanted.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    inside[q[i : i + m]] = max(inside[q[i : i + m]], a)
        scored = []
        for p, a in wanted.items():
            score, _, l, r = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            if 100 * inside[p] < 80 * a:
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:limit])]
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Ünder", "漢字", "A.B", "x\tY", "é"]
    made = []
    for i in range(300):
        own = [rng.choice(words[: 8 if i % 3 else 35]) for _ in range(rng.randrange(0, 60))]
        made.append((rng.choice(["en", "en", "de", None, "und"]), "".join(w + rng.choice([" ", " ", " ", ", ", "\n", "  ", "\x0b"]) for w in own)))
    return made + [("en", None), ("en", ""), (None, " \t "), ("en", "one common phrase here; " * 400), ("en", "One Common phrase there " * 40)]


@pytest.mark.parametrize("sizes", [{}, {"task_words": 5}, {"entries": 512, "fan_bits": 2}, {"entries": 64, "fan_bits": 16}])
def test_against_brute_force(spark, sizes):
    rows = texts(3)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, score string").repartition(5)
    got = phrases.collocations(frame, limit=50, **sizes)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 30, 50)


def test_empty(spark, odd_docs):
    assert phrases.collocations(odd_docs.limit(0)).collect() == []
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in phrases.collocations(odd_docs).collect()) == brute(rows, 30, 2000)


@pytest.mark.parametrize("bits, values", [(34, 30), (34, 1 << 9), (62, 1 << 31)])
def test_wide_keys_that_differ_in_the_last_bits_only(bits, values):
    rng = np.random.default_rng(bits)
    high, low, counts = (rng.integers(0, top, 20_000).astype(np.uint64) for top in (values, values, 5))
    pairs, of = np.unique(np.stack([high, low], 1), axis=0, return_inverse=True)
    for own in (None, counts.astype(np.int64)):
        got = quotient.tally(high, low, own, bits)
        assert (got.high == pairs[:, 0]).all() and (got.low == pairs[:, 1]).all()
        assert (got.counts == np.bincount(of.ravel(), own)).all()


def test_merging_frees_the_parts():
    """Parts and their copy together took an executor beyond its memory once keys pass 64 bits."""
    ones = quotient.tally(np.arange(5, dtype=np.uint64), np.zeros(5, np.uint64), None, 34)
    parts = [ones, ones]
    assert quotient.merged(parts, 34).counts.tolist() == [2] * 5 and not parts
