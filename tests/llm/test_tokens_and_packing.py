import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tallygrid.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = tokens.tokenizer(PATH)
WHOLE = tokens.whole_tokens(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aAbz'sStT.!?|<> \n\t019éÉßÿ"), st.characters(exclude_categories=["Cs"]))))
def test_pieces_as_the_library_gives_them(text):
    encoder = tokens.Ids(PATH, WHOLE)
    (got,) = encoder.of([text.encode()])
    assert np.frombuffer(got, encoder.dtype).tolist() == ids(text)


def test_overlapping_merges_and_specials():
    for text in ("aaaa aaaaa hahahahaha ******** !!!!!", "<|endoftext|>x<|startoftext|>", "it's don't WE'LL i'd", "ıİ ΑΣ ſt ﬁ ǅ", "'sword ('tis) «Été», ***É*** x<|y|>"):
        assert tokens.Counts(PATH, WHOLE).of([b"", text.encode(), b" \x0b\t"]).tolist() == [0, len(ids(text)), 0]


def test_counts(small, odd_docs):
    for docs in (small("documents"), odd_docs):
        want = sorted((r.doc_id, len((r.text or "").encode()), len(ids(r.text)), len(ids(r.text)) > 2048) for r in docs.collect())
        assert sorted(map(tuple, tokens.count_tokens(docs, PATH).collect())) == want
    assert tokens.count_tokens(odd_docs.limit(0), PATH).count() == 0


def check_pieces(docs, pieces, size):
    want = sorted((r.doc_id, zlib.crc32(np.array([*ids(r.text), 1], "<u4").tobytes())) for r in docs.collect())
    rows = [r.asDict() for r in pieces.collect()]
    by_sequence, got, open_ = {}, [], {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert len(r["ids"]) == 4 * r["length"]
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0] + [r["length"] for r in own[:-1]]).tolist()
        total = sum(r["length"] for r in own)
        assert total <= size and total & (total - 1) == 0
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        open_.setdefault(r["doc_id"], []).append(r)
    for doc, own in open_.items():
        text = b""
        for r in own:  # repeated documents lie one after another
            assert r["start"] == len(text) // 4
            text += r["ids"]
            if len(text) == 4 * r["doc_tokens"]:
                got.append((doc, zlib.crc32(text)))
                text = b""
        assert not text
    assert sorted(got) == want


def test_packing_is_exact(small, odd_docs):
    for docs in (small("documents"), odd_docs):
        check_pieces(docs, packing.pack(docs, PATH), 2048)
    check_pieces(odd_docs, packing.pack(odd_docs, PATH, size=64), 64)
    assert packing.pack(odd_docs.limit(0), PATH).count() == 0


def test_hilbert_curve_is_a_walk():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = packing.hilbert_keys(points, bits)
        assert sorted(keys.tolist()) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()
