"""Scores of whole texts under a 3-gram model that is learnt from a part of them.

Tokens are words between ASCII white space, A-Z lower-cased, and one end per text. The model interpolates counts with Dirichlet weights:

    P1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),  P(w | h) = (c(h w) + m P(w | h')) / (c(h) + m)

where h' is the context without its first word. Contexts begin with a mark before the text.

1. A task takes blocks of texts of about ``BLOCK_BYTES`` and writes the distinct n-grams of a block, as sorted 64-bit keys with their counts
   in the learning part, one blob for each level and shard. A shard is a hash range of contexts; the successors of one context
   are dealt over ``SPREAD`` shards, so a very common context meets in none.
2. A shard adds up the learning counts and builds a trie level: contexts and pointers to their successors as Elias-Fano sequences,
   successors, and quantised frequencies, all memory-mapped. Every blob is then looked up: its context, and among that context's successors its
   word. The codes go back to the block.
3. The block meets its codes and scores its texts. Counts below ``EXACT`` are kept as they are, larger ones on a logarithmic scale with
   steps of 0.05 %; single words keep full counts, which the base score needs.

Contexts of one code (32 bits) are told apart by their shard, which the other half of their hash picks: an n-gram takes the count of another
only if both end in one word and agree in 32 + log2(shards) bits, and never more than its parts have.

The smoothing weights need counts of one level only, so quantised frequencies are stored and smoothed when read. Block ids are hashes of
the block's content; the input must come in the same order in both passes, as a stored table does, and is refused otherwise.

Defined results: a null or empty text is an end alone; a null id learns nothing and is scored; repeated rows count and are scored each;
without learning texts every token has the same probability; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.eliasfano import Level
from tallygrid.llm.textkit import WordHashes, byte_strings, chunks, mix, ranges, starts_of, stored

BLOCK_BYTES = 16 << 20
SPLIT_BYTES = 1 << 20
SLICE = 1 << 15
LEVELS = 3
SPREAD = 16
EXACT = 1 << 14
STEPS_PER_E = 2000
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
ODD = np.uint64(0x9E3779B97F4A7C15)
HALF = np.uint64(32)
LOW = np.uint64(0xFFFFFFFF)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each closed by the end, and the number of tokens of each."""
    # Some texts at a time, since words as objects take many times the bytes of their hashes.
    parts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in chunks(texts, SPLIT_BYTES):
        lists = [t.lower().split() for t in texts[lo:hi]]
        lengths = np.array([len(words) + 1 for words in lists], np.int64)
        flat = np.full(int(lengths.sum()), END)
        inner = np.ones(len(flat), bool)
        inner[np.cumsum(lengths) - 1] = False
        flat[inner] = WordHashes.plain([w for words in lists for w in words])
        parts.append(flat)
        counts.append(lengths)
    return np.concatenate(parts), np.concatenate(counts)


def slices(lengths: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """(texts, tokens) of consecutive texts with about ``SLICE`` tokens together."""
    edges = starts_of(lengths)
    for lo, hi in ranges(lengths.tolist(), SLICE):
        yield slice(lo, hi), slice(edges[lo], edges[hi])


def level_keys(flat: np.ndarray, lengths: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rests) of the 1-, 2- or 3-gram (level 0, 1, 2) that ends at each token; context in the key's high half, word in the low half.

    The rest is the half of the context's hash that the key lacks; it deals the contexts over the shards.
    """
    if level == 0:
        single = mix(flat + ODD)
        return single, single >> HALF
    first = np.cumsum(lengths) - lengths
    one = np.concatenate([[BEGIN], flat[:-1]])
    one[first] = BEGIN
    context = one * ODD
    if level == 2:
        two = np.concatenate([[BEGIN], one[:-1]])
        two[first] = BEGIN
        context = mix(two) * ODD + one
    h = mix(context)
    return (h >> HALF << HALF) | (mix(flat) >> HALF), h & LOW


def shard_of(keys: np.ndarray, rests: np.ndarray, shards: int) -> np.ndarray:
    spread = rests * np.uint64(SPREAD) + (keys & np.uint64(SPREAD - 1))
    return (mix(spread) % np.uint64(shards)).astype(np.int64)


def quantised(counts: np.ndarray) -> np.ndarray:
    codes = np.minimum(counts, EXACT).astype(np.uint16)
    big = np.flatnonzero(counts > EXACT)
    codes[big] = np.minimum(EXACT + np.round(np.log(counts[big] / EXACT) * STEPS_PER_E), 0xFFFF)
    return codes


def counted(codes: np.ndarray) -> np.ndarray:
    counts = codes.astype(np.float64)
    big = np.flatnonzero(codes > EXACT)
    counts[big] = EXACT * np.exp((counts[big] - EXACT) / STEPS_PER_E)
    return counts


def packed(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, byte planes apart."""
    return zstandard.compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes(), 1)


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _changes(values: np.ndarray) -> np.ndarray:
    """Whether each of the sorted values differs from the one before."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return new


def _by_shard(flat: np.ndarray, lengths: np.ndarray, level: int, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, keys, tokens) of a level: the n-grams of each shard that has any, and the tokens they end at, not sorted."""
    keys, shard = np.empty(len(flat), np.uint64), np.empty(len(flat), np.min_scalar_type(shards))
    for texts, at in slices(lengths):
        keys[at], rests = level_keys(flat[at], lengths[texts], level)
        shard[at] = shard_of(keys[at], rests, shards)
    edges = starts_of(np.bincount(shard, minlength=shards))
    order = np.argsort(shard, kind="stable").astype(np.int32 if len(flat) < 1 << 31 else np.int64)
    del shard
    for s in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        at = order[edges[s] : edges[s + 1]]
        yield s, keys[at], at


def _counts(keys: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and how often each was learnt."""
    known, others = np.sort(keys[learnt]), np.sort(keys[~learnt])
    first = np.flatnonzero(_changes(known))
    known, counts = known[first], np.diff(first, append=len(known)).astype(np.uint32)
    others = others[_changes(others)]
    at = np.searchsorted(known, others)
    seen = at < len(known)
    seen[seen] = known[at[seen]] == others[seen]
    return np.insert(known, at[~seen], others[~seen]), np.insert(counts, at[~seen], 0)


def _block(part: pa.RecordBatch) -> tuple[int, list, list[bytes], list[bool]]:
    """(hash, ids, texts, whether each is learnt) of rows with columns id, text, learn."""
    ids, texts, learn = part.column(0).to_pylist(), byte_strings(part.column(1)), part.column(2).to_pylist()
    content = xxhash.xxh3_64(pickle.dumps((ids, [len(t) for t in texts], learn), 5))
    for text in texts:
        content.update(text)
    return int(np.uint64(content.intdigest()).astype(np.int64)), ids, texts, learn


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes], list[bool]]]:
    """Blocks of consecutive rows; those who read them can let a block's texts go before the next."""
    for batch in batches:
        for lo, hi in ranges(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), BLOCK_BYTES):
            yield _block(batch.slice(lo, hi - lo))


def _queries(docs: DataFrame, shards: int) -> DataFrame:
    """(cell, block, keys, counts) of each block, level and shard; cell = level x shards + shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts, learn in _blocks(batches):
            flat, lengths = tokens(texts)
            learnt = np.repeat(np.array(learn, bool), lengths)
            del texts, learn
            for level in range(LEVELS):
                cells, blobs, numbers = [], [], []
                for s, keys, at in _by_shard(flat, lengths, level, shards):
                    distinct, counts = _counts(keys, learnt[at])
                    cells.append(level * shards + s)
                    blobs.append(packed(np.diff(distinct, prepend=np.uint64(0))))
                    numbers.append(packed(counts))
                columns = [pa.array(cells, pa.int64()), pa.array(np.full(len(cells), block)), pa.array(blobs, pa.binary()), pa.array(numbers, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "block", "keys", "counts"])

    return docs.mapInArrow(run, "cell long, block long, keys binary, counts binary")


def _answers(queries: DataFrame, shards: int) -> DataFrame:
    """(block, cell, codes) for every blob of keys; tokens and words learnt, once per shard of the first level."""

    def run(cell: pa.Table) -> pa.Table:
        level = cell.column("cell")[0].as_py() // shards
        parts = [np.cumsum(unpacked(b.as_py(), np.uint64), dtype=np.uint64) for b in cell.column("keys")]
        edges = starts_of([len(p) for p in parts]).tolist()
        keys = np.concatenate(parts)
        del parts
        counts = np.concatenate([unpacked(b.as_py(), np.uint32) for b in cell.column("counts")])
        known, counts = keys[counts > 0], counts[counts > 0]
        order = np.argsort(known)
        known, counts = known[order], counts[order]
        del order
        first = np.flatnonzero(_changes(known))
        total = np.add.reduceat(counts, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
        trie = Level(known[first], quantised(total) if level else total)
        del known, counts
        found = np.empty(len(keys), trie.codes.dtype)
        for a in range(0, len(keys), SLICE):
            found[a : a + SLICE] = trie[keys[a : a + SLICE]]
        codes = [packed(found[a:b]) for a, b in zip(edges, edges[1:])]
        n = len(codes)
        learnt = [int(total.sum()) if level == 0 else 0] + [0] * (n - 1)
        words = [len(total) if level == 0 else 0] + [0] * (n - 1)
        return pa.table([cell.column("block"), cell.column("cell"), pa.array(codes, pa.binary()), pa.array(learnt, pa.int64()), pa.array(words, pa.int64())], ["block", "cell", "codes", "learnt", "words"])

    return queries.groupBy("cell").applyInArrow(run, "block long, cell long, codes binary, learnt long, words long")


def scores(docs: DataFrame, learn: Column, weights: tuple[float, float] = (2.0, 1.0), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: tokens, tokens learnt, learnt tokens in all, base score, model score (log10), and whether it was held out."""
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    size = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // BLOCK_BYTES))
    answers = stored(_answers(_queries(picked, shards), shards), "ngram-codes")
    learnt, words = answers.agg(F.coalesce(F.sum("learnt"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    space = learnt + 0.1 * (words + 1)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, *part in _blocks(batches):
            payload = zstandard.compress(pickle.dumps(tuple(part), 5), 1)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-1], pa.int64()), pa.array([payload], pa.binary())], ["block", "cell", "codes"])

    def frequencies(flat: np.ndarray, lengths: np.ndarray, level: int, codes: dict[int, pa.Scalar]) -> np.ndarray:
        """The code of the n-gram of a level that ends at each token."""
        out = np.empty(len(flat), np.uint16 if level else np.int64)
        for s, keys, at in _by_shard(flat, lengths, level, shards):
            order = np.argsort(keys)
            new = _changes(keys[order])
            blob = codes.get(level * shards + s)
            got = unpacked(blob.as_py(), out.dtype) if blob is not None else []
            if len(got) != np.count_nonzero(new):
                raise ValueError("the texts came in another order than before: store them first")
            out[at[order]] = got[np.cumsum(new) - 1]
        return out

    def run(block: pa.Table) -> pa.Table:
        cells = block.column("cell").to_pylist()
        codes = {c: b for c, b in zip(cells, block.column("codes")) if c >= 0}
        out = []
        for own in [b for c, b in zip(cells, block.column("codes")) if c < 0]:
            ids, parts, learn = pickle.loads(zstandard.decompress(own.as_py()))
            flat, lengths = tokens(parts)
            del parts
            found = [frequencies(flat, lengths, level, codes) for level in range(LEVELS)]
            known, base, score = np.empty(len(ids), np.int64), np.empty(len(ids)), np.empty(len(ids))
            for at, within in slices(lengths):
                one, two, three = (counted(f[within]) if level else f[within].astype(np.float64) for level, f in enumerate(found))
                last = np.cumsum(lengths[at]) - 1
                first = last + 1 - lengths[at]
                ends = one[last]  # texts learnt
                before_one, before_two = np.concatenate([[0], one[:-1]]), np.concatenate([[0], two[:-1]])
                before_one[first], before_two[first] = ends, ends
                two = np.minimum(two, np.minimum(one, before_one))  # no n-gram is more frequent than its parts; more was another's of the same code
                three = np.minimum(three, np.minimum(two, before_two))
                p1 = (one + 0.1) / space
                p2 = (two + weights[0] * p1) / (before_one + weights[0])
                p3 = (three + weights[1] * p2) / (before_two + weights[1])
                known[at] = np.add.reduceat((one > 0).astype(np.int64), first)
                base[at], score[at] = np.add.reduceat(np.log10(p1), first), np.add.reduceat(np.log10(p3), first)
            columns = [pa.array(ids, id_type), pa.array([not x for x in learn]), pa.array(lengths), pa.array(known), pa.array(np.full(len(ids), learnt)), pa.array(base), pa.array(score)]
            out.append(pa.table(columns, names))
        if not out:
            raise ValueError("the texts came in another order than before: store them first")
        return pa.concat_tables(out)

    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = picked.mapInArrow(texts, "block long, cell long, codes binary").union(answers.select("block", "cell", "codes"))
    return rows.groupBy("block").applyInArrow(run, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
