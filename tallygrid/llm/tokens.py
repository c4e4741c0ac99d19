"""Token counts by the whole-token shortcut, and token ids of whole texts, both as the tokenizer's library gives them.

The tokenizer splits at white space before anything else, so a text is a sequence of pieces between ASCII white space
and each piece has its own tokens. Offline, every vocabulary string is put through the library; those that come back
as one token are *whole*. A pre-token found among them counts as one token; only the rest is merged, by the ranks in the tokenizer's file.
Pieces with characters beyond ASCII and Latin-1 letters, and special strings, go to the library itself. What a piece has come to is
remembered within the task, up to a fixed number of pieces.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings inside a text are what the library makes of
them; texts of any length are counted whole; repeated rows each give a row; columns beside the named ones are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tallygrid.llm.textkit import MAX_CACHED_WORDS, byte_strings, chunks, starts_of

#: Pre-tokens of lower-cased text, as the tokenizer file states them (a fixed value).
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Pieces whose normalization is plain lower-casing: printable ASCII and composed Latin-1 letters. The library sees all others whole.
PLAIN = regex.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
#: Printable ASCII without letters and digits.
MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
END_OF_WORD = "</w>"

#: Spark's tasks already fill the cores.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Kept while a worker lives, so that later tasks find known pieces.
_counters: dict[str, Counts] = {}


def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def whole_tokens(path: str) -> dict[str, int]:
    """Vocabulary strings that, encoded alone, are one token, and its id. Bounded by the vocabulary."""
    t = tokenizer(path)
    alphabet = {c: b for b, c in zip(range(256), _byte_letters())}
    words = []
    for key in t.get_vocab(with_added_tokens=False):
        raw = bytes(alphabet[c] for c in key.removesuffix(END_OF_WORD) if c in alphabet)
        try:
            word = raw.decode()
        except UnicodeDecodeError:  # part of a character: never a pre-token
            continue
        if PLAIN.fullmatch(word) and PRE_TOKEN.fullmatch(word):
            words.append(word)
    return {w: e.ids[0] for w, e in zip(words, t.encode_batch(words, add_special_tokens=False)) if len(e.ids) == 1}


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Pieces(dict):
    """What each piece comes to, filled for a group of texts at a time."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)

    def coded(self, texts: list[bytes]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        """For groups of texts: what their distinct pieces come to, the number of each piece in order, where each text begins."""
        for lo, hi in chunks(texts):
            lists = pc.ascii_split_whitespace(pa.array(texts[lo:hi], pa.binary()).cast(pa.string()))
            pieces = lists.values.dictionary_encode()
            seen = pieces.dictionary.cast(pa.binary()).to_pylist()  # an empty piece, at the ends of a text, has no tokens
            if len(self) + len(seen) > 2 * MAX_CACHED_WORDS:
                self.clear()
            values = list(map(self.get, seen))
            new = [i for i, v in enumerate(values) if v is None]
            self.learn([seen[i] for i in new])
            for i in new:
                values[i] = self[seen[i]]
            yield values, pieces.indices.to_numpy(), lists.offsets.to_numpy()

    def learn(self, new: list[bytes]) -> None:
        raise NotImplementedError


class Merger:
    """Byte-pair merges of many lower-cased pre-tokens at a time.

    Every round merges in each word the pair of lowest rank, wherever it stands. A pair made by a merge ranks after that merge, so the
    order within a round does not matter.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = len(vocabulary)
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), order
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        letters = _byte_letters()
        self.single = np.array([vocabulary[c] for c in letters], np.int64)
        self.last = np.array([vocabulary[c + END_OF_WORD] for c in letters], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[np.minimum(at, len(self.ranks) - 1)], len(self.ranks))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words (none is empty), one after another, and where each begins."""
        none = len(self.ranks)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8)
        tokens, ends = self.single[letters], np.cumsum(lengths) - 1
        tokens[ends] = self.last[letters[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        finished = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        rank = np.full(len(tokens), none)
        stale = np.flatnonzero(word[1:] == word[:-1])  # places whose pair with the next token is new
        while len(tokens):
            rank[stale] = self._rank(tokens[stale], tokens[stale + 1])
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            spans = np.diff(np.append(first, len(tokens)))
            done = np.repeat(least == none, spans)
            finished.append((word[done], tokens[done]))
            least = np.repeat(least, spans)
            hit = np.flatnonzero((rank == least) & ~done)
            if len(hit) > 1:  # of overlapping pairs every second one, from the left
                run = np.concatenate([[True], np.diff(hit) != 1])
                start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            tokens[hit] = self.made[rank[hit]]
            keep = ~done
            keep[hit + 1] = False
            rank[hit] = none
            changed = np.zeros(len(tokens), bool)
            changed[hit] = True
            tokens, word, rank, changed = tokens[keep], word[keep], rank[keep], changed[keep]
            changed[:-1] |= changed[1:]
            stale = np.flatnonzero(changed[:-1] & (word[1:] == word[:-1]))
        owner, tokens = (np.concatenate(parts) for parts in zip(*finished))
        order = np.argsort(owner, kind="stable")
        return tokens[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


class Learned(Pieces):
    """Pieces by their pre-tokens: whole ones from the table, the rest merged; the library sees pieces that are not plain."""

    def __init__(self, path: str, whole: dict[str, int]):
        super().__init__(path)
        self.merger = Merger(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.whole = {w.encode(): np.array([i], self.dtype).tobytes() for w, i in whole.items()}

    def value(self, ids: bytes):
        raise NotImplementedError

    def learn(self, new: list[bytes]) -> None:
        plain, cores, heads, tails, several, odd = [], [], [], [], {}, []
        for piece in new:
            if piece.isalpha():  # ASCII letters only
                core, head, tail = piece.lower(), b"", b""
            else:
                after = piece.lstrip(MARKS)
                core = after.rstrip(MARKS)
                head, tail = piece[: len(piece) - len(after)], after[len(core) :]
                if not core.isalpha() or b"'" in head or b"<|" in piece:
                    text = piece.decode()
                    if not PLAIN.fullmatch(text) or "<|" in text:
                        odd.append(piece)
                        continue
                    if not text.isalpha():
                        several[piece] = [p.encode() for p in PRE_TOKEN.findall(text.lower())]
                        continue
                    core, head, tail = text.lower().encode(), b"", b""
                else:
                    core = core.lower()
            plain.append(piece)
            cores.append(core)
            heads.append(head)
            tails.append(tail)
        need = {*cores, *heads, *tails, *(p for parts in several.values() for p in parts)}
        need.discard(b"")
        known = self.known(list(need.difference(self.whole)))
        known.update((p, self.whole[p]) for p in need.intersection(self.whole))
        known[b""] = b""
        for piece, core, head, tail in zip(plain, cores, heads, tails):
            self[piece] = self.value(known[head] + known[core] + known[tail])
        for piece, parts in several.items():
            self[piece] = self.value(b"".join([known[p] for p in parts]))
        for piece, e in zip(odd, self.tokenizer.encode_batch_fast([p.decode() for p in odd], add_special_tokens=False)):
            self[piece] = self.value(np.array(e.ids, self.dtype).tobytes())

    def known(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of lower-cased pre-tokens by merging."""
        tokens, begin = self.merger.merge(words)
        ids = tokens.astype(self.dtype).tobytes()
        at = (begin * self.dtype.itemsize).tolist()
        return {p: ids[a:b] for p, a, b in zip(words, at, at[1:])}


class Counts(Learned):
    def value(self, ids: bytes) -> int:
        return len(ids) // self.dtype.itemsize

    def of(self, texts: list[bytes]) -> np.ndarray:
        parts = [np.zeros(0, np.int64)]
        for values, codes, begin in self.coded(texts):
            parts.append(np.diff(starts_of(np.array(values, np.int64)[codes])[begin]))
        return np.concatenate(parts)


class Ids(Learned):
    """Token ids of pieces as little-endian bytes of ``dtype``."""

    def value(self, ids: bytes) -> bytes:
        return ids

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        for values, codes, begin in self.coded(texts):
            flat = np.frombuffer(b"".join(values), self.dtype)
            sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
            length = sizes[codes]
            ends = starts_of(length)
            shift = starts_of(sizes)[codes] - ends[:-1]
            ids = flat[np.repeat(shift, length) + np.arange(ends[-1])]
            at = ends[begin].tolist()
            yield from (ids[a:b].tobytes() for a, b in zip(at, at[1:]))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: UTF-8 bytes, tokens, and whether the tokens exceed ``limit``."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counts(path, whole.value)
        counts = _counters[path]
        for batch in batches:
            texts = byte_strings(batch.column(1))
            n = counts.of(texts)
            columns = [pa.array(np.fromiter(map(len, texts), np.int64, len(texts))), pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
