"""Collocations: phrases of two to four words that occur more often than their parts suggest, counted in quotient filters.

Texts have A-Z lower-cased and are split into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. All counts are per language.

1. Words are counted. A phrase that occurs ``min_count`` times has only words that do, so these alone get a number; others part a piece.
2. Each task packs the word numbers of its n-grams into keys and counts them in quotient filters, one per range of permuted keys
   (see ``quotient``). Filters of a range are merged over all tasks, and what reaches ``min_count`` is unpacked. No n-gram is lost or
   mistaken for another. The number of ranges follows the number of words, so a merge holds a bounded part.
3. Frequent phrases are joined with the counts of their parts; those within a longer phrase that is nearly as frequent go.

The ``TASK_WORDS`` most frequent words are broadcast, with at most ``WORD_BYTES`` bytes each; numbers of other frequent words reach their
places by joins. Defined results: a null text is empty; a null language is ``und``; rows may repeat and count as often as they
are there; ids and other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm import quotient
from tallygrid.llm.textkit import byte_strings, starts_of, stored
from tallygrid.operators.ordered import row_numbers

#: Words in the broadcast, at most, and bytes of each.
TASK_WORDS = 300_000
WORD_BYTES = 128
#: Entries of a task's filters before they are given on, and of a merge, about.
ENTRIES = 1 << 21
#: More ranges than 2 to this power are merged in two rounds.
FAN_BITS = 16
LONGEST = 4

FOLD = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words, with a line end between pieces; there are empty ones between."""
    return text.translate(FOLD).replace(b"\n", b" \n ").split(b" ")


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, f) over all texts."""

    def given(counts: dict[str, Counter]) -> pa.RecordBatch:
        rows = [(lang, word.decode(), n) for lang, own in counts.items() for word, n in own.items() if word not in (b"", b"\n")]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), byte_strings(batch.column(1))):
                counts.setdefault(lang, Counter()).update(tokens(text))
            if sum(map(len, counts.values())) > ENTRIES // 8:
                yield given(counts)
                counts = {}
        yield given(counts)

    return texts.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


class Numbers(dict):
    """Numbers of the words of a language; 0 for others and between pieces, -1 for no word."""

    def __init__(self):
        super().__init__({b"": -1, b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        return 0

    def of(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return found[found >= 0]


def _placed(texts: DataFrame, shared, rest: DataFrame) -> DataFrame:
    """The texts with the numbers of frequent words that are not in the broadcast: array of (place, number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, langs, words, places = [], [], [], []
            for doc, lang, text in zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), byte_strings(batch.column(1))):
                known = shared.value.get(lang, {})
                own = [w for w in tokens(text) if w]
                at = [i for i, w in enumerate(own) if w != b"\n" and w not in known]
                docs += [doc] * len(at)
                langs += [lang] * len(at)
                words += [own[i].decode() for i in at]
                places += at
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(places, pa.int32())], ["doc", "lang", "word", "at"])

    keyed = texts.withColumn("doc", F.xxhash64("lang", "text"))
    found = keyed.dropDuplicates(["doc"]).mapInArrow(run, "doc long, lang string, word string, at int").join(rest, ["lang", "word"])
    lists = found.groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("at", "id")).alias("more"))
    return keyed.join(lists.hint("shuffle_hash"), F.col("doc") == F.col("of"), "left").select("lang", "text", "more")


def _filters(texts: DataFrame, shared, bits: int, range_bits: int) -> DataFrame:
    """(range, shard, blob): filters of the n-grams of each task; ``shard`` is a number of the filter's set."""
    word = np.uint64(bits // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, loose, size = [], [], 0

        def give() -> pa.RecordBatch:
            whole = quotient.merged(parts, bits)
            rows = [(at, quotient.encode(part, bits, range_bits)) for at, part in quotient.ranges(whole, bits, range_bits)]
            shard = int(whole.low[: 1 << 10].sum() & np.uint64((1 << 31) - 1))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([shard] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["range", "shard", "blob"])

        def count():
            ids = np.concatenate(loose)
            loose.clear()
            high, low = [], []
            for n in range(2, LONGEST + 1):
                grams = [ids[i : len(ids) - n + 1 + i] for i in range(n)] if len(ids) >= n else []
                if not grams:
                    continue
                full = np.logical_and.reduce([g > 0 for g in grams])
                w = [g[full].astype(np.uint64) for g in [*[np.zeros_like(grams[0])] * (LONGEST - n), *grams]]
                high.append(w[0] << word | w[1])
                low.append(w[2] << word | w[3])
            if high:
                parts.append(quotient.tally(*quotient.permute(np.concatenate(high), np.concatenate(low), bits), None, bits))

        for batch in batches:
            more = batch.column(2) if batch.num_columns > 2 else None
            for i, (lang, text) in enumerate(zip(batch.column(0).to_pylist(), byte_strings(batch.column(1)))):
                own = shared.value.get(lang, Numbers()).of(tokens(text))
                if more is not None and more[i].is_valid:
                    values = more[i].values
                    own[values.field(0).to_numpy()] = values.field(1).to_numpy()
                loose += [own, np.zeros(1, np.int64)]
                size += len(own) + 1
                if size > ENTRIES // 8:
                    count()
                    size = 0
                    if sum(map(len, parts)) > ENTRIES:
                        parts[:] = [quotient.merged(parts, bits)]
                        if len(parts[0]) > ENTRIES // 2:
                            yield give()
                            parts.clear()
        if loose:
            count()
        if sum(map(len, parts)):
            yield give()

    return texts.mapInArrow(run, "range long, shard long, blob binary")


def _merge_filters(filters: DataFrame, bits: int, range_bits: int, finer: int) -> DataFrame:
    """Filters of one range and shard merged and cut into ranges of ``finer`` bits."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        at = key[0].as_py()
        whole = quotient.merged([quotient.decode(b, bits, range_bits, at) for b in group.column("blob").to_pylist()], bits)
        rows = [(r, quotient.encode(part, bits, finer)) for r, part in quotient.ranges(whole, bits, finer)]
        return pa.table({"range": pa.array([r[0] for r in rows], pa.int64()), "shard": pa.array([0] * len(rows), pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    shards = 1 << (finer - range_bits)
    return filters.withColumn("shard", F.pmod("shard", F.lit(shards))).groupBy("range", "shard").applyInArrow(run, "range long, shard long, blob binary")


def _frequent(filters: DataFrame, bits: int, range_bits: int, min_count: int) -> DataFrame:
    """(p, f): word numbers of n-grams that occur ``min_count`` times, and how often."""
    word, mask = np.uint64(bits // 2), np.uint64((1 << (bits // 2)) - 1)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        at = key[0].as_py()
        whole = quotient.merged([quotient.decode(b, bits, range_bits, at) for b in group.column("blob").to_pylist()], bits)
        often = whole.counts >= min_count
        high, low = quotient.restore(whole.high[often], whole.low[often], bits)
        w = np.stack([high >> word, high & mask, low >> word, low & mask], 1).astype(np.int64)
        real = w > 0
        lists = pa.ListArray.from_arrays(pa.array(starts_of(real.sum(1)).astype(np.int32)), pa.array(w[real]))
        return pa.table({"p": lists, "f": pa.array(whole.counts[often])})

    return filters.groupBy("range").applyInArrow(run, "p array<long>, f long")


def phrase_counts(docs: DataFrame, min_count: int = 30, lang_col: str = "lang", text_col: str = "text", task_words: int = TASK_WORDS, entries: int = ENTRIES, fan_bits: int = FAN_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases (p, f) as lists of word numbers, single words included; words (id, lang, word, f); totals (lang, n)."""
    spark = docs.sparkSession
    texts = _texts(docs, text_col, lang_col)
    counts = stored(word_counts(texts), "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    often = counts.where(F.col("f") >= min_count).withColumn("key", F.concat_ws("\0", "lang", "word"))
    words = stored(row_numbers(often, "f", "id", tie="key", descending=True).drop("key"), "words")
    facts = words.agg(F.count(F.lit(1)).alias("words"), F.sum("f").alias("f")).first()
    known = (F.col("id") <= task_words) & (F.octet_length("word") <= WORD_BYTES)
    numbers: dict[str, Numbers] = {}
    for r in words.where(known).collect():
        numbers.setdefault(r.lang, Numbers())[r.word.encode()] = r.id
    shared = spark.sparkContext.broadcast(numbers)
    if sum(map(len, numbers.values())) - 2 * len(numbers) < facts.words:
        texts = _placed(texts, shared, words.where(~known).select("lang", "word", "id"))
    bits = 2 * max(8, facts.words.bit_length())
    range_bits = min(bits, max(0, ((facts.f or 0) * (LONGEST - 1) // entries).bit_length()))
    coarse = min(range_bits, fan_bits)
    filters = _filters(texts, shared, bits, coarse)
    if coarse < range_bits:
        filters = _merge_filters(filters, bits, coarse, range_bits)
    phrases = _frequent(filters, bits, range_bits, min_count).union(words.select(F.array("id"), "f"))
    return stored(phrases, "phrases"), words, totals


def collocations(
    docs: DataFrame, min_count: int = 30, limit: int = 2000, scale: int = 2_000_000, within_pct: int = 80, lang_col: str = "lang", text_col: str = "text", **sizes: int
) -> DataFrame:
    """The ``limit`` phrases of each language with the highest scores: lang, rank, phrase, a, l, r, n, score.

    ``a``, ``l`` and ``r`` count the phrase and the two parts of its weakest cut; the score is scale · a / (l + r), rounded down.
    """
    phrases, words, totals = phrase_counts(docs, min_count, lang_col, text_col, **sizes)
    longer = phrases.where(F.size("p") >= 2)
    cuts = longer.select("p", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size(p) - 1)")).alias("k"))
    cuts = cuts.select("p", "a", "k", F.expr("slice(p, 1, k)").alias("pl"), F.expr("slice(p, k + 1, size(p) - k)").alias("pr"))
    for side in ("l", "r"):
        cuts = cuts.join(phrases.select(F.col("p").alias(f"p{side}"), F.col("f").alias(side)), f"p{side}")
    score = F.expr(f"cast(a as decimal(20,0)) * {scale} div (l + r)")
    weakest = cuts.groupBy("p").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, size(p) - 1), m -> transform(sequence(1, size(p) - m + 1), i -> slice(p, i, m))))")
    around = phrases.where(F.size("p") >= 3).select(F.explode(inner).alias("p"), "f").groupBy("p").agg(F.max("f").alias("around"))
    kept = weakest.join(around, "p", "left").where(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * within_pct))
    spelt = kept.select("p", F.posexplode("p").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    spelt = spelt.groupBy("p").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = kept.join(spelt, "p").join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
