"""The text operators as queries over the standard tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm import decontaminate, line_dedup, near_dedup, ngrams, packing, pages, phrases, quality, substrings, tokens, topk, warc, whitening
from tallygrid.llm.textkit import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


SQL_WINDOWS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
occ AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS k
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT o.doc_id, o.i, o.size, x.item_id FROM occ o JOIN win x ON o.k = x.k AND o.size = x.size),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)"""


@query("op7_decontaminate", SQL_WINDOWS)
def op7_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate.matches(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.count_tokens(table(spark, d, "documents"), WORD_BPE)


SQL_LINES = r"""
WITH lines AS (SELECT doc_id, line, pos, translate(trim(line, E' \t\n\u000b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS line, generate_subscripts(string_split(coalesce(text, ''), E'\n'), 1) AS pos FROM documents)),
shared AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, s.k IS NOT NULL AND l.doc_id <> s.keeper AS gone FROM lines l LEFT JOIN shared s ON l.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query("op6_line_dedup", SQL_LINES)
def op6_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.line_report(table(spark, d, "documents"))


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    return quality.scores(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op10_packing")
def op10_packing(spark: SparkSession, d: str) -> DataFrame:
    return packed(table(spark, d, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, WORD_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op5_minhash_near_dedup")
def op5_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_dedup.duplicates(table(spark, d, "documents"), width=3, threshold=0.85)


SQL_TOP = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.r <> v.r WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


@query("op9_exact_top_k", SQL_TOP)
def op9_exact_top_k(spark: SparkSession, d: str) -> DataFrame:
    return topk.search(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0)


SQL_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
bits AS (SELECT page_id, html, array_to_string(list_transform(string_split(sha1(html), ''),
  lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', c) - 3, 4)), '') AS b FROM p),
dig AS (SELECT page_id, html, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
  + 16 * CAST(substr(b, 5 * i + 1, 1) AS BIGINT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS BIGINT) + 4 * CAST(substr(b, 5 * i + 3, 1) AS BIGINT)
  + 2 * CAST(substr(b, 5 * i + 4, 1) AS BIGINT) + CAST(substr(b, 5 * i + 5, 1) AS BIGINT) AS BIGINT), 1)), '') AS d FROM bits),
least_id AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM dig)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, true AS verified FROM least_id"""


@query("op2_warc", SQL_WARC)
def op2_warc(spark: SparkSession, d: str) -> DataFrame:
    html = table(spark, d, "pages")
    kind = html.schema["page_id"].dataType
    read = warc.round_trip(html)
    return read.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "verified")


@query("op1_ngram_scores")
def op1_ngram_scores(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.scores(table(spark, d, "documents"), F.crc32(F.col("doc_id").cast("string")) % 10 != 0)


@query("op4_main_text")
def op4_main_text(spark: SparkSession, d: str) -> DataFrame:
    return pages.extract(table(spark, d, "pages"))


SQL_SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least_id AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT w.doc_id, unnest(range(i, i + 50)) AS p FROM win w JOIN least_id f ON w.k = f.k WHERE w.doc_id > f.first) GROUP BY 1),
kept AS (SELECT d.doc_id, w, coalesce(places, []) AS places FROM d LEFT JOIN gone USING (doc_id)),
words AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(places) AS q FROM gone) g WHERE g.doc_id = x.doc_id AND g.q = x.p) GROUP BY 1)
SELECT k.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_removed, sha256(coalesce(t.text, '')) AS kept_sha256
FROM kept k LEFT JOIN words t USING (doc_id)"""


@query("op12_substring_dedup", SQL_SUBSTRINGS)
def op12_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, d, "documents").select("doc_id", "text"), length=50)
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL_PHRASES = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS MATERIALIZED (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
f AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS p FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM w, range(1, 5) AS r(s) WHERE len(w) >= s)) GROUP BY 1, 2 HAVING count(*) >= 30),
cand AS MATERIALIZED (SELECT lang, string_split(p, ' ') AS p, f AS a FROM f WHERE contains(p, ' ')),
parts AS MATERIALIZED (SELECT lang, p, a, k, array_to_string(p[1:k], ' ') AS pl, array_to_string(p[k + 1:], ' ') AS pr FROM (SELECT *, unnest(range(1, len(p))) AS k FROM cand)),
cuts AS (SELECT c.lang, c.p, a, k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score
  FROM parts c JOIN f x ON x.lang = c.lang AND x.p = c.pl JOIN f y ON y.lang = c.lang AND y.p = c.pr),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_ AS (SELECT lang, p[i:i + m - 1] AS p, max(a) AS around FROM (SELECT *, unnest(range(1, len(p) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(p))) AS m FROM cand)) GROUP BY 1, 2),
kept AS (SELECT w.lang, array_to_string(w.p, ' ') AS phrase, a, l, r, score FROM weakest w LEFT JOIN inner_ i ON w.lang = i.lang AND w.p = i.p WHERE around IS NULL OR 100 * around < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


@query("op13_phrase_collocations", SQL_PHRASES)
def op13_phrase_collocations(spark: SparkSession, d: str) -> DataFrame:
    return phrases.collocations(table(spark, d, "documents"), min_count=30, limit=2000)


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(table(spark, d, "embeddings"), components=32, scale=64, shift=1_000_000)
