"""The registered queries of this subpackage: thin wrappers that apply one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keelson.llm import bpe, decontamination, frames, language, licenses, lm, ngram_join, quality, repeats, secrets, shards

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SECRET_VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sorted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = frames.shared_dir(spark, "shards")
    written = shards.write_shards(table(spark, sf_dir, "documents"), WORD_VOCABULARY, folder, end_id=2)
    return shards.read_shards(written, folder)


def op2_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_digests(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), SECRET_VOCABULARY, PATTERN, keep=["doc_id"])


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"), rule=ngram_join.JoinRule(n=4, percent=85))


def op5_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", frames.bucket_of("doc_id", 3) == 1)
    model = language.fit(docs.where("not held_out"))
    return language.identified(docs.select("doc_id", "held_out", "text"), model, keep=["doc_id", "held_out"])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.contamination(docs, table(spark, sf_dir, "benchmark")).drop("text", "hit_spans")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_VOCABULARY, PATTERN, keep=["doc_id"])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "longest_repeat")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sorted_shards,
        op2_repeat_removal,
        op3_secret_scan,
        op4_ngram_jaccard,
        op5_log_bilinear,
        op6_language_id,
        op7_decontamination,
        op8_license_scan,
        op9_prefix_bpe,
        op10_quality_rules,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE_WORD = r"[^\x20\x09-\x0D]+"
_ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _gram(n: int) -> str:
    """A hash of the n words from each word on, null where fewer are left."""
    return f"CASE WHEN i + {n - 1} <= n THEN hash(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)) END AS h{n}"


def _again(n: int) -> str:
    return f"h{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, h{n}) > 1 AS a{n}"


ORACLE_SQL: dict[str, str] = {
    "op2_repeat_removal": """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, unnest(range(length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400),
k AS (SELECT w.r, i, hash(substr(h, i * 2 + 1, 400)) AS a, hash(reverse(substr(h, i * 2 + 1, 400))) AS b FROM w JOIN d USING (r)),
t AS (SELECT a, b FROM k GROUP BY 1, 2 HAVING count(*) > 1),
f AS (SELECT r, i FROM k JOIN t USING (a, b)),
e AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200, true) AS fresh FROM f),
g AS (SELECT r, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS s FROM e),
s AS (SELECT r, s, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY 1, 2),
n AS (SELECT r, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM s GROUP BY 1),
o AS (SELECT doc_id, h, n_spans, n_removed, list_append(starts, length(h) // 2) AS starts, list_prepend(0, ends) AS ends FROM d LEFT JOIN n USING (r))
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(starts) + 1), lambda j: substr(h, ends[j] * 2 + 1, (starts[j] - ends[j]) * 2)), '') END)) AS kept_sha256
FROM o""",
    "op4_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACE_WORD}') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, words[i : i + 3] AS k FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT w.doc_id, count(k) AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, e.b FROM reach JOIN edges e ON e.a = reach.r)
SELECT n.doc_id, n_shingles, min(r) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY 1, 2""",
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM_WORD}') AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_ALNUM_WORD}') AS words FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(words), 13) AS n, words[i : i + 12] AS k FROM (SELECT *, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, words[i : i + n - 1] AS k FROM (SELECT d.*, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes WHERE len(words) >= n)),
hits AS (SELECT doc_id, i, iw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.k = iw.k),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_SPACE_WORD}') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACE_WORD}')) AS lines FROM d),
p AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
h AS (SELECT doc_id, i, {_gram(5)}, {_gram(8)}, {_gram(101)} FROM p),
f AS (SELECT doc_id, i, {_again(5)}, {_again(8)}, {_again(101)} FROM h),
g AS (SELECT doc_id, bool_or(a101) AS far FROM f GROUP BY 1),
c AS (SELECT doc_id, max(a5) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c5, max(a8) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c8 FROM f),
s AS (SELECT doc_id, count_if(c5) AS r5, count_if(c8) AS r8 FROM c GROUP BY 1),
o AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(r5, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(r8, 0) AS BIGINT) AS n_covered_words, coalesce(far, false) AS far FROM w LEFT JOIN s USING (doc_id) LEFT JOIN g USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words, base_failed,
 NOT (base_failed OR 100 * n_covered_words > 15 * n_words OR far) AS kept FROM v""",
}
