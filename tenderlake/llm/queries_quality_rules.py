"""Query op8: quality rules over documents, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_rules as q
from .common import spread


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and adaptive verdict of every document."""
    found = q.quality_verdicts(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _quartiles() -> str:
    at = lambda p, r: f"list_sort(list({r}))[greatest(1, ceil({p} * count(*)))::BIGINT]"
    return ", ".join(f"{at(0.25, r)} AS {r}_a, {at(0.75, r)} AS {r}_c" for r in q.RATIOS)


def _outside() -> str:
    tests = []
    for r, least in q.RATIOS.items():
        a, c = (f"coalesce(s.{r}_{x}, g.{r}_{x}, a.{r}_{x})" for x in "ac")
        tests.append(f"{r} > {c} + {q.FENCE} * greatest({c} - {a}, {least})")
        if r == "word_length":
            tests.append(f"{r} < {a} - {q.FENCE} * greatest({c} - {a}, {least})")
    return " OR ".join(tests)


SQL = rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
g3 AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g3) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '{q.SYMBOLS}', '')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
m AS (
  SELECT *, word_chars::DOUBLE / greatest(n_words, 1) AS word_length, n_symbols::DOUBLE / greatest(n_words, 1) AS symbols_per_word,
         n_dup_lines::DOUBLE / greatest(n_lines, 1) AS dup_line_share, n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeat_share,
         (n_words < {q.BASE_MIN_WORDS} OR 100 * n_repeat_words > {q.BASE_REPEAT_PERCENT} * n_words) AS base_failed
  FROM c),
p AS (SELECT * FROM m WHERE NOT base_failed),
s AS (SELECT lang, source, {_quartiles()} FROM p GROUP BY lang, source HAVING count(*) >= {q.MIN_ROWS}),
g AS (SELECT lang, {_quartiles()} FROM p GROUP BY lang HAVING count(*) >= {q.MIN_ROWS}),
a AS (SELECT {_quartiles()} FROM p HAVING count(*) >= {q.MIN_ROWS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT coalesce({_outside()}, false)) AS kept
FROM m LEFT JOIN s ON m.lang IS NOT DISTINCT FROM s.lang AND m.source IS NOT DISTINCT FROM s.source
LEFT JOIN g ON m.lang IS NOT DISTINCT FROM g.lang LEFT JOIN a ON true
"""

QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLE = {"op8_quality_rules": SQL}
