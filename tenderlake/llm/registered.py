"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import (
    queries_chat,
    queries_classifiers,
    queries_decontaminate,
    queries_lm,
    queries_packing,
    queries_quality_rules,
    queries_simhash,
    queries_spelling,
    queries_substring_dedup,
    queries_urls,
    queries_warc,
    queries_whitening,
)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (queries_lm, queries_chat, queries_warc, queries_classifiers, queries_decontaminate, queries_packing, queries_substring_dedup, queries_simhash, queries_quality_rules, queries_spelling, queries_urls, queries_whitening):
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
