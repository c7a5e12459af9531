"""The queries and SQL of this subpackage and of the corpus pipeline, by name."""

from __future__ import annotations

import corpus_pipeline
from loomgraph.llm import (
    alignment,
    byte_bpe,
    decontamination,
    exact_dedup,
    html_extraction,
    jaccard_join,
    language_id,
    lm_scoring,
    packing,
    prefix_trie,
    quality,
    substring_dedup,
    url_filter,
)

MODULES = [
    language_id, html_extraction, quality, decontamination, exact_dedup, lm_scoring, byte_bpe, url_filter, substring_dedup, jaccard_join,
    alignment, packing, prefix_trie,
]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
SQL = {name: text for module in MODULES for name, text in getattr(module, "SQL", {}).items()}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
