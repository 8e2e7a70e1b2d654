"""Queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from brindle.llm import byte_bpe, lexical, main_text, packing, personal_data, phrases, posting_lists, quality_rules, sharding, simhash, suffix_dedup, toxicity, url_filter
from brindle.registry import Registry

REGISTRY = Registry()

REGISTRY.add("op1_quality_rules", quality_rules.query, quality_rules.ORACLE_SQL)
REGISTRY.add("op2_toxicity", toxicity.query)
REGISTRY.add("op3_posting_lists", posting_lists.query)
REGISTRY.add("op4_simhash_covering", simhash.query)
REGISTRY.add("op5_suffix_dedup", suffix_dedup.query)
REGISTRY.add("op6_best_fit_packing", packing.query)
REGISTRY.add("op7_sharding", sharding.query)
REGISTRY.add("op8_main_text", main_text.query)
REGISTRY.add("op9_url_filter", url_filter.query, url_filter.oracle_sql)
REGISTRY.add("op10_byte_bpe", byte_bpe.query)
REGISTRY.add("op11_personal_data", personal_data.query, personal_data.oracle_sql)
REGISTRY.add("op12_phrases", phrases.query, phrases.ORACLE_SQL)
REGISTRY.add("op13_lexical_search", lexical.query, lexical.ORACLE_SQL)
REGISTRY.add("pipeline", corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)
