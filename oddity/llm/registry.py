"""Queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import (
    block_mixing,
    contextual_pii,
    conversation_trie,
    external_shuffle,
    hyperminhash_dedup,
    language_mixture,
    length_histogram,
    periodic_runs,
    qgram_decontamination,
    quality_divergence,
    toxicity_automata,
    url_templates,
    warc_source,
)

MODULES = (quality_divergence, block_mixing, external_shuffle, length_histogram, url_templates, qgram_decontamination,
           hyperminhash_dedup, language_mixture, toxicity_automata, warc_source, periodic_runs,
           conversation_trie, contextual_pii)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in getattr(m, "SQL", {}).items()}
