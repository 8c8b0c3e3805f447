"""All queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from segjobs.llm import chat_format, decontamination, harmonic, merkle, minhash, packing, quality_rules, resampling, secrets, surrogates, token_ids, url_filter, whitening

MODULES = (
    token_ids,
    chat_format,
    resampling,
    packing,
    decontamination,
    secrets,
    url_filter,
    quality_rules,
    minhash,
    surrogates,
    whitening,
    merkle,
    harmonic,
)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
