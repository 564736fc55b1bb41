"""All queries of this folder and the SQL of those that SQL can express."""

from . import (
    document_fingerprint, embedding_dedup, fill_in_middle, html_text, langid, lm_score, packing, piece_codec, quality, simhash, token_alignment, toxicity, url_filter,
)

MODULES = [
    piece_codec, langid, simhash, lm_score, quality, html_text, embedding_dedup, url_filter, packing, toxicity,
    fill_in_middle, document_fingerprint, token_alignment,
]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
