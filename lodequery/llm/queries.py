"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from . import chat_format, flac_media, html_extract, language_id, license_scan, line_dedup, ngram_join, packing, quality_rules, sentence_pieces

MODULES = [chat_format, license_scan, html_extract, language_id, flac_media, quality_rules, packing, ngram_join, line_dedup, sentence_pieces]


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}
