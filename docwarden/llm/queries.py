"""Imports every operator, so that its query is registered."""

from __future__ import annotations

from docwarden.llm import (  # noqa: F401
    op01_sharding,
    op02_toxicity,
    op03_license_scan,
    op04_warc,
    op05_exact_dedup,
    op06_jaccard_join,
    op07_fingerprints,
    op08_mixing,
    op09_bpe,
    op10_quality_gam,
    op11_hard_negatives,
    op12_id_store,
    op13_burst_trie,
)
from docwarden.llm.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
