"""All corpus queries."""

from __future__ import annotations

from . import (  # noqa: F401
    q_alignment,
    q_iblt,
    q_lattice,
    q_mixing,
    q_ngram_trie,
    q_orc_tokens,
    q_packing,
    q_prefix_trie,
    q_quality,
    q_simhash,
    q_speculative_bpe,
    q_style_tree,
    q_suffix_radix,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
