"""Queries of this subpackage, by name, and the SQL that some of them equal."""

from __future__ import annotations

from .decontamination import op7_pigeonhole_edit_matches
from .fingerprint import op10_canonical_digest
from .language import op6_byte_gru_language
from .mixing import op3_soft_membership_mixing
from .ngram_join import op1_parity_ngram_join
from .pii import op8_contextual_pii
from .sharding import op9_hilbert_sharding
from .substring_dedup import op4_seed_extend_dedup
from .tokens import op2_bit_shuffled_tokens
from .urls import op5_markov_urls

QUERIES = {
    "op1_parity_ngram_join": op1_parity_ngram_join,
    "op2_bit_shuffled_tokens": op2_bit_shuffled_tokens,
    "op3_soft_membership_mixing": op3_soft_membership_mixing,
    "op4_seed_extend_dedup": op4_seed_extend_dedup,
    "op5_markov_urls": op5_markov_urls,
    "op6_byte_gru_language": op6_byte_gru_language,
    "op7_pigeonhole_edit_matches": op7_pigeonhole_edit_matches,
    "op8_contextual_pii": op8_contextual_pii,
    "op9_hilbert_sharding": op9_hilbert_sharding,
    "op10_canonical_digest": op10_canonical_digest,
}

ORACLE_SQL: dict[str, str] = {}
