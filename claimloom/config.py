"""Fixed values that define results: sizes, thresholds, weights and limits."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values; they must stay as they are for equal results.
CHUNK_WORDS, CHUNK_OVERLAP, DISJOINT_WORDS = 512, 64, 200
PARAGRAPH_CHARS, PARAGRAPH_OVERLAP = 1500, 250
BM25_K1, BM25_B = 1.5, 0.75
DENSE_K, SPARSE_K, RRF_K, RETRIEVE_LIMIT, MERGED_LIMIT = 20, 20, 60, 10, 8
MAX_VARIANTS, MAX_TERMS = 5, 16
ALPHA, BETA, GAMMA, DELTA = 0.40, 0.20, 0.30, 0.20
SUPPORT_LEVEL, CONTRADICTION_LEVEL = 0.5, 0.6
VERIFIED, SUPPORTED, POSSIBLE = 0.70, 0.55, 0.40
AUTHORITY = {
    "scotus": 1.0,
    "circuit": 0.85,
    "district": 0.70,
    "state_supreme": 0.60,
    "state_appellate": 0.50,
    "state_trial": 0.35,
    "user_upload": 1.0,
}
AUTHORITY_UNKNOWN = 0.40
TIERS = {"sentence_evidence": 0, "generation_source": 1, "prompt_scope": 2, "target_doc": 3, "target_case": 4, "retrieved": 5}
TARGET_METADATA_LIMIT, TOPIC_FALLBACK_LIMIT, CONTEXT_MESSAGES = 40, 6, 2
UNSUPPORTED_RATIO, REPAIR_CLAIMS = 0.5, 3
SHORT_NAME_MARGIN, CONVERGENT_MARGIN = 1.15, 1.35
SESSION_HOURS = 24
CITATION_HIGH, CITATION_MID = 0.75, 0.55

#: A side of a join is broadcast up to this many rows and shuffled beyond.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class RetrievalConfig:
    dense_k: int = DENSE_K
    sparse_k: int = SPARSE_K
    rrf_k: int = RRF_K
    limit: int = RETRIEVE_LIMIT
    max_variants: int = MAX_VARIANTS
    max_terms: int = MAX_TERMS
