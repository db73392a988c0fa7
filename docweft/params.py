"""Tunables with their defaults and checks, and the hash of those that change scores."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in [{low}, {high}], not {value}")


@dataclass(frozen=True)
class ChunkParams:
    target_tokens: int = 400
    overlap_ratio: float = 0.15
    near_dup_cosine: float = 0.98

    def __post_init__(self):
        if self.target_tokens < 1 or not 0 <= self.overlap_ratio < 0.5:
            raise ValueError("target_tokens must be positive and overlap_ratio in [0, 0.5)")


#: Least and largest allowed.
RRF_K, RETURN_N = (1, 1000), (1, 50)


@dataclass(frozen=True)
class SearchParams:
    rrf_k: int = 60
    dense_weight: float = 0.5
    retrieve_n: int = 30
    return_n: int = 10
    max_query_chars: int = 1000

    def __post_init__(self):
        _within("rrf_k", self.rrf_k, *RRF_K)
        _within("dense_weight", self.dense_weight, 0, 1)
        _within("return_n", self.return_n, *RETURN_N)


@dataclass(frozen=True)
class GraphParams:
    semantic_weight: float = 0.5
    entity_weight: float = 0.3
    topic_weight: float = 0.2
    edge_threshold: float = 0.35
    top_k_pairs: int = 10
    n_topics: int = 8
    entity_labels: tuple[str, ...] = ("ORG",)
    min_entity_len: int = 3
    semantic_floor: float = 0.5
    semantic_ceil: float = 0.95
    extractor: str = "capitalised"
    random_state: int = 42
    top_entities_per_node: int = 10
    query_top_k: int = 50
    query_relevance_threshold: float = 0.35

    def __post_init__(self):
        if self.semantic_ceil <= self.semantic_floor:
            raise ValueError("semantic_ceil must exceed semantic_floor")


#: Fields of GraphParams that only change what is shown.
DISPLAY_ONLY = ("top_entities_per_node", "query_top_k", "query_relevance_threshold")


@dataclass(frozen=True)
class AskParams:
    top_k: int = 6
    chunk_char_budget: int = 1400
    context_char_budget: int = 9000
    rpm_limit: int = 6

    def __post_init__(self):
        _within("top_k", self.top_k, 1, 10)


def params_hash(params: GraphParams) -> str:
    """SHA-256 over the fields that change scores, in sorted order."""
    scoring = {f.name: asdict(params)[f.name] for f in fields(params) if f.name not in DISPLAY_ONLY}
    return hashlib.sha256(json.dumps(scoring, sort_keys=True).encode()).hexdigest()


def checked_query(text: str, limit: int = SearchParams.max_query_chars) -> str:
    """The stripped query; blank or overlong ones are refused."""
    text = text.strip()
    if not text or len(text) > limit:
        raise ValueError(f"a query needs 1 to {limit} characters")
    return text
