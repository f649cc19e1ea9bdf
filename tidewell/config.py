"""Constants of the engine, in one place, and the options that callers may change."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

#: Evaluation time of the registered queries; operators take ``as_of`` and never read the clock.
AS_OF = datetime(2024, 2, 1)


@dataclass(frozen=True)
class Lifecycle:
    """Excitability of documents: boosts, extinction and decay."""

    boost_scale: float = 0.05
    boost_cap: float = 0.2
    extinction_score: float = 0.02
    extinction_penalty: float = 0.05
    floor: float = 0.1
    ceiling: float = 1.0
    grace_days: int = 14
    stability_days: float = 60.0


@dataclass(frozen=True)
class CoRetrieval:
    """Edges between documents that are found together."""

    threshold: int = 3
    per_weight: float = 10.0
    confidence: float = 0.7
    stale_days: int = 30
    remove_below: float = 0.2
    decay: float = 0.8


@dataclass(frozen=True)
class SearchOptions:
    limit: int = 10
    rrf_k: int = 60
    rerank: bool = True
    vector: bool = True
    keyword: bool = True
    graph: bool = True
    candidates: int = 3
    mmr_lambda: float = 0.7
    boost_parents: int = 5
    boost_factor: float = 0.3


@dataclass(frozen=True)
class PruneRules:
    stale_below: float = 0.15
    stale_days: int = 60
    misaligned_hits: int = 5
    misaligned_below: float = 0.015
    retention_days: int = 90


@dataclass(frozen=True)
class GraphOptions:
    min_weight: float = 0.3
    max_per_node: int = 50
    temporal_days: int = 7
    temporal_edges: int = 50_000
    per_node: int = 20
    entity_frequency: int = 2
    topics: int = 10
    semantic: float = 0.7
    topic_notes: int = 3
    allocation_k: int = 5
    allocation_above: float = 0.6


@dataclass(frozen=True)
class Options:
    lifecycle: Lifecycle = field(default_factory=Lifecycle)
    co_retrieval: CoRetrieval = field(default_factory=CoRetrieval)
    search: SearchOptions = field(default_factory=SearchOptions)
    prune: PruneRules = field(default_factory=PruneRules)
    graph: GraphOptions = field(default_factory=GraphOptions)
    #: Embeddings that are kept by content; beyond, the least recently used go.
    cached_embeddings: int = 10_000
