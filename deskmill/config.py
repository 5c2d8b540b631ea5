"""Parameters with their defaults; nothing here reads files or the environment at import."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class RetrievalProfile:
    """How many children are searched and kept, and what happens between."""

    top_k_retrieval: int = 30
    top_k_final: int = 3
    rerank: bool = True
    rerank_threshold: float = 0.05
    litm: bool = False
    tickets_weight: float = 0.7

    def __post_init__(self):
        if not 1 <= self.top_k_retrieval <= 100 or not 1 <= self.top_k_final <= 10 or not 0 <= self.rerank_threshold <= 1:
            raise ValueError("top_k_retrieval is 1 to 100, top_k_final 1 to 10, rerank_threshold 0 to 1")


PROFILES = {
    "default": RetrievalProfile(),
    "fast": RetrievalProfile(16, 3, rerank=False, rerank_threshold=0.0),
    "deep": RetrievalProfile(24, 4, litm=True),
}


def profile(name: str, overrides: dict | None = None) -> RetrievalProfile:
    """A profile with overrides laid over it; an unknown name inherits ``deep``."""
    return replace(PROFILES.get(name, PROFILES["deep"]), **(overrides or {}))


@dataclass(frozen=True)
class Budgets:
    """Characters of context: all documentation, each page, all tickets, each ticket."""

    docs: int = 5200
    doc: int = 1800
    tickets: int = 2600
    ticket: int = 1200
    max_tickets: int = 2


@dataclass(frozen=True)
class Eligibility:
    """Which tickets are exported; the lists of excluded values ship empty."""

    since: str = "2022-01-01"
    statuses: tuple[str, ...] = ("Закрыто", "Решено", "Closed", "Solved")
    excluded_equipment: tuple[str, ...] = ()
    excluded_assignees: tuple[str, ...] = ()
    excluded_requesters: tuple[str, ...] = ()


CHUNK_SIZE, CHUNK_OVERLAP = 400, 50
BM25_K1, BM25_B, RRF_K = 1.2, 0.75, 60
EVALUATION_THRESHOLD = 0.82
COMPLETENESS, ENRICHMENT = 0.95, 80.0
