"""Parameters of the search pipeline, as plain dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Bm25Config:
    """k1 and b of the scorer; ``repeat_terms``: a query term counts as often as it occurs."""

    k1: float = 1.5
    b: float = 0.75
    repeat_terms: bool = True
    stem: bool = True


@dataclass(frozen=True)
class FusionConfig:
    """How ranked lists are merged: ``minmax``, ``minmax_union``, ``rrf`` or ``wrrf``."""

    method: str = "minmax"
    weights: dict[str, float] = field(default_factory=lambda: {"bm25": 0.55, "dense": 0.45})
    k: int = 60


@dataclass(frozen=True)
class GatePolicy:
    """Section gate: ``none``, ``require``, ``prefer_order`` or ``prefer_score``."""

    mode: str = "none"
    sections: tuple[str, ...] = ()
    factor: float = 1.10


@dataclass(frozen=True)
class SearchConfig:
    bm25: Bm25Config = Bm25Config()
    fusion: FusionConfig = FusionConfig()
    top_bm25: int = 120
    top_dense: int = 80
    fused_cap: int = 50
    rerank_top: int = 25
    final_k: int = 20
    union_boost: float = 0.05
    union_cap: int = 200
    bias_positive: float = 0.15
    bias_penalty: float = 0.20
    force_include: bool = False


@dataclass(frozen=True)
class UserProfile:
    age: int | None = None
    chronic_conditions: tuple[str, ...] = ()
    pregnancy: bool = False
    breastfeeding: bool = False
    allergies: tuple[str, ...] = ()
