"""Operator parameters: frozen, passed to functions, never Spark settings."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FusionParams:
    topk: int = 500
    display_k: int = 120
    rrf_k: int = 60
    weights: dict = field(default_factory=lambda: {"dense": 1.0, "ocr": 0.35, "asr": 0.30, "caption": 0.25, "metadata": 0.15, "object": 0.25})
    neighbor_boost: float = 0.10
    neighbor_window: int = 2
    consistency_weight: float = 0.15
    consistency_window: int = 2
    consistency_decay: float = 0.5
    context_weight: float = 0.25
    context_window: int = 12
    context_head: int = 200
    retry_below: float = 0.25


@dataclass(frozen=True)
class Bm25Params:
    k1: float = 1.5
    b: float = 0.75
    least: float = 1e-9


@dataclass(frozen=True)
class TemporalParams:
    max_gap: float = 150.0
    min_gap: float = 0.0
    floor: float = 0.10
    penalty: float = 0.0005
    videos: int = 30
    topk: int = 100
    beam: int = 8


@dataclass(frozen=True)
class RowParams:
    limit: int = 100
    head: int = 30
    variants: int = 4
    tail_share: float = 0.5
    max_extra: int = 10
    answer_chars: int = 100


@dataclass(frozen=True)
class DiversityParams:
    per_video: int = 3
    gap: float = 10.0
    mmr: float = 0.7


KS = (1, 5, 20, 50, 100)
