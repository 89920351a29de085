"""Fixed values that define the engine's results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    top_k: int = 20
    accept_threshold: float = 0.85
    manual_threshold: float = 0.65
    clarity_threshold: float = 0.10
    embedding_weight: float = 0.85
    hash_weight: float = 0.15
    hash_weights: tuple[float, float, float] = (0.6, 0.3, 0.1)  # full, name, collector
    hash_bits: int = 64
    composite_weights: tuple[float, float, float] = (0.70, 0.20, 0.10)  # full, collector, name
    keypoint_depth: int = 5
    keypoint_bands: tuple[float, float] = (0.5, 0.3)
    keypoint_penalty: float = 0.95
    resort_on_boost_only: bool = False
    ocr_boost: float = 0.15
    triangulated_score: float = 0.95
    edit_distance: int = 1
    max_hamming: int = 10
    hamming_top_n: int = 200
    retention_hours: int = 24
    unscoped_batch_limit: int = 50
    high_confidence: float = 0.85
    regression_pass: float = 0.90
    regression_drop: float = 0.05
    goal_p1: float = 0.95
    goal_p5: float = 0.99
    nt_xent_temperature: float = 0.07


CONFIG = EngineConfig()
