"""Thresholds and constants that are semantics of the engine."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
NOISE_FLOOR = ((5.0, 0.3684), (8.0, 0.2558), (10.0, 0.2034), (15.0, 0.1800), (20.0, 0.1286), (25.0, 0.1000), (30.0, 0.0814))
NOISE_MARGIN = 1.15
TEMPO_FACTORS = (0.90, 0.95, 1.00, 1.05, 1.10)
PITCHES, FRAMES = 12, 64


@dataclass(frozen=True)
class Thresholds:
    """Acceptance thresholds of the three tiers and the shape of their searches."""

    fingerprint: float = 0.30
    embedding: float = 0.98
    cover: float = 0.90
    max_bit_error: int = 2
    prefilter_top: int = 50
    prefilter_band: float = 0.15
    prefilter_min_seconds: float = 10.0
    duration_window: float = 0.0
    top_k: int = 5
    oversample: int = 20
    min_probe: int = 50
    rights_gate: float = 0.50
    overlap: float = 0.5
    near_duplicate: float = 0.10


DEFAULT = Thresholds()
