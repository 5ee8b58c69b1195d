"""Parameters of the thread pipeline. Every operator takes them from here, so a run is described by one value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ThreadConfig:
    """Weights, windows and thresholds of pair scoring and thread building.

    The defaults are fixed values: results depend on them.
    """

    kind_weights: tuple[tuple[str, float], ...] = (("objeto", 0.5), ("territorio", 0.3), ("actor", 0.2))
    alpha: float = 0.7
    beta: float = 0.3
    near_days: int = 365
    far_days: int = 1095
    strong_ref: float = 0.5
    strictest_ref: float = 0.6
    taus: tuple[float, ...] = (0.35, 0.45, 0.55)
    giant_cap: float = 0.30
    hub_df: int = 400
    idf_anchor: int = 5
    min_thread: int = 3
    fdr: float = 0.05
    replicates: int = 200
    secondary_weight: float = 0.60


DEFAULT = ThreadConfig()
ABSTAIN = "SIN_SUBHILO_ESPECIFICO"
