"""Defaults of the engine's three entry points."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    n_hashes: int = 800
    rows: int = 10
    bands: int = 80
    seed: int = 0
    bootstraps: int = 5
    min_df: int = 1
    q: int = 3
    mu: float = 0.650
    gamma: float = 0.756
    eps: float = 0.522
    alpha: float = 0.602
    eps_grid: tuple[float, ...] = (0.25, 0.38, 0.52)


STUDY = Config(n_hashes=840, seed=42)
GRID = Config(n_hashes=840, seed=42, bootstraps=1)
VARIANTS = ("base", "typed", "combined")
