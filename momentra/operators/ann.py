"""Centroids of a bounded sample and the scores of vectors against them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot


def fit_cells(vectors: DataFrame, cells: int, sample: int = 20_000, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Centroids of a bounded sample (the rows with the smallest id hashes)."""
    rows = vectors.orderBy(F.xxhash64("global_id", F.lit(seed))).limit(sample).select("v").collect()
    data = np.array([r["v"] for r in rows])
    rng = np.random.default_rng(seed)
    centers = data[rng.choice(len(data), min(cells, len(data)), replace=False)]
    for _ in range(rounds):
        near = (data @ centers.T - (centers**2).sum(1) / 2).argmax(1)
        centers = np.array([data[near == c].mean(0) if (near == c).any() else centers[c] for c in range(len(centers))])
    return centers


def cell_scores(v: str, centers: np.ndarray):
    """(score, cell) structs of a vector column against literal centroids."""
    each = [F.struct(dot(F.col(v), F.array(*map(F.lit, c.tolist()))).alias("s"), F.lit(i).alias("cell")) for i, c in enumerate(centers)]
    return F.array(*each)
