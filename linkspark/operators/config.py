"""Settings of the operators; all limits are parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BlockingConfig:
    per_block_cap: int = 20
    candidates_cap: int = 75
    min_token_len: int = 3
    min_geo_token_df: int = 3
    max_name_token_df: int = 2000
    max_geo_token_df: int = 3000
    min_address_token_df: int = 3
    max_address_token_df: int = 500
    house_number_bonus: float = 2.0
    window: int = 10
    gram: int = 3
    gram_max_df: float = 0.3
    gram_min_similarity: float = 0.3
    with_grams: bool = False
    suffix_min_fraction: float = 0.02


@dataclass(frozen=True)
class ModelConfig:
    """Settings of Spark's boosted trees. They grow level by level, so a depth of 6 stands for up to 63 leaves, and have no
    penalty on leaf values; the least rows of a leaf keep leaves from being small instead."""

    folds: int = 5
    seed: int = 42
    iterations: int = 300
    step: float = 0.05
    depth: int = 6
    min_instances: int = 30
    max_bins: int = 255
    feature_subset: str = "0.8"
    subsample: float = 1.0


@dataclass(frozen=True)
class DecideConfig:
    beta: float = 0.5
    thresholds: tuple[float, ...] = tuple(round(0.05 * k, 2) for k in range(1, 20))
