"""Recipes: validated parameter sets with a stable identity."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass


def recipe_hash(recipe) -> str:
    """12 hex digits; number literals matter (0 and 0.0 differ)."""
    text = json.dumps(asdict(recipe), sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def _check(owner, **rules: bool) -> None:
    for name, holds in rules.items():
        if not holds:
            raise ValueError(f"{type(owner).__name__}.{name} is out of range: {getattr(owner, name)!r}")


@dataclass(frozen=True)
class LabelConfig:
    """kappa scales the volatility into the CUSUM threshold; the rest shapes the barriers."""

    kappa: float
    ewma_span: int
    pt_mult: float
    sl_mult: float
    max_hp: int
    min_ret: float
    schema_version: int = 1

    def __post_init__(self) -> None:
        _check(
            self, kappa=self.kappa > 0, ewma_span=self.ewma_span >= 2, pt_mult=self.pt_mult >= 0,
            sl_mult=self.sl_mult >= 0, max_hp=self.max_hp >= 1, min_ret=self.min_ret >= 0,
            schema_version=self.schema_version >= 1,
        )

    def config_hash(self) -> str:
        return recipe_hash(self)


@dataclass(frozen=True)
class WeightConfig:
    """decay_c: 1 no decay, 0..1 linear, below 0 cuts off the oldest; there is no lower bound."""

    decay_c: float
    schema_version: int = 1

    def __post_init__(self) -> None:
        _check(self, decay_c=self.decay_c <= 1, schema_version=self.schema_version >= 1)

    def config_hash(self) -> str:
        return recipe_hash(self)


@dataclass(frozen=True)
class ValidationConfig:
    """Fold layout; it has no hash because folds are not stored."""

    n_splits: int
    embargo_pct: float
    n_groups: int
    n_test_groups: int = 2

    def __post_init__(self) -> None:
        _check(
            self, n_splits=self.n_splits >= 2, embargo_pct=0 <= self.embargo_pct < 1,
            n_groups=self.n_groups >= 2, n_test_groups=1 <= self.n_test_groups < self.n_groups,
        )
