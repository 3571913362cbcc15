"""Settings of retrieval and chunking, checked once when made."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_tokens: int = 768
    chunk_quality: float = 0.5
    use_rrf: bool = False
    use_mmr: bool = True
    mmr_trade: float = 0.5
    recency_weight: float = 0.25
    table_boost: float = 0.5
    context_tokens: int = 6000
    min_table_accuracy: int = 70
    embedding_dim: int = 768

    def __post_init__(self) -> None:
        for name in ("chunk_quality", "mmr_trade"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between 0 and 1")
        for name in ("chunk_tokens", "context_tokens", "embedding_dim"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, prefix: str = "FOLIO_") -> Settings:
        """The settings that the environment names; anything else keeps its default."""
        found = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None:
                continue
            kind = type(f.default)
            found[f.name] = raw.strip().lower() in {"1", "true", "yes", "on"} if kind is bool else kind(raw)
        return cls(**found)
