"""Settings from YAML: an explicit file, or config.local.yaml or config.yaml in the working or a given folder; where there is
none, from the environment (HEARTWOOD_MODE, HEARTWOOD_MAX_RESULTS and so on), and else the defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass
class VectorSettings:
    enabled: bool = True
    top_k: int = 20
    threshold: float = 0.3
    use_chunk_aggregation: bool = True
    chunk_size: int = 500


@dataclass
class ReasoningSettings:
    enabled: bool = True
    max_candidates: int = 10


@dataclass
class FusionSettings:
    vector_weight: float = 0.4
    reasoning_weight: float = 0.6


MODES = ("reasoning", "vector", "hybrid")


@dataclass
class Settings:
    mode: str = "hybrid"
    max_results: int = 10
    min_relevance: float = 0.3
    embedder: str = "hashing"
    completer: str = "overlap"
    vector: VectorSettings = field(default_factory=VectorSettings)
    reasoning: ReasoningSettings = field(default_factory=ReasoningSettings)
    hybrid: FusionSettings = field(default_factory=FusionSettings)

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {self.mode!r}")


def _filled(kind: type, values: dict):
    """An instance of a settings class; keys that it doesn't know are left alone."""
    out = {}
    for f in fields(kind):
        if f.name in values and values[f.name] is not None:
            default = f.default_factory() if callable(f.default_factory) else f.default
            out[f.name] = _filled(type(default), values[f.name]) if is_dataclass(default) else values[f.name]
    return kind(**out)


def load(path: str | None = None, folder: str = ".") -> Settings:
    """Settings of the first file there is, else those of the environment, else the defaults."""
    names = [Path(path)] if path else [Path(d) / n for d in dict.fromkeys((".", folder)) for n in ("config.local.yaml", "config.yaml")]
    for p in names:
        if path or p.exists():
            import yaml

            return _filled(Settings, (yaml.safe_load(p.read_text(encoding="utf-8")) or {}).get("retrieval") or {})
    return from_env()


def from_env(environment: Mapping[str, str] = os.environ) -> Settings:
    """The settings with the plain ones that the environment names, as HEARTWOOD_ and the name in capitals."""
    given = {f.name: environment[name] for f in fields(Settings) if (name := f"HEARTWOOD_{f.name.upper()}") in environment}
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    return Settings(**{name: kinds[name](value) for name, value in given.items() if kinds[name] in (str, int, float)})
