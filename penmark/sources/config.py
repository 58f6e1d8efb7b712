"""Configuration from JSON or YAML, with overrides and environment variables."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

#: The object that a file may wrap its settings in.
TOP_LEVEL = "penmark"


@dataclass
class EnsembleSettings:
    strategy: str = "weighted_average"
    weights: dict[str, float] = field(default_factory=dict)


@dataclass
class Settings:
    min_text_length: int = 150
    short_text_confidence: float = 0.3
    max_top_features: int = 20
    max_heatmap_tokens: int = 200
    calibration_model_dir: str = "calibration_models"
    detector_calibration_paths: dict[str, str] = field(default_factory=dict)
    ensemble: EnsembleSettings = field(default_factory=EnsembleSettings)


def load(path: str | Path) -> dict[str, Any]:
    """The object in a .json, .yml or .yaml file."""
    path = Path(path)
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        data = json.loads(text)
    elif path.suffix in (".yml", ".yaml"):
        import yaml

        data = yaml.safe_load(text)
    else:
        raise ValueError(f"{path}: settings are JSON or YAML")
    if not isinstance(data, dict):
        raise ValueError(f"{path}: settings must be an object")
    return data


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """Recursively merged; `over` wins."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def _built(kind: type, data: Mapping[str, Any]) -> Any:
    """A dataclass from what it knows of the data; nested ones likewise."""
    known = {}
    for f in fields(kind):
        if f.name in data:
            nested = f.default_factory if isinstance(f.default_factory, type) and is_dataclass(f.default_factory) else None
            known[f.name] = _built(nested, data[f.name]) if nested and isinstance(data[f.name], Mapping) else data[f.name]
    return kind(**known)


def resolve(path: str | Path | None = None, overrides: Mapping[str, Any] | None = None) -> Settings:
    """Settings from a file (else the one named by PENMARK_CONFIG, else defaults), under `overrides`."""
    path = path or os.environ.get("PENMARK_CONFIG")
    data = load(path) if path else {}
    data = data[TOP_LEVEL] if set(data) == {TOP_LEVEL} and isinstance(data[TOP_LEVEL], dict) else data
    return _built(Settings, merged(data, overrides or {}))
