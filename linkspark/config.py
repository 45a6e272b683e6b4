"""Configuration: a YAML file whose relative paths are resolved against its folder."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class TunedVector:
    table_top_k: int
    table_threshold: float
    column_top_k: int
    column_threshold: float


@dataclass(frozen=True)
class Config:
    data: dict[str, Path]
    outputs: dict[str, Path]
    fuzzy_threshold: int = 80
    model_name: str = "hashing"
    revision: str = "1"
    cache_dir: Path | None = None
    tuned: TunedVector | None = None
    extra: dict[str, Any] = field(default_factory=dict)


#: Samples, temperature and cost caps (USD) of the model-backed linkers, and phases of the cost report.
SAMPLES = 3
TEMPERATURE = 0.3
COST_CAPS = {"forward": 15.0, "backward": 5.0, "graph": 10.0}
PHASES = ("prompt_iteration", "dev_run", "backward_prompt_iteration", "backward_dev_run", "graph_dev_run")
FAILURE_TARGET = 0.02
DEFAULT_THRESHOLD = 80


def load_config(path: str | Path) -> Config:
    """Missing data or output paths raise KeyError; the linker and embedding sections are optional."""
    import yaml

    path = Path(path)
    raw = yaml.safe_load(path.read_text())
    place = lambda p: Path(p) if Path(p).is_absolute() else path.parent / p
    data = {k: place(raw["data"][k]) for k in ("spider_dir", "processed_dir", "taniguchi_splits_dir")}
    outputs = {k: place(raw["outputs"][k]) for k in ("predictions_dir", "results_dir", "logs_dir")}
    lexical = (raw.get("linkers") or {}).get("lexical") or {}
    vector = raw.get("embedding") or {}
    tuned = vector.get("tuned")
    return Config(
        data, outputs, int(lexical.get("fuzzy_threshold", DEFAULT_THRESHOLD)), vector.get("model_name", "hashing"), str(vector.get("revision", "1")),
        place(vector["cache_dir"]) if "cache_dir" in vector else None, TunedVector(**{k: tuned[k] for k in TunedVector.__annotations__}) if tuned else None, raw,
    )


def threshold_from(path: str | Path) -> int:
    """The configured fuzzy threshold; 80 if there is no file."""
    return load_config(path).fuzzy_threshold if Path(path).exists() else DEFAULT_THRESHOLD
