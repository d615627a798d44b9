"""Settings with their defaults, merged from nested dictionaries."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

CONFIG_FILE = ".ripplespark.json"


@dataclass(frozen=True)
class Temporal:
    soft_days: float = 14
    hard_days: float = 28
    window_days: float = 14
    max_commit_files: int = 30
    max_weight: float = 0.45


@dataclass(frozen=True)
class Scoring:
    min_confidence: float = 0.4
    high_confidence: float = 0.8
    max_results: int = 10
    require_anchor: bool = True
    ubiquity_threshold: float = 0.7
    ubiquity_factor: float = 0.3
    ubiquitous_selector: float = 0.1
    route_traffic_exponent: float = 1.0
    filename_ambiguity: float = 0.1
    max_fan_out: int = 200
    max_cone: int = 80
    barrel_exports: int = 8
    router_routes: int = 5
    temporal: Temporal = field(default_factory=Temporal)


@dataclass(frozen=True)
class Rerank:
    band_min: float = 0.4
    band_max: float = 1.0
    drop_confidence: float = 0.9
    max_candidates: int = 40
    concurrency: int = 4
    timeout_s: float = 30
    max_retries: int = 3
    top_k: int = 30
    min_similarity: float = 0.3
    prior_share: float = 0.7
    min_pair_score: float = 0.08
    auto_keep: float = 0.9


@dataclass(frozen=True)
class Source:
    root: str = "."
    ignore_dirs: tuple[str, ...] = ("node_modules", "dist", "build", ".next", "coverage", ".git")
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    source: Source = field(default_factory=Source)
    scoring: Scoring = field(default_factory=Scoring)
    rerank: Rerank = field(default_factory=Rerank)


def merged(base: Any, given: dict[str, Any]) -> Any:
    """``base`` with the given values; blocks are merged field by field and unknown names are refused."""
    known = {f.name for f in fields(base)}
    if unknown := set(given) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(base, **{k: merged(getattr(base, k), v) if is_dataclass(getattr(base, k)) else tuple(v) if isinstance(getattr(base, k), tuple) else v for k, v in given.items()})


def load(given: dict[str, Any] | None = None) -> Config:
    """Defaults merged with ``given``; a root is needed, and the upper band can't lie below the lower."""
    out = merged(Config(), given or {})
    if not out.source.root:
        raise ValueError("source.root must be set")
    if out.scoring.high_confidence < out.scoring.min_confidence:
        raise ValueError("scoring.high_confidence is below scoring.min_confidence")
    return replace(out, source=replace(out.source, ignore_dirs=tuple(dict.fromkeys((*Source().ignore_dirs, *out.source.ignore_dirs)))))


def read(folder: str) -> Config:
    """The settings in a folder's file of settings, or the defaults; the root is the folder unless the file says otherwise."""
    path = os.path.join(folder, CONFIG_FILE)
    given: dict[str, Any] = {}
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
    return load({"source": {"root": folder}} | given | ({"source": {"root": folder, **given["source"]}} if "source" in given else {}))
