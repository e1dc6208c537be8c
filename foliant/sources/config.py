"""Settings: defaults, then a file's values, then the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 500
    chunk_overlap: int = 50
    vector_weight: float = 0.6
    keyword_weight: float = 0.4
    top_k_search: int = 10
    top_k_chat: int = 5
    top_k_keyword: int = 20
    score_threshold: float = 0.0
    embed_batch: int = 32
    segment_target: int = 10_000
    segment_hard: int = 12_000
    keywords_per_segment: int = 50
    keywords_rolling_cap: int = 150
    keywords_shown: int = 50
    sessions_kept: int = 100
    concurrent_ingests: int = 1
    rate_per_second: float = 20.0
    rate_burst: float = 40.0
    session_hours: int = 24
    skip_back_matter: bool = True
    tool_matches: int = 5


def load(path: str | None = None, environment: Mapping[str, str] | None = None, prefix: str = "FOLIANT_") -> Settings:
    """Settings of a JSON file, if there is one, with names from the environment on top."""
    values: dict = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            values = json.load(f) or {}
    env = os.environ if environment is None else environment
    known = {f.name: type(getattr(Settings(), f.name)) for f in fields(Settings)}
    for name, kind in known.items():
        text = env.get(prefix + name.upper())
        if text:
            values[name] = text.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(text)
    return replace(Settings(), **{k: v for k, v in values.items() if k in known})
