"""Settings of the engine, typed and checked once."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_strategy: str = "recursive"
    chunk_size: int = 512
    chunk_overlap: int = 64
    max_file_mb: int = 20
    top_k: int = 5
    candidates: int = 20
    rrf_k: int = 60
    max_context_chars: int = 9000
    max_prompt_chars: int = 18000
    window_tokens: int = 16384
    output_tokens: int = 1024
    low_relevance: float = 0.1
    cache_entries: int = 100
    cache_similarity: float = 0.97
    history_tokens: int = 2000
    summary_trigger: int = 10
    summary_keep: int = 4
    tool_timeout: float = 300.0
    tool_retries: int = 1
    max_iterations: int = 8
    max_repeats: int = 2
    parallel_calls: int = 2
    online_search: bool = False

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if f.type == "bool":
                ok = type(v) is bool
            elif f.type == "int":
                ok = type(v) is int and v >= (0 if f.name in ("chunk_overlap", "tool_retries") else 1)
            elif f.type == "float":
                ok = type(v) in (int, float) and 0 < v < float("inf")
            else:
                ok = v in ("fixed", "recursive", "semantic")
            if not ok:
                raise ValueError(f"{f.name}: {v!r} is not allowed")
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_overlap must be less than chunk_size")
        if self.output_tokens >= self.window_tokens:
            raise ValueError("output_tokens must be less than window_tokens")
        if not (self.low_relevance < 1 and self.cache_similarity <= 1):
            raise ValueError("thresholds lie between 0 and 1")


def load(path: str | None = None) -> Settings:
    """Defaults, then a JSON file, then SKARN_<NAME> variables."""
    values = {}
    if path:
        with open(path, encoding="utf-8") as f:
            values = json.load(f)
    for f in fields(Settings):
        if (raw := os.environ.get(f"SKARN_{f.name.upper()}")) is not None:
            values[f.name] = raw if f.type == "str" else json.loads(raw)
    return Settings(**values)
