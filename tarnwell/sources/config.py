"""Settings of the hierarchical pipeline: defaults, files, overrides, ranges."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Chunking:
    chunk_size: int = 2048
    overlap: int = 0


@dataclass(frozen=True)
class Summarization:
    max_context_length: int = 4096
    max_summary_length: int = 900
    word_ratio: float = 0.65
    num_attempts: int = 3


@dataclass(frozen=True)
class Columns:
    id: str = "id"
    text: str = "judgement"
    prompt: str = "synthetic_prompt"
    reference: str = "summary"


@dataclass(frozen=True)
class Settings:
    chunking: Chunking = field(default_factory=Chunking)
    summarization: Summarization = field(default_factory=Summarization)
    columns: Columns = field(default_factory=Columns)

    def checked(self) -> Settings:
        s = self.summarization
        problems = [
            message
            for wrong, message in (
                (self.chunking.chunk_size < 1, "chunk_size must be positive"),
                (s.max_summary_length >= s.max_context_length, "a summary must be shorter than the context"),
                (not 0 < s.word_ratio <= 1, "word_ratio must be in (0, 1]"),
                (s.num_attempts < 1, "num_attempts must be positive"),
            )
            if wrong
        ]
        if problems:
            raise ValueError("; ".join(problems))
        return self


def merged(settings: Settings, overrides: dict) -> Settings:
    """New settings with the overrides (a nested dictionary; nulls change nothing). The old ones stay as they are."""
    parts = {}
    for name, values in overrides.items():
        part = getattr(settings, name, None)
        if part is None:
            raise ValueError(f"Unknown section: {name}")
        known = {f.name for f in dataclasses.fields(part)}
        if unknown := sorted(set(values) - known):
            raise ValueError(f"Unknown settings in {name}: {', '.join(unknown)}")
        parts[name] = dataclasses.replace(part, **{k: v for k, v in values.items() if v is not None})
    return dataclasses.replace(settings, **parts).checked()


def load(path: str | None = None, overrides: dict | None = None) -> Settings:
    """Defaults, then a JSON file if given, then overrides."""
    settings = Settings()
    if path is not None:
        settings = merged(settings, json.loads(Path(path).read_text(encoding="utf-8")))
    return merged(settings, overrides or {})
