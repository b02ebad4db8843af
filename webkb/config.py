"""Settings: defaults, a YAML file over them, environment variables over both; unknown names are errors."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from typing import Any

PREFIX = "WEBKB__"


@dataclass(frozen=True)
class Crawler:
    max_pages: int = 500
    max_depth: int = 10
    max_retries: int = 3
    retry_delay_seconds: float = 5.0
    delay_seconds: float = 1.0


@dataclass(frozen=True)
class Storage:
    dimensions: int = 384
    max_vectors: int = 50_000
    eviction_batch: int = 5_000


@dataclass(frozen=True)
class Navigation:
    keyword_weight: float = 0.4
    url_weight: float = 0.3
    embedding_weight: float = 0.3
    llm_confidence_threshold: float = 0.7
    max_links: int = 20


@dataclass(frozen=True)
class Chunking:
    chunk_size: int = 1000
    overlap: int = 100
    min_chunk_size: int = 100


@dataclass(frozen=True)
class Settings:
    crawler: Crawler = field(default_factory=Crawler)
    storage: Storage = field(default_factory=Storage)
    navigation: Navigation = field(default_factory=Navigation)
    chunking: Chunking = field(default_factory=Chunking)


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """base with over's values; mappings are merged at every depth."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def coerced(text: str) -> Any:
    """A variable's text as truth value, nothing, number or text, tried in this order."""
    low = text.strip().lower()
    if low in ("true", "yes", "1", "on"):
        return True
    if low in ("false", "no", "0", "off"):
        return False
    if low in ("none", "null", ""):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def from_environment(environ: Mapping[str, str], prefix: str = PREFIX) -> dict[str, Any]:
    """WEBKB__SECTION__KEY variables as nested values."""
    out: dict[str, Any] = {}
    for name, value in environ.items():
        if name.startswith(prefix) and "__" in name[len(prefix) :]:
            section, _, key = name[len(prefix) :].lower().partition("__")
            out = merged(out, {section: {key: coerced(value)}})
    return out


def load(path: str | None = None, environ: Mapping[str, str] | None = None) -> Settings:
    values = asdict(Settings())
    if path:
        import yaml

        with open(path) as f:
            values = merged(values, yaml.safe_load(f) or {})
    values = merged(values, from_environment(os.environ if environ is None else environ))
    sections = {f.name: f.default_factory for f in fields(Settings)}
    if unknown := set(values) - set(sections):
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    return Settings(**{k: type(make())(**values[k]) for k, make in sections.items()})
