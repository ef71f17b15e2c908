"""Settings that every operator reads; loading never fails, unknown keys and bad values are warned about."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path

DISCLAIMER = "This is not medical advice. Consult a healthcare professional for medical decisions."


@dataclass
class Retrieval:
    alpha: float = 0.20
    field_boost: float = 0.20
    emb_floor: float = 0.25
    bm25_floor: float = 1.0
    top_k: int = 5
    pool: int = 40
    k1: float = 1.5
    b: float = 0.75
    idf: str = "plus1"


@dataclass
class Chunking:
    size: int = 90
    overlap: int = 25


@dataclass
class Answering:
    max_context_chars: int = 12_000
    temperature: float = 0.0
    disclaimer: str = DISCLAIMER


@dataclass
class Config:
    retrieval: Retrieval = field(default_factory=Retrieval)
    chunking: Chunking = field(default_factory=Chunking)
    answering: Answering = field(default_factory=Answering)
    warnings: list[str] = field(default_factory=list)
    source: str = "defaults"

    def as_dict(self) -> dict:
        return dataclasses.asdict(self)


def _overlay(section, values, warnings: list[str], name: str) -> None:
    if not isinstance(values, dict):
        warnings.append(f"{name} should be a mapping; ignored")
        return
    kinds = {f.name: type(getattr(section, f.name)) for f in dataclasses.fields(section)}
    for key, value in values.items():
        if key not in kinds:
            warnings.append(f"unknown key {name}.{key}; ignored")
            continue
        try:
            setattr(section, key, kinds[key](value))
        except (TypeError, ValueError):
            warnings.append(f"{name}.{key} = {value!r} is not a {kinds[key].__name__}; default kept")


def load(path: str | Path | None = None) -> Config:
    """Defaults, overlaid by a JSON or YAML file where one can be read, then held within their ranges."""
    out = Config()
    if path is not None and Path(path).exists():
        text = Path(path).read_text(encoding="utf-8")
        try:
            try:
                raw = json.loads(text)
            except ValueError:
                import yaml

                raw = yaml.safe_load(text)
            if not isinstance(raw or {}, dict):
                raise TypeError("not a mapping")
            for name, values in (raw or {}).items():
                if name in ("retrieval", "chunking", "answering"):
                    _overlay(getattr(out, name), values, out.warnings, name)
                else:
                    out.warnings.append(f"unknown section {name}; ignored")
            out.source = str(path)
        except Exception as e:  # a broken file must not stop the engine
            out.warnings.append(f"{path} could not be read ({type(e).__name__}); defaults kept")
    r = out.retrieval
    for name, low, high in (("alpha", 0.0, 1.0), ("field_boost", 0.0, 5.0), ("emb_floor", -1.0, 1.0), ("top_k", 1, 10**9)):
        held = min(max(getattr(r, name), low), high)
        if held != getattr(r, name):
            out.warnings.append(f"retrieval.{name} held at {held}")
            setattr(r, name, held)
    if not out.answering.disclaimer.strip():
        out.answering.disclaimer = DISCLAIMER
        out.warnings.append("the disclaimer can't be blank; restored")
    return out
