"""Settings of a build."""

from __future__ import annotations

import dataclasses
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass
class Compile:
    max_depth: int = 2
    max_papers: int = 80
    top_k: int = 12
    atom_calls: int = 100
    classifier_calls: int = 0


@dataclass
class Output:
    folder: str = "corpus"
    brief_tokens: int = 6000


@dataclass
class Cache:
    folder: str = "cache"
    days: float = 30.0


@dataclass
class Config:
    compile: Compile = field(default_factory=Compile)
    output: Output = field(default_factory=Output)
    cache: Cache = field(default_factory=Cache)

    def set(self, path: str, value: Any) -> None:
        """One setting by its dotted name; unknown names are refused."""
        section, _, key = path.partition(".")
        part = getattr(self, section, None)
        known = {f.name: f for f in dataclasses.fields(part)} if dataclasses.is_dataclass(part) else {}
        if key not in known:
            raise KeyError(path)
        kind = type(getattr(part, key))
        setattr(part, key, value.lower() in ("1", "true", "yes") if kind is bool and isinstance(value, str) else kind(value))


def load(files: list[str | Path], overrides: dict[str, Any] | None = None) -> Config:
    """The first file that exists, then overrides; of a file, unknown settings are ignored."""
    out = Config()
    for path in map(Path, files):
        if path.exists():
            for section, values in tomllib.loads(path.read_text()).items():
                for key, value in values.items() if isinstance(values, dict) else ():
                    try:
                        out.set(f"{section}.{key}", value)
                    except KeyError:
                        pass
            break
    for path, value in (overrides or {}).items():
        out.set(path, value)
    return out
