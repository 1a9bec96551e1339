"""Experiment files and data folders."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path


@dataclass
class Engine:
    min_train: int = 750
    refit_every: int = 63
    embargo: int = 5
    warmup: int = 750
    max_train: int = 1250


@dataclass
class Experiment:
    """One experiment: which symbols, which methods, how they are trained, where results go."""

    name: str
    universe: str | list[str]
    methods: list
    start: str | None = None
    end: str | None = None
    engine: Engine = field(default_factory=Engine)
    output: str = "results"


def find(path: str) -> Path:
    """The file itself, or the same under the working folder's parents."""
    given = Path(path)
    if given.exists():
        return given
    for parent in (Path.cwd(), *Path.cwd().parents):
        if (parent / path).exists():
            return parent / path
    raise FileNotFoundError(path)


def read(path: str) -> Experiment:
    import yaml

    raw = yaml.safe_load(find(path).read_text())
    methods = [m if isinstance(m, str) else (m["name"], m.get("params", {})) if isinstance(m, dict) else tuple(m) for m in raw["methods"]]
    text = lambda k: str(raw[k]) if raw.get(k) else None
    return Experiment(raw["name"], raw["universe"], methods, text("start"), text("end"), Engine(**raw.get("engine", {})), raw.get("output", f"results/{raw['name']}"))


def data_root() -> str:
    """STRATABAR_DATA_ROOT, or data under the working folder."""
    return os.environ.get("STRATABAR_DATA_ROOT", str(Path.cwd() / "data"))
