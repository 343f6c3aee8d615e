"""Strict settings: every name must be known and every value of the declared kind."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any, get_origin, get_type_hints

from strandloom.operators.gene_quality import Rules


def strict(kind: type, values: Mapping[str, Any]) -> Any:
    """An instance of the dataclass `kind`; unknown names and values of another kind are errors. A whole number may stand for a float, a list of texts for a tuple."""
    known = {f.name for f in fields(kind)}
    unknown = sorted(set(values) - known)
    if unknown:
        raise ValueError(f"unknown settings {unknown}; known are {sorted(known)}")
    hints = get_type_hints(kind)
    for name, value in values.items():
        if hints[name] is float:
            fits = isinstance(value, (int, float)) and not isinstance(value, bool)
        elif get_origin(hints[name]) is tuple:
            fits = isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value)
        else:
            fits = type(value) is hints[name]
        if not fits:
            raise ValueError(f"{name} must be {getattr(hints[name], '__name__', hints[name])}, not {value!r}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


@dataclass(frozen=True)
class Preparation:
    """Settings of facade.prepare: windows, and what the quality of genes goes by."""

    window: int = 40_960
    flank: int = 4_096
    overlap: int = 8_192
    most_ambiguous: int = 327
    biotype_key: str = "gene_biotype"
    biotypes: tuple[str, ...] = ("protein_coding", "protein-coding")
    policy: str = "longest_cds"
    least_cds: int = 60
    hard_intron: int = 4
    soft_intron: int = 20
    intron_source: str = "exon"
    low_quality: str = "half"
    allow_partial: bool = False
    allow_exceptions: bool = False

    def rules(self) -> Rules:
        return Rules(**{f.name: getattr(self, f.name) for f in fields(Rules)})

    def __post_init__(self) -> None:
        if self.flank < 0 or self.window <= 2 * self.flank:
            raise ValueError("window must be longer than both flanks")
        if not 0 <= self.overlap < self.window:
            raise ValueError("overlap must be 0 or more and shorter than the window")
        if self.most_ambiguous < 0:
            raise ValueError("most_ambiguous must be 0 or more")
        self.rules()  # refuses what they don't know


@dataclass(frozen=True)
class Prediction:
    """Settings of facade.predict and facade.annotate."""

    window: int = 40_960
    flank: int = 5_120
    min_cds: int = 60
    min_intron: int = 20
    least_mean: float = 0.5

    def __post_init__(self) -> None:
        if self.flank < 0 or self.window <= 2 * self.flank:
            raise ValueError("window must be longer than both flanks")
        if self.min_cds < 3 or self.min_intron < 1:
            raise ValueError("min_cds must be 3 or more, min_intron 1 or more")


def load(path: str, kind: type) -> Any:
    """Settings of a JSON file, or of a YAML file where a YAML reader is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        values = json.loads(text)
    else:
        import yaml

        values = yaml.safe_load(text)
    if not isinstance(values, Mapping):
        raise ValueError(f"{path} holds no settings")
    return strict(kind, values)
