"""A PySpark engine for genome-annotation data and for large text corpora."""

from __future__ import annotations

import importlib
from typing import Any

__version__ = "0.1.0"

#: Public name -> module that holds it, loaded at first use.
_PUBLIC = {
    "Calibration": "functions.track", "annotate": "plans.facade", "candidate_regions": "plans.facade", "predict": "plans.facade", "prepare": "plans.facade",
    "decode_regions": "operators.decode", "Preparation": "plans.config", "Prediction": "plans.config",
}
__all__ = sorted(_PUBLIC)


def __getattr__(name: str) -> Any:
    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_PUBLIC[name]}"), name)
