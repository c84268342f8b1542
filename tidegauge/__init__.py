"""Mixed-frequency factor analytics on Spark.

Beside the session class the package offers the methods of a default session as functions
(``tidegauge.load_config(...)``), its state (``tidegauge.config()``, ``tidegauge.result()``), and the
operators that stand alone, by the names in ``LOW_LEVEL``.
"""

from __future__ import annotations

from importlib import import_module
from typing import Any

#: Operators on their own, by name: where each lives.
LOW_LEVEL = {
    "transform": "operators.panel",
    "kalman_filter": "plans.kernel",
    "smooth": "plans.kernel",
    "run": "plans.kernel",
    "observed": "plans.kernel",
    "smoothed_panel": "plans.kernel",
    "fixed_states": "operators.models",
    "rmse": "operators.evaluation",
    "series_report": "operators.models",
}

__all__ = ["FactorSession", "ModelConfig", "default", "config", "result", *LOW_LEVEL]


def config() -> Any:
    """The default session's configuration, or None."""
    return import_module(".session", __name__).default().config


def result() -> Any:
    """The default session's table of results, or None."""
    return import_module(".session", __name__).default().fits


def __getattr__(name: str) -> Any:
    if name.startswith("_"):
        raise AttributeError(name)
    if name in ("FactorSession", "default"):
        return getattr(import_module(".session", __name__), name)
    if name == "ModelConfig":
        return import_module(".sources.config", __name__).ModelConfig
    if name in LOW_LEVEL:
        return getattr(import_module(f".{LOW_LEVEL[name]}", __name__), name)
    session = import_module(".session", __name__)
    if name in session.ON_DEFAULT:
        return getattr(session.default(), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
