"""Registered queries; importing the package fills the registry."""

from importlib import import_module
from pathlib import Path

from .registry import ORACLES, QUERIES

for _f in sorted(Path(__file__).parent.glob("q_*.py")):
    import_module(f"{__name__}.{_f.stem}")

__all__ = ["QUERIES", "ORACLES"]
