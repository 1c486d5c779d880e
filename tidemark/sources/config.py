"""Instrument specifications from YAML files, checked as they are loaded."""

from __future__ import annotations

from pathlib import Path

from ..plans.score import validate_specs


def load_fingerprint(path: str | Path, swaps: dict | None = None) -> dict:
    """One instrument; its swap rates come from ``swaps`` by the file's stem unless it has its own."""
    import yaml

    path = Path(path)
    out = yaml.safe_load(path.read_text())
    if "swap" not in out and swaps and path.stem in swaps:
        out["swap"] = swaps[path.stem]
    validate_specs([out])
    return out


def load_all(folder: str | Path, swaps: dict | None = None) -> list[dict]:
    return [load_fingerprint(p, swaps) for p in sorted(Path(folder).glob("*.yaml"))]
