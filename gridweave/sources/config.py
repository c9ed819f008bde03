"""Configuration trees from YAML, with strict dotted overrides."""

from __future__ import annotations

import copy
from pathlib import Path
from typing import Any

import yaml

ROOT = Path(__file__).resolve().parents[2]


def load(path: str | Path) -> dict[str, Any]:
    """A relative path is looked up below the repository; a missing file raises FileNotFoundError."""
    path = Path(path)
    path = path if path.is_absolute() else ROOT / path
    if not path.is_file():
        raise FileNotFoundError(f"no configuration at {path}")
    return yaml.safe_load(path.read_text()) or {}


def overridden(config: dict[str, Any], changes: list[str]) -> dict[str, Any]:
    """A copy of config with changes "a.b.c=value", values as YAML. ValueError without =, KeyError for a name that isn't there."""
    out = copy.deepcopy(config)
    for change in changes:
        name, equals, value = change.partition("=")
        if not equals:
            raise ValueError(f"not of the form key=value: {change!r}")
        *path, last = name.strip().split(".")
        at = out
        for key in path:
            if not isinstance(at, dict) or key not in at:
                raise KeyError(f"{name}: no {key!r}")
            at = at[key]
        if not isinstance(at, dict) or last not in at:
            raise KeyError(f"{name}: no {last!r}")
        at[last] = yaml.safe_load(value)
    return out


def mode_settings(config: dict[str, Any]) -> dict[str, Any]:
    """The block of the active experiment mode, with mode itself and oodval_cities ([] if it names none)."""
    experiment = config["experiment"]
    mode = experiment["mode"]
    return {"oodval_cities": [], **copy.deepcopy(experiment[mode]), "mode": mode}


def validation_scenes(settings: dict[str, Any], first: int = 31, last: int = 36) -> list[tuple[str, str]]:
    """(scene, city) of the validation split: the numbered scenes of every training city."""
    return [(f"{city}{i}", city) for city in settings["train_cities"] for i in range(first, last + 1)]


def snapshot(config: dict[str, Any], path: str | Path) -> None:
    """Writes the resolved configuration of a run, with its overrides, so that load() gives it again."""
    Path(path).write_text(yaml.safe_dump(config, sort_keys=False, allow_unicode=True))
