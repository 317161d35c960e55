"""A project's TOML settings, strict and closed. Read by the driver."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path


class ConfigurationError(ValueError):
    """The settings cannot be read or are not valid; the message tells nothing of them."""


@dataclass(frozen=True)
class Project:
    inventory: Path
    source_root: Path
    output_dir: Path
    path_limit: int = 185
    max_workers: int = 4
    create_master: bool = True


#: Whole-number settings and their bounds.
BOUNDS = {"path_limit": (1, 185), "max_workers": (1, 16)}


def load_config(path: str | Path) -> Project:
    """The settings of a file; relative paths in it are relative to its folder, ~ is the home folder."""
    try:
        at = Path(path).expanduser().resolve(strict=True)
        raw = tomllib.loads(at.read_text(encoding="utf-8"))
        paths, build = raw["paths"], raw["build"]
        _only(raw, {"schema_version", "paths", "build"})
        _only(paths, {"inventory", "source_root", "output_dir"})
        _only(build, {*BOUNDS, "create_master"})
        if raw["schema_version"] is True or raw["schema_version"] != 1:
            raise ValueError
        for name, (least, most) in BOUNDS.items():
            value = build.get(name, least)
            if type(value) is not int or not least <= value <= most:
                raise ValueError
        if type(build.get("create_master", True)) is not bool:
            raise ValueError
        found = {}
        for name in ("inventory", "source_root", "output_dir"):
            if not isinstance(paths[name], str) or not paths[name]:
                raise ValueError
            found[name] = (at.parent / Path(paths[name]).expanduser()).resolve()
        return Project(**found, **build)
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        raise ConfigurationError("the configuration is not valid or cannot be read") from None


def _only(table: dict, names: set[str]) -> None:
    if not set(table) <= names:
        raise ValueError
