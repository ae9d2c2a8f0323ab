"""Where relative paths start: the nearest folder, from a start upwards, that holds models."""

from __future__ import annotations

from pathlib import Path

MARKER = "models"


def root(start: str | Path = ".") -> Path:
    """The nearest folder from ``start`` upwards with a folder of models in it; ``start`` if there is none."""
    start = Path(start).resolve()
    return next((folder for folder in (start, *start.parents) if (folder / MARKER).is_dir()), start)


def resolved(path: str | Path, start: str | Path = ".") -> Path:
    """An absolute path as it is, a relative one below ``root``."""
    path = Path(path)
    return path.resolve() if path.is_absolute() else (root(start) / path).resolve()
