"""Profiles (option documents) and their places, on the driver."""

from __future__ import annotations

import json
import re
from dataclasses import replace
from pathlib import Path

from lodestone.config import EngineConfig

MARKER = ".last_profile"
MODEL_FILE, CONFIG_FILE = "model", "config.json"


def safe_name(name: str) -> str:
    """A profile name that can be a file name; ``default`` if nothing is left of it."""
    return re.sub(r'[\x00-\x1f<>:"/\\|?*]', "", name.strip()).strip() or "default"


def base_folder(path: str | Path) -> Path:
    """The folder for outputs: a ``.json`` file stands for its folder."""
    path = Path(path)
    return path.parent if path.suffix.lower() == ".json" else path


def model_path(base: str | Path, profile: str) -> Path:
    return base_folder(base) / safe_name(profile) / MODEL_FILE


def config_path(base: str | Path, profile: str) -> Path:
    return base_folder(base) / safe_name(profile) / CONFIG_FILE


def save(config: EngineConfig, file: str | Path) -> Path:
    file = Path(file)
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(json.dumps(config.stored(), indent=2, ensure_ascii=False), encoding="utf-8")
    return file


def load(file: str | Path) -> EngineConfig:
    """A profile; its name is the file's stem whatever it says."""
    file = Path(file)
    return replace(EngineConfig.from_stored(json.loads(file.read_text(encoding="utf-8"))), profile_name=file.stem)


def beside(model: str | Path) -> EngineConfig | None:
    """The profile in the folder of a model, if there is one."""
    file = Path(model).parent / CONFIG_FILE
    return load(file) if file.exists() else None


def listed(folder: str | Path) -> list[str]:
    """Names of the profiles in a folder, in an order that ignores case."""
    folder = Path(folder)
    return sorted((f.stem for f in folder.glob("*.json")), key=str.lower) if folder.is_dir() else []


def delete(folder: str | Path, name: str) -> bool:
    file = Path(folder) / f"{safe_name(name)}.json"
    if not file.exists():
        return False
    file.unlink()
    return True


def set_last(folder: str | Path, name: str) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / MARKER).write_text(name, encoding="utf-8")


def last(folder: str | Path) -> str | None:
    file = Path(folder) / MARKER
    return (file.read_text(encoding="utf-8").strip() or None) if file.exists() else None
