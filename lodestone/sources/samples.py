"""Sample plates for trying the engine: normal ones, and ones with a stain."""

from __future__ import annotations

from pathlib import Path

import numpy as np

from lodestone.functions.images import png


def plate(stain: int | None = None, side: int = 256) -> np.ndarray:
    """A grey plate with a square (BGR); ``stain`` places a disc, which for large numbers lies outside. Sizes and colours are fixed values."""
    out = np.full((side, side, 3), 180, dtype=np.uint8)
    low, high = 60 * side // 256, 196 * side // 256
    out[low : high + 1, low : high + 1] = (120, 150, 110)
    if stain is not None:
        y, x = np.mgrid[:side, :side]
        scale = side / 256
        out[(x - (120 + 8 * stain) * scale) ** 2 + (y - 80 * scale) ** 2 <= (18 * scale) ** 2] = (40, 40, 220)
    return out


def write(folder: str | Path, ok: int = 10, ng: int = 6, side: int = 256) -> None:
    """Writes ``ok/``, ``ng/`` and ``test/`` below a folder."""
    folder = Path(folder)
    for name, pictures in {"ok": {f"ok_{k:02}": None for k in range(ok)}, "ng": {f"ng_{k:02}": k for k in range(ng)}, "test": {"ok_sample": None, "ng_99": 99}}.items():
        (folder / name).mkdir(parents=True, exist_ok=True)
        for stem, stain in pictures.items():
            (folder / name / f"{stem}.png").write_bytes(png(plate(stain, side)))
