"""Numpy kernels for images: preprocessing, smoothing, colouring, PNG writing."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Channel means and deviations of the usual training images, in RGB order. Fixed values.
MEAN = np.array([0.485, 0.456, 0.406])
STD = np.array([0.229, 0.224, 0.225])


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with half-pixel centres, in double; (h, w) or (h, w, c)."""

    def axis(n_out: int, n_in: int):
        at = (np.arange(n_out) + 0.5) * n_in / n_out - 0.5
        low = np.floor(at).astype(int)
        part = np.where(low < 0, 0.0, at - low)
        return np.clip(low, 0, n_in - 1), np.clip(low + 1, 0, n_in - 1), part

    image = image.astype(np.float64)
    y0, y1, fy = axis(height, image.shape[0])
    x0, x1, fx = axis(width, image.shape[1])
    more = (1,) * (image.ndim - 2)
    fy, fx = fy.reshape(-1, 1, *more), fx.reshape(1, -1, *more)
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def preprocessed(bgr: np.ndarray, size: int, mode: str = "standard") -> np.ndarray:
    """A BGR image as float32 channels (3, size, size) in RGB order.

    ``fused`` keeps 0 to 255 for models that normalise themselves. ``standard`` subtracts the means from the 0 to 255 values, then divides by 255
    and by the deviations: the means are in effect near 0, as in the stored models. ``normalised`` is (x / 255 - mean) / std.
    """
    rgb = np.rint(resized(bgr, size, size))[:, :, ::-1].transpose(2, 0, 1)
    mean, std = MEAN.reshape(3, 1, 1), STD.reshape(3, 1, 1)
    if mode == "fused":
        out = rgb
    elif mode == "standard":
        out = (rgb - mean) / 255 / std
    elif mode == "normalised":
        out = (rgb / 255 - mean) / std
    else:
        raise ValueError(f"there is no preprocessing mode {mode}")
    return out.astype(np.float32)


def kernel_side(height: int, width: int, sigma: float = 4.0) -> int:
    shorter = min(height, width)
    if shorter < 2:
        raise ValueError("a map to be smoothed needs two rows and two columns")
    return max(3, min(round(6 * sigma) | 1, shorter | 1))


def smoothed(scores: np.ndarray, sigma: float = 4.0) -> np.ndarray:
    """Separable Gaussian smoothing, edges mirrored without their last row."""
    side = kernel_side(*scores.shape, sigma)
    at = np.arange(side) - side // 2
    kernel = np.exp(-(at**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    out = scores.astype(np.float64)
    for axis in (0, 1):
        width = [(side // 2,) * 2 if a == axis else (0, 0) for a in (0, 1)]
        padded = np.pad(out, width, mode="reflect" if out.shape[axis] > side // 2 else "symmetric")
        out = sum(k * np.take(padded, np.arange(out.shape[axis]) + i, axis=axis) for i, k in enumerate(kernel))
    return out


def spread(scores: np.ndarray) -> np.ndarray | None:
    """Scores from 0 to 255 over their range; None if they hardly differ."""
    low, high = float(scores.min()), float(scores.max())
    return None if high - low <= 1e-8 else np.rint((scores - low) * 255 / (high - low)).astype(np.uint8)


def coloured(levels: np.ndarray) -> np.ndarray:
    """The blue to red rainbow of 256 levels, as BGR."""
    x = levels.astype(np.float64) / 255
    ramp = lambda c: np.clip(1.5 - np.abs(4 * x - c), 0, 1)
    return np.rint(np.stack([ramp(1), ramp(2), ramp(3)], axis=-1) * 255).astype(np.uint8)


def heatmap(bgr: np.ndarray, scores: np.ndarray, weight: float = 0.4) -> np.ndarray:
    """The image with its scores smoothed, resized, spread and blended over it; the image itself if the scores are flat, or one row or column only."""
    if min(scores.shape) < 2:
        return bgr
    full = resized(smoothed(scores), bgr.shape[0], bgr.shape[1])
    levels = spread(full)
    if levels is None:
        return bgr
    return np.rint((1 - weight) * bgr + weight * coloured(levels)).astype(np.uint8)


def png(bgr: np.ndarray) -> bytes:
    """An 8-bit BGR image as PNG."""
    h, w, _ = bgr.shape
    rows = np.concatenate([np.zeros((h, 1), dtype=np.uint8), bgr[:, :, ::-1].reshape(h, -1)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")
