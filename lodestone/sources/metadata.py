"""Facts in the metadata of a model file, written without a network library.

A model file is one protocol buffer message; its metadata are entries of a key and a value. Everything else in
the file is copied byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from lodestone.sources import images

#: Number of the field that metadata entries have in a model file, and of an entry's key and value. Fixed values.
ENTRIES, KEY, VALUE = 14, 1, 2
#: Endings of the keys. Fixed values.
PREPROCESS, PRECISION, IMAGE_SIZE, TARGET_DIM = "_preprocess", "_precision", "_image_size", "_target_dim"


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, and the place behind it."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _coded(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _fields(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """Of each field of a message: its number, and the places where it, its content and the next one start."""
    at = 0
    while at < len(data):
        start = at
        tag, at = _number(data, at)
        kind = tag & 7
        if kind == 2:
            size, at = _number(data, at)
        elif kind == 0:
            size = _number(data, at)[1] - at
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
        else:
            raise ValueError("this is no model file")
        if at + size > len(data):
            raise ValueError("the model file is cut short")
        yield tag >> 3, start, at, at + size
        at += size


def _field(number: int, content: bytes) -> bytes:
    return _coded(number << 3 | 2) + _coded(len(content)) + content


def with_entries(model: bytes, entries: dict[str, str]) -> bytes:
    """The model with these metadata entries, in place of any of the same keys."""
    kept = []
    for number, start, inside, end in _fields(model):
        own = model[inside:end]
        key = next((own[a:b].decode() for n, _, a, b in _fields(own) if n == KEY), "") if number == ENTRIES else None
        if key not in entries:
            kept.append(model[start:end])
    return b"".join(kept) + b"".join(_field(ENTRIES, _field(KEY, k.encode()) + _field(VALUE, v.encode())) for k, v in entries.items())


def attach(file: str | Path, fused: bool, precision: str, image_size: int, target_dim: int, prefix: str = "backbone") -> None:
    """Writes a file's preprocessing, precision, image size and channels into it, under keys that start with ``prefix``."""
    facts = {PREPROCESS: "fused" if fused else "standard", PRECISION: precision, IMAGE_SIZE: str(image_size), TARGET_DIM: str(target_dim)}
    file = Path(file)
    file.write_bytes(with_entries(file.read_bytes(), {prefix + end: v for end, v in facts.items()}))
    images.forget_sessions()
