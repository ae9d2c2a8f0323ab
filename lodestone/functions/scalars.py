"""Scalar column functions: clamping, rounding, names, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Image file extensions. Fixed values.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp"]
#: Suffixes of model file variants. Fixed values.
VARIANT_SUFFIXES = ["_fused_fp16_int8", "_fused_int8", "_fused_fp16", "_fused", "_int8", "_fp16"]


def clamp(x: Column, low, high) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.least(F.greatest(x, lit(low)), lit(high))


def half_even(x: Column) -> Column:
    """Rounded to a whole number, halves to the even neighbour."""
    return F.rint(x).cast("long")


def extension(path: Column) -> Column:
    """The lower-cased extension of a path's last part, without the dot; empty if it has none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(IMAGE_EXTENSIONS)


def stem(path: Column) -> Column:
    """A path's last part without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def sanitised(name: Column) -> Column:
    """A profile name trimmed of spaces and of characters that file names can't have; ``default`` if nothing is left."""
    kept = F.regexp_replace(F.trim(name), r'[\x00-\x1f<>:"/\\|?*]', "")
    return F.when(F.coalesce(F.trim(kept), F.lit("")) == "", "default").otherwise(kept)


def without_variant(name: Column) -> Column:
    """A model file's stem without its variant suffix, in any case."""
    return F.regexp_replace(name, f"(?i)({'|'.join(VARIANT_SUFFIXES)})$", "")


def fixed(x: Column, decimals: int) -> Column:
    """A number as text, rounded by its exact binary value."""
    return F.call_function("format_number", x, F.lit("0." + "0" * decimals if decimals else "0"))


def elapsed(ms: Column) -> Column:
    """A duration for people: hours, minutes and seconds with one decimal, milliseconds with none."""
    one = lambda unit, name: F.concat(fixed(ms / unit, 1), F.lit(name))
    return F.when(ms >= 3_600_000, one(3_600_000.0, "h")).when(ms >= 60_000, one(60_000.0, "m")).when(ms >= 1000, one(1000.0, "s")).otherwise(F.concat(fixed(ms, 0), F.lit("ms")))


def percentage(part: Column, total: Column) -> Column:
    """One decimal and a percent sign; empty if the total is not positive."""
    return F.when(total > 0, F.concat(fixed(part / total * 100, 1), F.lit("%"))).otherwise(F.lit(""))


def kernel_size(height: Column, width: Column, sigma: float = 4.0) -> Column:
    """The side of the smoothing kernel: 6 sigma made odd, at least 3, at most the shorter side made odd."""
    side = half_even(F.lit(6 * sigma))
    return F.least(F.greatest(side.bitwiseOR(F.lit(1).cast("long")), F.lit(3).cast("long")), F.least(height, width).cast("long").bitwiseOR(F.lit(1).cast("long")))
