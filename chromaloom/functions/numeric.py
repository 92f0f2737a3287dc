"""Scalar numeric functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of IEEE formats.
FLOAT32_MAX = 3.4028234663852886e38
HALF_OVERFLOW = 65520.0

# Per-channel image statistics (red, green, blue).
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)


def bin_index(position: Column, resolution: int) -> Column:
    """Floor division, also below zero."""
    return F.floor(position / F.lit(float(resolution))).cast("bigint")


def log2_tpm(tpm: Column) -> Column:
    return F.log2(tpm + 1.0)


def log10_count(count: Column) -> Column:
    return F.log10(count + 1.0)


def log10_total(total: Column) -> Column:
    """An empty store has total 0 and maps to minus infinity, not to NULL."""
    return F.when(total == 0, F.lit(float("-inf"))).otherwise(F.log10(total))


def nan_to_num(value: Column) -> Column:
    x = value.cast("double")
    return (
        F.when(F.isnan(x), F.lit(0.0))
        .when(x == F.lit(float("inf")), F.lit(FLOAT32_MAX))
        .when(x == F.lit(float("-inf")), F.lit(-FLOAT32_MAX))
        .otherwise(x)
    )


def round_half(value: Column, digits: int) -> Column:
    """Rounded to so many decimals, halves away from zero, in plain arithmetic; no minus zero.

    ``F.round`` goes through the decimal text of every number. Beyond 52 bits it is used all the same.
    """
    x = value.cast("double")
    scale = F.lit(10.0**digits)
    units = F.floor(F.abs(x) * scale + 0.5)
    plain = F.when(x < 0, -units).otherwise(units).cast("double") / scale
    return F.when(F.abs(x) * scale < float(2**51), plain).otherwise(F.round(x, digits))


def to_float16(value: Column) -> Column:
    """Nearest half-precision value, ties to even, kept in a double."""
    x = value.cast("double")
    magnitude = F.abs(x)
    exponent = F.greatest(F.floor(F.log2(magnitude)).cast("double"), F.lit(-14.0))
    unit = F.pow(F.lit(2.0), exponent - 10.0)
    return (
        F.when(x.isNull() | F.isnan(x) | (magnitude == 0), x)
        .when(magnitude >= HALF_OVERFLOW, F.signum(x) * F.lit(float("inf")))
        .otherwise(F.rint(x / unit) * unit)
    )


def to_int16(offset: Column) -> Column:
    return offset.cast("smallint")


def distance_index(row: Column, col: Column, offset: int, length: int) -> Column:
    """Distance from the window's own diagonal, held at the last band."""
    return F.least(F.abs(col - row - F.lit(offset)), F.lit(length - 1))


def flat_index(bio: Column, item: Column, n_items: Column | int) -> Column:
    size = n_items if isinstance(n_items, Column) else F.lit(n_items)
    return bio.cast("bigint") * size + item


def split_flat_index(flat: Column, n_items: Column | int) -> tuple[Column, Column]:
    size = n_items if isinstance(n_items, Column) else F.lit(n_items)
    return F.floor(flat / size).cast("bigint"), (flat % size).cast("bigint")


def delta(y_pert: Column, y_orig: Column) -> Column:
    return y_pert - y_orig
