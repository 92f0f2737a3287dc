"""Array-valued columns: reshaping, cropping and vector arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A column used inside a lambda would otherwise be computed again per element.
    """
    return F.transform(F.array(value), body)[0]


def reshape_bins(vec: Column, dim: int) -> Column:
    """Flat vector to an array of bins of ``dim`` values; the length must divide."""
    size = F.size(vec)
    bad = F.concat(F.lit("vector of "), size.cast("string"), F.lit(f" values does not divide into bins of {dim}"))
    starts = F.sequence(F.lit(0), F.floor(size / dim).cast("int") - 1)
    bins = F.transform(starts, lambda i: F.slice(vec, i * dim + 1, dim))
    return F.when((size == 0) | (size % dim != 0), F.raise_error(bad)).otherwise(bins)


def flatten_bins(bins: Column) -> Column:
    return F.flatten(bins)


def center_crop_1d(values: Column, length: int) -> Column:
    """Middle ``length`` elements; an odd surplus leaves the extra element on the right."""
    size = F.size(values)
    bad = F.concat(F.lit("cannot crop "), size.cast("string"), F.lit(f" elements to {length}"))
    start = F.floor((size - length) / 2).cast("int") + 1
    return F.when(size < length, F.raise_error(bad)).otherwise(F.slice(values, start, length))


def vector_sum(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: a.cast("double") + b.cast("double"))


def add_scaled(left: Column, right: Column, scale: float) -> Column:
    return F.zip_with(left, right, lambda a, b: a.cast("double") + b.cast("double") * F.lit(float(scale)))


def vector_total(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def layer_norm(vec: Column, eps: float = 1e-5) -> Column:
    """Zero mean and unit population variance, without learned scale or shift."""
    size = F.size(vec)

    def scaled(mean: Column) -> Column:
        spread = F.aggregate(
            vec, F.lit(0.0), lambda acc, x: acc + F.pow(x.cast("double") - mean, F.lit(2.0))
        )
        return bind(
            F.sqrt(spread / size + F.lit(eps)),
            lambda std: F.transform(vec, lambda x: (x.cast("double") - mean) / std),
        )

    return bind(vector_total(vec) / size, scaled)
