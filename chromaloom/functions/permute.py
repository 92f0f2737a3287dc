"""A seeded permutation of 0 .. n-1 as column arithmetic: a shuffled order without a sort or a shuffle.

An index is a place on a grid of two sides whose product is n or little more. Each round moves one side by a hash
of the other, which can be undone, so the whole is one-to-one on the grid. An index that lands beyond n goes
on from there until it is below n, which keeps it one-to-one on 0 .. n-1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
# A product just above n lies within the square root of twice a side, 2**16 for any n that fits a long.
SEARCHED = 2**16


def grid_sides(n: int) -> tuple[int, int]:
    """Sides a and b, near the square root of n, whose product is least of those that reach n."""
    if n < 1:
        raise ValueError(f"an order needs at least one row, not {n}")
    root = math.isqrt(n - 1) + 1
    return min(((a, -(-n // a)) for a in range(root, min(root + SEARCHED, 2 * root) + 1)), key=lambda s: s[0] * s[1])


def _mixed(x: Column, sides: tuple[int, int], keys: tuple[int, ...], back: bool) -> Column:
    a, b = sides
    parts = [F.call_function("div", x, F.lit(b)), F.pmod(x, F.lit(b))]
    for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
        moved = turn % 2
        step = F.pmod(F.xxhash64(*[F.lit(k) for k in keys], F.lit(turn), parts[1 - moved]), F.lit(sides[moved]))
        parts[moved] = F.pmod(parts[moved] - step if back else parts[moved] + step, F.lit(sides[moved]))
    return parts[0] * F.lit(b) + parts[1]


def _walked(index: Column, n: int, keys: tuple[int, ...], back: bool) -> Column:
    sides = grid_sides(n)
    beyond = sides[0] * sides[1] - n
    landed = _mixed(index.cast("bigint"), sides, keys, back)
    if not beyond:
        return landed
    # So many places lie beyond n, and no walk meets one of them twice.
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(beyond)), landed, lambda at, _: F.when(at < n, at).otherwise(_mixed(at, sides, keys, back))
    )
    return F.when(landed < n, landed).otherwise(walk)


def permuted(index: Column, n: int, *keys: int) -> Column:
    """Position of an index of 0 .. n-1 in the order that ``keys`` (seed, epoch) choose."""
    return _walked(index, n, keys, False)


def index_at(position: Column, n: int, *keys: int) -> Column:
    """The index at a position: ``permuted`` undone."""
    return _walked(position, n, keys, True)
