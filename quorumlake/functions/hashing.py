"""Random-hyperplane signatures over packed coordinates."""

from __future__ import annotations

from functools import cache
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .packing import COORDINATES, SCALE

BITS = 20
# Seeds of the two tables, generator, projection weights, grid.
SEEDS = (0x9E3779B9, 0x243F6A88)
LCG = (1664525, 1013904223)
WEIGHTS = (1, -3, 5, -7, 11, -13, 17, -19, 23, -29, 31, -37, 41, -43)
GRID_DIMENSIONS, GRID_BITS = 4, 3


@cache
def planes(seed: int) -> tuple[tuple[int, ...], ...]:
    """``BITS`` planes of +1 and -1: the top bit of a 32-bit linear congruential generator."""
    signs = []
    for _ in range(BITS * len(COORDINATES)):
        seed = (seed * LCG[0] + LCG[1]) % (1 << 32)
        signs.append(1 if seed >> 31 else -1)
    n = len(COORDINATES)
    return tuple(tuple(signs[i : i + n]) for i in range(0, len(signs), n))


def _sum(terms) -> Column:
    total = None
    for t in terms:
        total = t if total is None else total + t
    return total


def signature(seed: int, prefix: str = "") -> Column:
    """Bit b is set if plane b has the coordinates, about the centre, on its side or on itself."""
    bits = []
    for b, plane in enumerate(planes(seed)):
        shift = sum(plane) * (SCALE // 2)
        dot = _sum(F.col(prefix + c) if s > 0 else -F.col(prefix + c) for s, c in zip(plane, COORDINATES, strict=True))
        bits.append(F.when(dot >= shift, F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long")))
    return _sum(bits)


def projection(prefix: str = "") -> Column:
    return _sum(F.col(prefix + c) * w for w, c in zip(WEIGHTS, COORDINATES, strict=True))


def coarse_cell(prefix: str = "") -> Column:
    """Three leading bits of each of the first four coordinates; a sentinel counts as zero."""
    parts = [F.call_function("shiftright", F.greatest(F.col(f"{prefix}c{d}"), F.lit(0)), F.lit(16 - GRID_BITS)) * (1 << (d * GRID_BITS)) for d in range(GRID_DIMENSIONS)]
    return _sum(parts).cast("long")


def probe_masks(radius: int) -> list[int]:
    """Masks of at most ``radius`` of the signature's bits, fewest first, then by their bits."""
    if not 0 <= radius <= 3:
        raise ValueError("the probe radius must be between 0 and 3")
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(BITS), r)]
