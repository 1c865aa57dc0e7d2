"""The arithmetic of balanced blocks: who owns an index, and where each block begins.

Of n cells over p workers, the first n mod p workers have one cell more.  All of it is plain arithmetic on columns, so Catalyst folds the
constants and no join is needed to find an owner.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_size(n: int, p: int, k: int) -> int:
    return n // p + (k < n % p)


def block_start(n: int, p: int, k: int) -> int:
    return n // p * k + min(k, n % p)


def block_stop(n: int, p: int, k: int) -> int:
    return block_start(n, p, k) + block_size(n, p, k)


def subshape(p_shape: Sequence[int], index: Sequence[int], shape: Sequence[int]) -> tuple[int, ...]:
    return tuple(block_size(n, p, k) for p, k, n in zip(p_shape, index, shape, strict=True))


def start_index(p_shape: Sequence[int], index: Sequence[int], shape: Sequence[int]) -> tuple[int, ...]:
    return tuple(block_start(n, p, k) for p, k, n in zip(p_shape, index, shape, strict=True))


def stop_index(p_shape: Sequence[int], index: Sequence[int], shape: Sequence[int]) -> tuple[int, ...]:
    return tuple(block_stop(n, p, k) for p, k, n in zip(p_shape, index, shape, strict=True))


def size_column(n: int, p: int, k: Column) -> Column:
    return F.lit(n // p) + (k < n % p).cast("long")


def start_column(n: int, p: int, k: Column) -> Column:
    return F.lit(n // p) * k + F.least(k, F.lit(n % p))



def div(a: Column, b: int) -> Column:
    """Integer quotient."""
    return F.call_function("div", a.cast("long"), F.lit(b).cast("long")) if b > 1 else a.cast("long")


def owner(i: Column, n: int, p: int) -> Column:
    """The worker that owns index i of a balanced extent."""
    q, r = divmod(n, p)
    long_part = div(i, q + 1)
    if q == 0:
        return long_part
    return F.when(i < r * (q + 1), long_part).otherwise(F.lit(r) + div(i - r * (q + 1), q))


def owner_unbalanced(i: Column, sizes: Sequence[int]) -> Column:
    """The worker that owns index i where blocks have the given sizes: how many blocks end at or before it."""
    stop, out = 0, F.lit(0).cast("long")
    for size in list(sizes)[:-1]:
        stop += size
        out = out + (i >= stop).cast("long")
    return out


def flat_c(index: Sequence[Column], shape: Sequence[int]) -> Column:
    """Row-major flat index."""
    out = F.lit(0).cast("long")
    for i, n in zip(index, shape, strict=True):
        out = out * n + i
    return out


def flat_f(index: Sequence[Column], shape: Sequence[int]) -> Column:
    """Column-major flat index."""
    return flat_c(list(index)[::-1], list(shape)[::-1])


def rank_column(index: Sequence[Column], shape: Sequence[int], p_shape: Sequence[int]) -> Column:
    """Rank in a row-major worker grid that owns a cell."""
    return flat_c([owner(i, n, p) for i, n, p in zip(index, shape, p_shape, strict=True)], p_shape)


def intersection(a0: Sequence[int], a1: Sequence[int], b0: Sequence[int], b1: Sequence[int]) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]:
    """Start, stop and extent of what two boxes share; the extent is 0 in a dimension where they are apart."""
    start, stop = tuple(map(max, a0, b0)), tuple(map(min, a1, b1))
    return start, stop, tuple(max(0, y - x) for x, y in zip(start, stop, strict=True))


def intersection_slice(a0: Sequence[int], a1: Sequence[int], b0: Sequence[int], b1: Sequence[int]) -> tuple[slice, ...] | None:
    """What box a shares with box b, counted from a's start; None if nothing."""
    if any(hasattr(x, "__len__") for x in (*a0, *a1, *b0, *b1)):
        raise ValueError("starts and stops are flat sequences")
    start, stop, extent = intersection(a0, a1, b0, b1)
    if not all(extent):
        return None
    return tuple(slice(x - o, y - o) for x, y, o in zip(start, stop, a0, strict=True))


def partition_intersection(p_r: Sequence[int], r: Sequence[int], p_s: Sequence[int], s: Sequence[int], shape: Sequence[int]) -> tuple[slice, ...] | None:
    """What block r of one balanced grid shares with block s of another, counted from r's start."""
    return intersection_slice(start_index(p_r, r, shape), stop_index(p_r, r, shape), start_index(p_s, s, shape), stop_index(p_s, s, shape))


def assemble_slices(start: Sequence[int], stop: Sequence[int]) -> tuple[slice, ...]:
    return tuple(map(slice, start, stop))


def slice_shape(slices: Sequence[slice]) -> tuple[int, ...]:
    return tuple(s.stop - s.start for s in slices)


def slice_volume(slices: Sequence[slice]) -> int:
    return math.prod(slice_shape(slices))


def between(index: Sequence[Column], slices: Sequence[slice]) -> Column:
    """Whether a cell lies in the slices: a predicate that reaches the scan."""
    out = F.lit(True)
    for i, s in zip(index, slices, strict=True):
        out = out & (i >= s.start) & (i < s.stop)
    return out


def range_index(shape: Sequence[int]) -> Iterator[tuple[int, ...]]:
    return product(*map(range, shape))


def index_filter(index: Sequence[int], dims: Sequence[int], invert: bool = False) -> tuple[int | None, ...]:
    """The index with the given dimensions fixed and the others free (None), or the reverse."""
    return tuple(i if (d in dims) != invert else None for d, i in enumerate(index))


def filtered_range_index(shape: Sequence[int], fixed: Sequence[int | None]) -> Iterator[tuple[int, ...]]:
    return product(*(range(n) if f is None else (f,) for n, f in zip(shape, fixed, strict=True)))


def worker_layout(shape: Sequence[int]) -> dict[tuple[int, ...], int]:
    """Rank at each place of a grid."""
    return {index: rank for rank, index in enumerate(range_index(shape))}
