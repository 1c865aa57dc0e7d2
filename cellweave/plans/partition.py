"""Teams of workers and worker grids, as values on the driver.

A partition decides which worker owns which cells; it holds no data.  From it come the small tables and key expressions by which the
operators join, group and place rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from cellweave.functions.index import range_index


@dataclass(frozen=True)
class Partition:
    """An ordered team.  No ranks: a team in which nobody takes part."""

    ranks: tuple[int, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "ranks", tuple(int(r) for r in self.ranks))
        if len(set(self.ranks)) != len(self.ranks):
            raise ValueError("a worker is in a team once")

    @property
    def size(self) -> int:
        return len(self.ranks)

    @property
    def active(self) -> bool:
        return bool(self.ranks)

    @property
    def shape(self) -> tuple[int, ...]:
        return (self.size,)

    @property
    def dim(self) -> int:
        return len(self.shape)

    def inclusive(self, places: Iterable[int]) -> Partition:
        """The workers at these places of this team, in the order given."""
        return Partition(tuple(self.ranks[k] for k in places))

    def union(self, other: Partition) -> Partition:
        """This team's workers, then those that only the other has."""
        return Partition(tuple(dict.fromkeys((*self.ranks, *other.ranks))))

    def cartesian(self, shape: Sequence[int]) -> CartesianPartition:
        """The team as a grid; the grid has a place for each worker."""
        return CartesianPartition(self.ranks, tuple(shape))


@dataclass(frozen=True)
class CartesianPartition(Partition):
    """A team on a row-major grid."""

    grid: tuple[int, ...] = ()

    def __post_init__(self):
        super().__post_init__()
        object.__setattr__(self, "grid", tuple(int(n) for n in self.grid))
        if math.prod(self.grid) != self.size:
            raise ValueError(f"a grid of shape {self.grid} does not hold {self.size} workers")

    @property
    def shape(self) -> tuple[int, ...]:
        return self.grid

    def index(self, place: int) -> tuple[int, ...]:
        """Coordinates of the worker at this place."""
        if not 0 <= place < self.size:
            raise ValueError(f"no worker at place {place}")
        out = []
        for n in reversed(self.grid):
            place, k = divmod(place, n)
            out.append(k)
        return tuple(reversed(out))

    def place(self, index: Sequence[int]) -> int:
        out = 0
        for k, n in zip(index, self.grid, strict=True):
            out = out * n + k
        return out

    def neighbours(self, place: int) -> list[tuple[int | None, int | None]]:
        """Left and right neighbour in each dimension; None beyond the edge."""
        at = self.index(place)
        step = lambda d, k: self.place((*at[:d], at[d] + k, *at[d + 1 :])) if 0 <= at[d] + k < self.grid[d] else None
        return [(step(d, -1), step(d, 1)) for d in range(self.dim)]

    def lines(self, remain: Sequence[bool]) -> list[CartesianPartition]:
        """The sub-grids that keep the flagged dimensions, one for each combination of the others."""
        if len(remain) != self.dim:
            raise ValueError("one flag for each dimension")
        groups: dict[tuple, list[int]] = {}
        for place, at in enumerate(range_index(self.grid)):
            groups.setdefault(tuple(k for k, r in zip(at, remain, strict=True) if not r), []).append(self.ranks[place])
        kept = tuple(n for n, r in zip(self.grid, remain, strict=True) if r)
        return [CartesianPartition(tuple(ranks), kept or (1,)) for ranks in groups.values()]

    def line_through(self, place: int, remain: Sequence[bool]) -> CartesianPartition:
        return next(p for p in self.lines(remain) if self.ranks[place] in p.ranks)


def grid_of(shape: Sequence[int], first: int = 0) -> CartesianPartition:
    n = math.prod(shape)
    return CartesianPartition(tuple(range(first, first + n)), tuple(shape))


def _aligned(p: CartesianPartition, dims: int, transpose: bool) -> tuple[list[int], list[list[int]]]:
    """Shape and coordinates on a grid of `dims` dimensions: reversed if asked for, then padded on the left."""
    turn = (lambda x: list(x)[::-1]) if transpose else list
    pad = dims - p.dim
    return [1] * pad + turn(p.shape), [[0] * pad + turn(p.index(k)) for k in range(p.size)]


def _colours(shape: list[int], places: list[list[int]], match: list[int], transpose: bool) -> list[int]:
    """Number of each place within the matching dimensions; reversed grids are numbered column-major."""
    order = match[::-1] if transpose else match
    out = []
    for at in places:
        n = 0
        for d in order:
            n = n * shape[d] + at[d]
        out.append(n)
    return out


def replication(source: CartesianPartition, dest: CartesianPartition, transpose_src: bool = False, transpose_dest: bool = False) -> list[tuple[int, int]]:
    """Places (source, destination) that a broadcast connects: every destination has one source.

    The source's shape, padded on the left with ones, equals the destination's or is 1 in each dimension; ValueError otherwise.
    """
    if source.dim > dest.dim:
        raise ValueError("no broadcast: the source grid has more dimensions than the destination")
    s_shape, s_at = _aligned(source, dest.dim, transpose_src)
    d_shape, d_at = _aligned(dest, dest.dim, transpose_dest)
    if any(a not in (1, b) for a, b in zip(s_shape, d_shape, strict=True)):
        raise ValueError(f"no broadcast from {s_shape} to {d_shape}")
    match = [d for d in range(dest.dim) if s_shape[d] == d_shape[d]]
    by = {c: k for k, c in enumerate(_colours(s_shape, s_at, match, transpose_src))}
    return [(by[c], k) for k, c in enumerate(_colours(d_shape, d_at, match, transpose_dest))]


def reduction(source: CartesianPartition, dest: CartesianPartition, transpose_src: bool = False, transpose_dest: bool = False) -> list[tuple[int, int]]:
    """Places (source, destination) that a sum-reduction connects: the mirror image of a broadcast."""
    if dest.dim > source.dim:
        raise ValueError("no reduction: the destination grid has more dimensions than the source")
    return [(s, d) for d, s in replication(dest, source, transpose_dest, transpose_src)]


def axes_to_reduce(p: CartesianPartition, axes_reduce: Sequence[int] | None = None, axes_keep: Sequence[int] | None = None) -> tuple[int, ...]:
    """The axes of an all-reduction, given either way; ValueError for both, neither, or an axis that the grid lacks."""
    if (axes_reduce is None) == (axes_keep is None):
        raise ValueError("give either axes_reduce or axes_keep")
    axes = axes_reduce if axes_reduce is not None else [d for d in range(p.dim) if d not in axes_keep]
    if any(not 0 <= d < p.dim for d in (*axes, *(axes_keep or ()))):
        raise ValueError("no such axis")
    return tuple(sorted(set(axes)))


def check_repartition(p_x: CartesianPartition, p_y: CartesianPartition, shape: Sequence[int]) -> None:
    if p_x.dim != p_y.dim:
        raise ValueError("both grids have the same number of dimensions")
    if p_x.dim != len(shape):
        raise ValueError("the grids have as many dimensions as the tensor")
    for n, a, b in zip(shape, p_x.shape, p_y.shape, strict=True):
        if n == 1 and (a > 1 or b > 1):
            raise ValueError("an extent of 1 cannot be split")
