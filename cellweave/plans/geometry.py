"""Geometry of sliding windows over balanced blocks: output extents, halos, buffers and needed ranges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from cellweave.functions.index import block_start, block_stop
from cellweave.plans.partition import CartesianPartition


def spread(value: int | Sequence[int], dim: int, name: str) -> tuple[int, ...]:
    """A scalar for all feature dimensions, or one value for each; ValueError for another length."""
    out = (int(value),) * dim if isinstance(value, int) else tuple(int(v) for v in value)
    if len(out) != dim:
        raise ValueError(f"{name} has {len(out)} values for {dim} dimensions")
    return out


@dataclass(frozen=True)
class Window:
    """One dimension of a sliding window: kernel, stride, padding, dilation over an extent."""

    n: int
    kernel: int = 1
    stride: int = 1
    padding: int = 0
    dilation: int = 1

    @property
    def reach(self) -> int:
        return self.dilation * (self.kernel - 1)

    @property
    def out(self) -> int:
        return (self.n + 2 * self.padding - self.reach - 1) // self.stride + 1

    def needed(self, p: int, k: int) -> tuple[int, int]:
        """First and last input index that worker k needs for its share of the output, clamped to the extent."""
        first, stop = block_start(self.out, p, k), block_stop(self.out, p, k)
        return max(0, self.stride * first - self.padding), min(self.n - 1, self.stride * (stop - 1) + self.reach - self.padding)

    def reaches(self, p: int, k: int) -> tuple[int, int]:
        """How far beyond its own block worker k reads, left and right; negative where it leaves cells unread."""
        first, last = self.needed(p, k)
        return block_start(self.n, p, k) - first, last - (block_stop(self.n, p, k) - 1)


@dataclass(frozen=True)
class Halo:
    """One worker and dimension: halo widths, what is sent to either side, and the local range that is read."""

    place: int
    dim: int
    left: int
    right: int
    send_left: int
    send_right: int
    needed_start: int
    needed_stop: int


def windows(shape: Sequence[int], kernel, stride=1, padding=0, dilation=1) -> list[Window]:
    """A window for each dimension of the tensor; leading dimensions (batch, channel) have none."""
    features = len(shape) - 2
    k, s, p, d = (spread(v, features, name) for v, name in ((kernel, "kernel"), (stride, "stride"), (padding, "padding"), (dilation, "dilation")))
    return [Window(n) for n in shape[:2]] + [Window(n, *args) for n, *args in zip(shape[2:], k, s, p, d, strict=True)]


def halos(p: CartesianPartition, wins: Sequence[Window]) -> list[Halo]:
    """Halos of every worker in every dimension."""
    out = []
    for place in range(p.size):
        at, near = p.index(place), p.neighbours(place)
        for d, w in enumerate(wins):
            raw = w.reaches(p.shape[d], at[d])
            left, right = (max(0, r) for r in raw)
            send_left = max(0, w.reaches(p.shape[d], at[d] - 1)[1]) if near[d][0] is not None else 0
            send_right = max(0, w.reaches(p.shape[d], at[d] + 1)[0]) if near[d][1] is not None else 0
            local = block_stop(w.n, p.shape[d], at[d]) - block_start(w.n, p.shape[d], at[d])
            out.append(Halo(place, d, left, right, send_left, send_right, -min(0, raw[0]), local + left + right))
    return out
