"""Which windows hold a cell, as array columns: the common ground of convolution and pooling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.plans.geometry import Window

MODES = ("zeros", "reflect", "replicate", "circular")


def images(i: Column, w: Window, mode: str) -> Column:
    """The padded coordinates at which a cell appears: its own, and its copies beyond the edges for padding modes other than zeros."""
    n, p = w.n, w.padding
    if mode == "zeros" or p == 0:
        return F.array(i)
    if mode == "reflect":
        if p >= n:
            raise ValueError("reflection needs a padding below the extent")
        copies = [F.when((i > 0) & (i <= p), -i), F.when((i < n - 1) & (i >= n - 1 - p), F.lit(2 * (n - 1)) - i)]
        return F.array_compact(F.array(i, *copies))
    if mode == "circular":
        if p > n:
            raise ValueError("circular padding is at most the extent")
        return F.array_compact(F.array(i, F.when(i < p, i + n), F.when(i >= n - p, i - n)))
    if mode == "replicate":
        before = F.when(i == 0, F.sequence(F.lit(-p).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        after = F.when(i == n - 1, F.sequence(F.lit(n).cast("long"), F.lit(n + p - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        return F.concat(F.array(i), before, after)
    raise ValueError(f"padding mode is one of {MODES}")


def holding(i: Column, w: Window, mode: str = "zeros") -> Column:
    """array<struct<o, t>>: the windows that hold a cell, and which tap of each it is under."""

    def at(j: Column) -> Column:
        taps = F.sequence(F.lit(0).cast("long"), F.lit(w.kernel - 1).cast("long"))
        made = F.transform(taps, lambda t: F.struct((j + w.padding - t * w.dilation).alias("n"), t.alias("t")))
        inside = F.filter(made, lambda m: (m["n"] >= 0) & (m["n"] <= (w.out - 1) * w.stride) & (F.pmod(m["n"], F.lit(w.stride)) == 0))
        return F.transform(inside, lambda m: F.struct((F.call_function("div", m["n"], F.lit(w.stride).cast("long"))).alias("o"), m["t"].alias("t")))

    return at(i) if mode == "zeros" or not w.padding else F.flatten(F.transform(images(i, w, mode), at))


def expand(x: DataFrame, wins: Sequence[Window], mode: str = "zeros") -> DataFrame:
    """(i0, i1, i2.., v, o2.., t2..): a row for each window that holds a cell.  Stays in the row's own task."""
    out = x
    for d in range(2, len(wins)):
        out = out.withColumn("_w", F.explode(holding(F.col(f"i{d}"), wins[d], mode))).withColumns({f"o{d}": F.col("_w.o"), f"t{d}": F.col("_w.t")}).drop("_w")
    return out


def out_shape(wins: Sequence[Window], channels: int | None = None) -> tuple[int, ...]:
    return (wins[0].n, channels if channels is not None else wins[1].n, *(w.out for w in wins[2:]))


def has_empty_windows(wins: Sequence[Window]) -> bool:
    """Whether some window lies in the padding with all of its taps, so that it gets no row from any cell."""
    for w in wins[2:]:
        for o in range(w.out):
            if w.padding <= w.stride * o and w.stride * o - w.padding < w.n:
                continue  # its first tap is a cell
            if not any(0 <= w.stride * o + w.dilation * t - w.padding < w.n for t in range(w.kernel)):
                return True
    return False


def as_output(columns: Sequence[str]) -> list[Column]:
    """o2.. become the index columns of the output."""
    return [F.col(f"o{k}").alias(f"i{k}") for k in range(2, 2 + len(columns))]
