"""Average and maximum pooling over cells, with adjoints."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as Over

from cellweave.operators.slide import expand, has_empty_windows, out_shape
from cellweave.plans.geometry import Window
from cellweave.schema import fill, index_columns


def _outs(wins: Sequence[Window]) -> list:
    return [F.col(f"o{d}").alias(f"i{d}") for d in range(2, len(wins))]


def _volume(wins: Sequence[Window]) -> int:
    return math.prod(w.kernel for w in wins[2:])


def _only_plain(wins: Sequence[Window]) -> None:
    if any(w.dilation != 1 for w in wins[2:]):
        raise ValueError("average pooling has no dilation")


def avg_pool(x: DataFrame, wins: Sequence[Window]) -> DataFrame:
    """Mean over each window; padded zeros count."""
    _only_plain(wins)
    y = expand(x, wins).groupBy("i0", "i1", *_outs(wins)).agg((F.sum("v") / _volume(wins)).alias("v"))
    return fill(y, out_shape(wins), index_columns(len(wins))) if has_empty_windows(wins) else y


def avg_pool_adjoint(dy: DataFrame, wins: Sequence[Window]) -> DataFrame:
    """Each window's gradient, shared out evenly among its taps."""
    _only_plain(wins)
    names, out = index_columns(len(wins)), dy

    def read_by(d: int, w: Window):
        taps = F.sequence(F.lit(0).cast("long"), F.lit(w.kernel - 1).cast("long"))
        return F.filter(F.transform(taps, lambda t: F.col(f"i{d}") * w.stride + t - w.padding), lambda i: (i >= 0) & (i < w.n))

    for d in range(2, len(wins)):
        out = out.withColumn(f"i{d}", F.explode(read_by(d, wins[d])))
    return fill(out.groupBy(*names).agg((F.sum("v") / _volume(wins)).alias("v")), tuple(w.n for w in wins), names)


def max_pool(x: DataFrame, wins: Sequence[Window]) -> DataFrame:
    """Largest value of each window; padding is minus infinity."""
    y = expand(x, wins).groupBy("i0", "i1", *_outs(wins)).agg(F.max("v").alias("v"))
    return fill(y, out_shape(wins), index_columns(len(wins)), missing=float("-inf")) if has_empty_windows(wins) else y


def max_pool_adjoint(x: DataFrame, dy: DataFrame, wins: Sequence[Window]) -> DataFrame:
    """Each window's gradient goes to its largest cell, the first in row-major order of those that tie."""
    names = index_columns(len(wins))
    order = F.lit(0).cast("long")
    for d in range(2, len(wins)):
        order = order * wins[d].kernel + F.col(f"t{d}")
    cell = F.struct(*(F.col(n) for n in names[2:]))
    best = expand(x, wins).groupBy("i0", "i1", *(f"o{d}" for d in range(2, len(wins)))).agg(F.max_by(cell, F.struct("v", (-order).alias("first"))).alias("cell"))
    right = dy.select("i0", "i1", *(F.col(f"i{d}").alias(f"o{d}") for d in range(2, len(wins))), F.col("v").alias("_dy"))
    both = best.join(right, ["i0", "i1", *(f"o{d}" for d in range(2, len(wins)))])
    dx = both.select("i0", "i1", "cell.*", "_dy").groupBy(*names).agg(F.sum("_dy").alias("v"))
    return fill(dx, tuple(w.n for w in wins), names)


def max_pool_1d_frames(x: DataFrame, w: Window) -> DataFrame:
    """1-D, stride 1, no dilation, cells without gaps: a sliding frame instead of an expansion."""
    if w.stride != 1 or w.dilation != 1 or w.padding or w.kernel > w.n:
        raise ValueError("frames need stride 1, dilation 1 and no padding")
    over = Over.partitionBy("i0", "i1").orderBy("i2").rowsBetween(0, w.kernel - 1)
    return x.withColumn("v", F.max("v").over(over)).where(F.col("i2") < w.out)
