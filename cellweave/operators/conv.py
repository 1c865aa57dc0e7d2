"""Convolution (cross-correlation) over cells, in one to three feature dimensions, with its three adjoints.

Every cell knows by arithmetic which windows hold it and under which tap, so the kernel is joined by equality on (channel, taps); the
kernel is the small side.  One shuffle remains, that of the sums.  The layouts of worker grids (features, channels, both) give the
same cells and differ only in who owns them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.index import div
from cellweave.operators.move import place
from cellweave.operators.slide import expand, has_empty_windows, out_shape
from cellweave.plans.geometry import Window
from cellweave.plans.partition import CartesianPartition
from cellweave.schema import fill, index_columns, known_small


def layout(p_x: CartesianPartition, p_y: CartesianPartition | None = None, p_w: CartesianPartition | None = None) -> str:
    """feature, channel or general, by the grids given; ValueError for grids that do not fit together."""
    if (p_y is None) != (p_w is None):
        raise ValueError("give both P_y and P_w or neither")
    if p_y is None:
        if any(n != 1 for n in p_x.shape[:2]):
            raise ValueError("batch and channels are not split in the feature layout")
        return "feature"
    if p_x.shape[1] != p_w.shape[1] or p_y.shape[1] != p_w.shape[0]:
        raise ValueError("channels of P_x and P_y differ from those of P_w")
    if p_x.shape[2:] != p_w.shape[2:] or p_y.shape[2:] != p_w.shape[2:]:
        raise ValueError("feature dimensions of the grids differ")
    return "channel" if all(n == 1 for n in (*p_x.shape[2:], *p_y.shape[2:], *p_w.shape[2:])) else "general"


def _global_channels(kernel: DataFrame, in_channels: int, out_channels: int, groups: int) -> DataFrame:
    """Kernel rows (co, ci, t2.., w) with ci counted over all input channels; in a grouped convolution ci is counted within the group."""
    if groups == 1:
        return kernel
    if in_channels % groups or out_channels % groups:
        raise ValueError("channels are a multiple of groups")
    return kernel.withColumn("ci", div(F.col("co"), out_channels // groups) * (in_channels // groups) + F.col("ci"))


def _taps(wins: Sequence[Window]) -> list[str]:
    return [f"t{d}" for d in range(2, len(wins))]


def _cells(wins: Sequence[Window], out_channels: int) -> int:
    return out_channels * wins[1].n * math.prod(w.kernel for w in wins[2:])


def conv(x: DataFrame, kernel: DataFrame, bias: DataFrame | None, wins: Sequence[Window], out_channels: int, groups: int = 1, padding_mode: str = "zeros", p_y: CartesianPartition | None = None) -> DataFrame:
    """x: (i0, i1, i2.., v); kernel: (co, ci, t2.., w); bias: (co, b); wins: one window per dimension of x.  With p_y, cells carry their owner."""
    k = known_small(_global_channels(kernel, wins[1].n, out_channels, groups), _cells(wins, out_channels))
    outs, taps = [f"o{d}" for d in range(2, len(wins))], _taps(wins)
    both = expand(x, wins, padding_mode).withColumnRenamed("i1", "ci").join(k, ["ci", *taps])
    y = both.groupBy("i0", F.col("co").alias("i1"), *(F.col(o).alias(f"i{o[1:]}") for o in outs)).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    shape = out_shape(wins, out_channels)
    if has_empty_windows(wins) and padding_mode == "zeros":
        y = fill(y, shape, index_columns(len(shape)))
    if bias is not None:
        y = y.join(known_small(bias, out_channels), y["i1"] == bias["co"], "left").withColumn("v", F.col("v") + F.coalesce("b", F.lit(0.0))).select(*index_columns(len(shape)), "v")
    return place(y, shape, p_y) if p_y is not None else y


def conv_dx(dy: DataFrame, kernel: DataFrame, wins: Sequence[Window], out_channels: int, groups: int = 1) -> DataFrame:
    """Gradient of the input (zero padding); cells that no window reads have gradient 0 and are emitted."""
    k = known_small(_global_channels(kernel, wins[1].n, out_channels, groups), _cells(wins, out_channels))
    both = dy.withColumnRenamed("i1", "co").join(k, "co")
    keep, back = F.lit(True), {}
    for d in range(2, len(wins)):
        w = wins[d]
        i = F.col(f"i{d}") * w.stride + F.col(f"t{d}") * w.dilation - w.padding
        keep = keep & (i >= 0) & (i < w.n)
        back[f"i{d}"] = i
    names = index_columns(len(wins))
    dx = both.where(keep).withColumns(back).groupBy("i0", F.col("ci").alias("i1"), *names[2:]).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return fill(dx, tuple(w.n for w in wins), names)


def conv_dw(x: DataFrame, dy: DataFrame, wins: Sequence[Window], out_channels: int, groups: int = 1) -> DataFrame:
    """(co, ci, t2.., w): gradient of the kernel, every tap present."""
    outs, taps = [f"o{d}" for d in range(2, len(wins))], _taps(wins)
    right = dy.select("i0", F.col("i1").alias("co"), *(F.col(f"i{o[1:]}").alias(o) for o in outs), F.col("v").alias("_dy"))
    both = expand(x, wins).withColumnRenamed("i1", "ci").join(right, ["i0", *outs])
    per_in, per_out = wins[1].n // groups, out_channels // groups
    if groups > 1:
        both = both.where(div(F.col("ci"), per_in) == div(F.col("co"), per_out)).withColumn("ci", F.pmod(F.col("ci"), F.lit(per_in)))
    dw = both.groupBy("co", "ci", *taps).agg(F.sum(F.col("v") * F.col("_dy")).alias("w"))
    return fill(dw, (out_channels, per_in, *(w.kernel for w in wins[2:])), ["co", "ci", *taps], "w")


def conv_db(dy: DataFrame) -> DataFrame:
    return dy.groupBy(F.col("i1").alias("co")).agg(F.sum("v").alias("b"))
