"""Nearest and (bi-, tri-)linear interpolation as a join with small index tables, and its adjoint."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.schema import fill, known_small


def out_extents(shape: Sequence[int], size: Sequence[int] | None, scale_factor: float | Sequence[float] | None) -> tuple[int, ...]:
    """Output shape from the full shape, or from scale factors of the feature dimensions; exactly one of both."""
    if (size is None) == (scale_factor is None):
        raise ValueError("give either size or scale_factor")
    if size is not None:
        return tuple(size)
    scales = [float(scale_factor)] * (len(shape) - 2) if isinstance(scale_factor, int | float) else list(scale_factor)
    return (*shape[:2], *(math.floor(n * s) for n, s in zip(shape[2:], scales, strict=True)))


def table(spark: SparkSession, n_in: int, n_out: int, mode: str, align_corners: bool = False, scale: float | None = None, window: tuple[int, int] | None = None, out_window: tuple[int, int] | None = None) -> DataFrame:
    """(j, i, w): output index, input index and weight along one dimension.

    With windows, input indices outside [a, b) are replaced by the nearest one inside, and j runs over the output window.
    """
    a, b = window or (0, n_in)
    first, stop = out_window or (0, n_out)
    j, last = F.col("id"), b - a - 1
    rows = spark.range(first, stop)
    if mode == "nearest":
        i = F.least(F.greatest(F.call_function("div", j * n_in, F.lit(n_out).cast("long")) - a, F.lit(0)), F.lit(last)) + a
        return rows.select(j.alias("j"), i.cast("long").alias("i"), F.lit(1.0).alias("w"))
    if mode != "linear":
        raise NotImplementedError(mode)
    if align_corners:
        src = j * ((n_in - 1) / (n_out - 1) if n_out > 1 else 0.0)
    else:
        src = (j + 0.5) * (1.0 / scale if scale else n_in / n_out) - 0.5
    src = F.greatest(src - a, F.lit(0.0))
    low = F.least(F.floor(src).cast("long"), F.lit(last).cast("long"))
    share = src - low
    share = F.when(F.abs(share) < 1e-4, 0.0).when(F.abs(share - 1) < 1e-4, 1.0).otherwise(share)
    high = F.least(low + 1, F.lit(last).cast("long"))
    pairs = F.array(F.struct((low + a).alias("i"), (1.0 - share).alias("w")), F.struct((high + a).alias("i"), share.alias("w")))
    out = rows.select(j.alias("j"), F.explode(pairs).alias("p")).select("j", "p.i", "p.w").where("w <> 0")
    return out.groupBy("j", "i").agg(F.sum("w").alias("w")) if last == 0 else out


def tables(spark: SparkSession, shape, out_shape, mode="linear", align_corners=False, scale_factor=None, window=None, out_window=None) -> list[DataFrame]:
    """One table for each feature dimension; window and out_window: (start, stop) pairs per feature dimension."""
    features = len(shape) - 2
    scales = list(scale_factor) if isinstance(scale_factor, list | tuple) else [scale_factor] * features
    return [table(spark, shape[d + 2], out_shape[d + 2], mode, align_corners, scales[d], window[d] if window else None, out_window[d] if out_window else None) for d in range(features)]


def interpolate(x: DataFrame, index: Sequence[DataFrame], rows: Sequence[int]) -> DataFrame:
    """y[b, c, j..] = sum over i.. of x[b, c, i..] times the product of weights.  rows: an upper bound of each table's size."""
    y = x
    for d, (t, n) in enumerate(zip(index, rows, strict=True), 2):
        t = t.select(F.col("i").alias(f"i{d}"), F.col("j").alias(f"j{d}"), F.col("w").alias(f"w{d}"))
        y = y.join(known_small(t, n), f"i{d}")
    weight = F.lit(1.0)
    for d in range(2, 2 + len(index)):
        weight = weight * F.col(f"w{d}")
    return y.groupBy("i0", "i1", *(F.col(f"j{d}").alias(f"i{d}") for d in range(2, 2 + len(index)))).agg(F.sum(F.col("v") * weight).alias("v"))


def interpolate_adjoint(dy: DataFrame, index: Sequence[DataFrame], rows: Sequence[int], shape: Sequence[int], names: Sequence[str]) -> DataFrame:
    """The transposed weights; input cells that no output reads have gradient 0."""
    turned = [t.select(F.col("j").alias("i"), F.col("i").alias("j"), "w") for t in index]
    return fill(interpolate(dy, turned, rows), tuple(shape), list(names))


def upsample(x: DataFrame, shape: Sequence[int], size=None, scale_factor=None, mode: str = "linear", align_corners: bool = False) -> DataFrame:
    out = out_extents(shape, size, scale_factor)
    if mode == "cubic":
        raise NotImplementedError("cubic")
    index = tables(x.sparkSession, shape, out, mode, align_corners, None if size is not None else scale_factor)
    return interpolate(x, index, [2 * n for n in out[2:]])


def upsample_adjoint(dy: DataFrame, shape: Sequence[int], size=None, scale_factor=None, mode: str = "linear", align_corners: bool = False) -> DataFrame:
    out = out_extents(shape, size, scale_factor)
    index = tables(dy.sparkSession, shape, out, mode, align_corners, None if size is not None else scale_factor)
    return interpolate_adjoint(dy, index, [2 * n for n in out[2:]], shape, [f"i{d}" for d in range(len(shape))])
