"""Affine maps: y[b, o] = sum over i of x[b, i] w[o, i], plus bias[o]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.schema import known_small


def linear(x: DataFrame, w: DataFrame, bias: DataFrame | None, weight_cells: int) -> DataFrame:
    """x: (i0, i1, v), w: (o, i, w), bias: (o, b).  weight_cells, known on the driver, decides whether w is broadcast."""
    y = x.join(known_small(w, weight_cells), x["i1"] == w["i"]).groupBy("i0", F.col("o").alias("i1")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    if bias is None:
        return y
    return y.join(known_small(bias, weight_cells), y["i1"] == bias["o"], "left").select("i0", "i1", (F.col("v") + F.coalesce("b", F.lit(0.0))).alias("v"))


def linear_rows(rows: DataFrame, value: str, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """The same for vectors stored as arrays, one row per b: no cell table and no shuffle, as all of a row's products meet in the row."""
    out = []
    for o, w in enumerate(weights):
        lit = F.array(*(F.lit(float(v)) for v in w))
        dot = F.aggregate(F.zip_with(F.col(value), lit, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
        out.append(dot + (bias[o] if bias else 0.0))
    return F.array(*out)


def linear_dx(dy: DataFrame, w: DataFrame, weight_cells: int) -> DataFrame:
    return dy.join(known_small(w, weight_cells), dy["i1"] == w["o"]).groupBy("i0", F.col("i").alias("i1")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def linear_dw(x: DataFrame, dy: DataFrame) -> DataFrame:
    """(o, i, w): joined on the batch index, summed over it."""
    a, b = x.select("i0", F.col("i1").alias("i"), F.col("v").alias("_x")), dy.select("i0", F.col("i1").alias("o"), F.col("v").alias("_dy"))
    return a.join(b, "i0").groupBy("o", "i").agg(F.sum(F.col("_x") * F.col("_dy")).alias("w"))


def linear_db(dy: DataFrame) -> DataFrame:
    return dy.groupBy(F.col("i1").alias("o")).agg(F.sum("v").alias("b"))
