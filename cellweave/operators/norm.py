"""Batch normalisation per channel (index i1): batch statistics, running statistics and gradients."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.schema import known_small


def check(dim: int, channels: int, num_features: int) -> None:
    if dim < 2:
        raise ValueError("the input has a batch and a channel dimension at least")
    if channels != num_features:
        raise ValueError(f"{channels} channels, {num_features} expected")


def batch_stats(x: DataFrame) -> DataFrame:
    """(i1, mean, var) per channel; the variance is that of the population."""
    return x.groupBy("i1").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"))


def normalise(x: DataFrame, stats: DataFrame, channels: int, eps: float = 1e-5, affine: DataFrame | None = None) -> DataFrame:
    """(v - mean) / sqrt(var + eps) * gamma + beta.  stats: of the batch in training, the running ones in evaluation; affine: (i1, gamma, beta)."""
    names = [c for c in x.columns if c != "v"]
    y = x.join(known_small(stats, channels), "i1").withColumn("v", (F.col("v") - F.col("mean")) / F.sqrt(F.col("var") + eps))
    if affine is not None:
        y = y.join(known_small(affine, channels), "i1").withColumn("v", F.col("v") * F.col("gamma") + F.col("beta"))
    return y.select(*names, "v")


def running_stats(batches: DataFrame, momentum: float | None = 0.1) -> DataFrame:
    """(i1, running_mean, running_var) from (step, i1, mean, var), folded in order of step from mean 0 and variance 1.

    Exponential average, new share = momentum; with momentum None or 0 the plain average of all batches so far.  The variance that is
    averaged is the population's.
    """
    if not momentum:
        return batches.groupBy("i1").agg(F.avg("mean").alias("running_mean"), F.avg("var").alias("running_var"))
    # Folded, a batch has the share m (1 - m)^k, k batches before the last; no channel's batches are gathered into one row.
    share, keep = float(momentum), 1.0 - float(momentum)
    nth = F.row_number().over(Window.partitionBy("i1").orderBy(F.desc("step"), F.desc("mean"), F.desc("var"))) - 1
    weighted = batches.withColumn("_w", F.lit(share) * F.pow(F.lit(keep), nth))
    return weighted.groupBy("i1").agg(F.sum(F.col("_w") * F.col("mean")).alias("running_mean"), (F.sum(F.col("_w") * F.col("var")) + F.pow(F.lit(keep), F.count("*"))).alias("running_var"))


def gradients(x: DataFrame, dy: DataFrame, channels: int, eps: float = 1e-5, affine: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(dx, (i1, dgamma, dbeta)) where batch statistics were used."""
    names = [c for c in x.columns if c != "v"]
    both = x.join(dy.withColumnRenamed("v", "_dy"), names).join(known_small(batch_stats(x), channels), "i1")
    both = both.withColumn("_hat", (F.col("v") - F.col("mean")) / F.sqrt(F.col("var") + eps))
    sums = both.groupBy("i1").agg(F.sum(F.col("_dy") * F.col("_hat")).alias("dgamma"), F.sum("_dy").alias("dbeta"), F.count("*").alias("_n"))
    out = both.join(known_small(sums, channels), "i1")
    scale = F.lit(1.0)
    if affine is not None:
        out, scale = out.join(known_small(affine, channels), "i1"), F.col("gamma")
    dx = scale / F.sqrt(F.col("var") + eps) * (F.col("_dy") - F.col("dbeta") / F.col("_n") - F.col("_hat") * F.col("dgamma") / F.col("_n"))
    return out.select(*names, dx.alias("v")), sums.select("i1", "dgamma", "dbeta")


def eval_gradient(dy: DataFrame, stats: DataFrame, channels: int, eps: float = 1e-5, affine: DataFrame | None = None) -> DataFrame:
    """dx where running statistics were used: they do not depend on the input."""
    names = [c for c in dy.columns if c != "v"]
    out, scale = dy.join(known_small(stats, channels), "i1"), F.lit(1.0)
    if affine is not None:
        out, scale = out.join(known_small(affine, channels), "i1"), F.col("gamma")
    return out.select(*names, (F.col("v") * scale / F.sqrt(F.col("var") + eps)).alias("v"))
