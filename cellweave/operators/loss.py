"""Losses of a tensor against a target: by element, summed, averaged over elements or over the batch; and their gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _log(x: Column) -> Column:
    """ln, not below -100."""
    return F.when(x > 0, F.greatest(F.log(F.when(x > 0, x).otherwise(1.0)), F.lit(-100.0))).otherwise(F.lit(-100.0))


def _kl(x: Column, y: Column) -> Column:
    return F.when(y > 0, y * (F.log(F.when(y > 0, y).otherwise(1.0)) - x)).otherwise(F.lit(0.0))


#: Each loss of one element, and its derivative by the input.
FORMS = {
    "l1": (lambda x, y: F.abs(x - y), lambda x, y: F.signum(x - y)),
    "mse": (lambda x, y: (x - y) * (x - y), lambda x, y: 2.0 * (x - y)),
    "poisson_nll": (lambda x, y: F.exp(x) - y * x, lambda x, y: F.exp(x) - y),
    "bce": (lambda x, y: -(y * _log(x) + (1.0 - y) * _log(1.0 - x)), lambda x, y: (x - y) / F.greatest(x * (1.0 - x), F.lit(1e-12))),
    "bce_logits": (lambda x, y: F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x))), lambda x, y: 1.0 / (1.0 + F.exp(-x)) - y),
    "kl": (_kl, lambda x, y: F.when(y > 0, -y).otherwise(F.lit(0.0))),
}
REDUCTIONS = ("none", "sum", "mean", "batchmean")


def _check(kind: str, reduction: str) -> None:
    if kind not in FORMS:
        raise ValueError(f"no loss {kind}")
    if reduction not in REDUCTIONS or (reduction == "batchmean" and kind != "kl"):
        raise ValueError(f"no reduction {reduction} of {kind}")


def paired(x: DataFrame, target: DataFrame) -> DataFrame:
    """x and target side by side: (i0.., v, y)."""
    names = [c for c in x.columns if c != "v"]
    return x.join(target.withColumnRenamed("v", "y"), names)


def loss(both: DataFrame, kind: str, reduction: str = "mean") -> DataFrame:
    """both: (i0.., v, y).  "none" gives cells, the others one row.  The batch is index i0."""
    _check(kind, reduction)
    term = FORMS[kind][0](F.col("v"), F.col("y"))
    if reduction == "none":
        return both.select(*(c for c in both.columns if c not in ("v", "y")), term.alias("v"))
    total = F.sum(term)
    if reduction == "mean":
        total = total / F.count("*")
    if reduction == "batchmean":
        total = total / (F.max("i0") + 1)
    return both.agg(total.alias("v"))


def gradient(both: DataFrame, kind: str, reduction: str = "mean", shape: tuple[int, ...] | None = None, upstream: float = 1.0) -> DataFrame:
    """d loss / d v by cell, times the upstream gradient; the shape gives the number of elements, so nothing is counted."""
    _check(kind, reduction)
    by = 1.0
    if reduction in ("mean", "batchmean"):
        if shape is None:
            raise ValueError("mean reductions need the shape")
        by = float(shape[0]) if reduction == "batchmean" else 1.0
        if reduction == "mean":
            for n in shape:
                by *= n
    return both.select(*(c for c in both.columns if c not in ("v", "y")), (FORMS[kind][1](F.col("v"), F.col("y")) * (upstream / by)).alias("v"))
