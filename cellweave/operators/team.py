"""What workers tell each other about themselves: coordinates, neighbours, shapes, small vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators.move import REDUCERS, _rank_of_place
from cellweave.plans.partition import CartesianPartition
from cellweave.schema import BROADCAST_ROWS, grid, index_columns, known_small


def worker_grid(spark: SparkSession, p: CartesianPartition) -> DataFrame:
    """(rank, k0.., left0, right0, ..): coordinates and neighbours of every worker; null beyond the edge."""
    names = [f"k{d}" for d in range(p.dim)]
    places = grid(spark, p.shape, names)
    flat, stride, strides = F.lit(0).cast("long"), 1, []
    for n in reversed(p.shape):
        strides.insert(0, stride)
        stride *= n
    for name, s in zip(names, strides, strict=True):
        flat = flat + F.col(name) * s
    columns = [_rank_of_place(flat, p).alias("rank"), *names]
    for d, (n, s) in enumerate(zip(p.shape, strides, strict=True)):
        columns += [F.when(F.col(names[d]) > 0, _rank_of_place(flat - s, p)).alias(f"left{d}"), F.when(F.col(names[d]) < n - 1, _rank_of_place(flat + s, p)).alias(f"right{d}")]
    return places.select(*columns)


def sub_grids(spark: SparkSession, p: CartesianPartition, remain: Sequence[bool]) -> DataFrame:
    """(line, rank, place): the lines or planes that keep the flagged dimensions, numbered by the dimensions that are dropped."""
    if len(remain) != p.dim:
        raise ValueError("one flag for each dimension")
    line, place = F.lit(0).cast("long"), F.lit(0).cast("long")
    for d, (keep, n) in enumerate(zip(remain, p.shape, strict=True)):
        if keep:
            place = place * n + F.col(f"k{d}")
        else:
            line = line * n + F.col(f"k{d}")
    return worker_grid(spark, p).select(line.alias("line"), "rank", place.alias("place"))


def block_shapes(placed: DataFrame, dim: int) -> DataFrame:
    """(rank, n0, n1, ..): the shape of what each worker holds, from the data, balanced or not."""
    return placed.groupBy("rank").agg(*((F.max(c) - F.min(c) + 1).alias(f"n{d}") for d, c in enumerate(index_columns(dim))))


def all_gather(vectors: DataFrame, values: int | None = None) -> DataFrame:
    """(rank, gathered): every worker gets all workers' vectors (rank, data), in order of rank.

    One row holds all vectors, as each worker is to have them all.  It is broadcast if the number of all their values is given and small;
    otherwise the planner decides.
    """
    table = vectors.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "data"))), lambda s: s["data"]).alias("gathered"))
    return vectors.select("rank", F.lit(1).alias("_k")).join(known_small(table.withColumn("_k", F.lit(1)), BROADCAST_ROWS + 1 if values is None else values), "_k").select("rank", "gathered")


def all_reduce_vectors(vectors: DataFrame, op: str = "sum") -> DataFrame:
    """(position, v): vectors of all workers combined by position."""
    if op not in REDUCERS:
        raise ValueError(f"no reduction {op}")
    return vectors.select(F.posexplode("data").alias("position", "e")).groupBy(F.col("position").cast("long").alias("position")).agg(REDUCERS[op]("e").alias("v"))


def broadcast_vector(vectors: DataFrame, root: int, team: Sequence[int]) -> DataFrame:
    """(rank, data): the root's vector for every worker of the team; ValueError if the root is not in it."""
    if root not in team:
        raise ValueError("the root is a member of the team")
    ranks = F.explode(F.array(*(F.lit(r).cast("long") for r in team)))
    return vectors.where(F.col("rank") == root).select(ranks.alias("rank"), "data")


def print_sequential(values: DataFrame) -> None:
    """Print each worker's value (rank, value), one worker after another in order of rank."""
    for r in values.orderBy("rank").toLocalIterator():
        print(f"rank = {r['rank']}, value = {r['value']}", flush=True)
