"""Tensors as tables of cells: one row per cell, index columns i0, i1, ... and a value column v."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _complex(part: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("re", part), T.StructField("im", part)])


#: Element types.  Unsigned bytes widen to SHORT and half floats to FLOAT, since Spark has neither; complex numbers are pairs.
DTYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "uint8": T.ShortType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "float16": T.FloatType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "complex64": _complex(T.FloatType()),
    "complex128": _complex(T.DoubleType()),
}

#: A table of at most so many rows, its size known on the driver, may be broadcast.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class TensorSchema:
    """Shape and element type of a tensor; two schemas are equal if all three fields are."""

    shape: tuple[int, ...]
    dtype: str = "float64"
    requires_grad: bool = False

    def __post_init__(self):
        object.__setattr__(self, "shape", tuple(int(n) for n in self.shape))
        if self.dtype not in DTYPES:
            raise ValueError(f"unknown element type {self.dtype}")

    @property
    def dim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f"i{d}", T.LongType()) for d in range(self.dim)] + [T.StructField("v", DTYPES[self.dtype])])


def index_columns(dim: int) -> list[str]:
    return [f"i{d}" for d in range(dim)]


def infer_schema(cells: DataFrame, dim: int, dtype: str = "float64") -> TensorSchema:
    """The global shape, by one aggregation: each extent is the largest index plus one."""
    row = cells.agg(*(F.coalesce(F.max(c) + 1, F.lit(0)).alias(c) for c in index_columns(dim))).first()
    return TensorSchema(tuple(row), dtype)


def zero_volume(spark: SparkSession, dim: int, dtype: str = "float64") -> DataFrame:
    """A tensor without cells."""
    return spark.createDataFrame([], TensorSchema((0,) * dim, dtype).struct)


def grid(spark: SparkSession, shape: tuple[int, ...], names: list[str] | None = None) -> DataFrame:
    """All index tuples of a shape in row-major order, without a join: one range, taken apart by div and mod."""
    names = names or index_columns(len(shape))
    cells, stride = spark.range(math.prod(shape)), math.prod(shape)
    columns = []
    for name, n in zip(names, shape, strict=True):
        stride //= max(n, 1)
        columns.append(F.expr(f"cast((id div {max(stride, 1)}) % {max(n, 1)} as bigint)").alias(name))
    return cells.select(*columns)


def fill(cells: DataFrame, shape: tuple[int, ...], names: list[str], value: str = "v", missing: float = 0.0) -> DataFrame:
    """Every cell of the shape, those that are absent with the given value."""
    return grid(cells.sparkSession, shape, names).join(cells.select(*names, value), names, "left").withColumn(value, F.coalesce(value, F.lit(missing)))


def known_small(table: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if the driver knows the table to be small; else the join is left to the planner."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table
