"""Tables to tensors and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions.index import start_column
from cellweave.plans.partition import CartesianPartition
from cellweave.schema import fill, index_columns

TYPES, DAYS, HOURS = 5, 30, 24
FIRST_DAY = "2024-01-01"


def from_arrays(table: DataFrame, key: str, value: str) -> DataFrame:
    """(i0, i1, v) from one row per vector; only these two columns are read."""
    return table.select(F.col(key).cast("long").alias("i0"), F.posexplode(value).alias("p", "e")).select("i0", F.col("p").cast("long").alias("i1"), F.col("e").cast("double").alias("v"))


def to_arrays(cells: DataFrame, key: str = "i0", position: str = "i1") -> DataFrame:
    """One row per vector again, in order of position."""
    return cells.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(position, "v"))), lambda s: s["v"]).alias("data"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_arrays(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def events_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: (i0 = 0, i1 = event type, i2 = day, i3 = hour, v = sum of cents), every cell present.

    An event of a further type, or of a day outside the grid, is an error; so is one without a type or a time.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    day = F.datediff(F.to_date("ts"), F.lit(FIRST_DAY).cast("date")).cast("long")
    binned = events.groupBy("event_type", day.alias("i2"), F.hour("ts").cast("long").alias("i3")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("n"))
    # One type more than the grid has is enough to see that there are too many.
    kinds = events.select("event_type").distinct().orderBy("event_type").limit(TYPES + 1)
    kinds = kinds.withColumn("c", F.row_number().over(Window.orderBy("event_type")) - 1)
    inside = F.col("c").isNotNull() & (F.col("c") < TYPES) & F.col("i2").between(0, DAYS - 1) & F.col("i3").between(0, HOURS - 1)
    held = F.when(inside, F.col("n")).otherwise(F.raise_error(F.lit("an event lies outside the grid of types and days")).cast("long"))
    cells = binned.join(F.broadcast(kinds), "event_type", "left")
    # Nulls become -1, so that no join condition takes such a row away before it is seen.
    cells = cells.select(*(F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long")).alias(i) for c, i in (("c", "i1"), ("i2", "i2"), ("i3", "i3"))), held.cast("double").alias("v"))
    # The full grid comes from a range, so it is spread over the cores from the start.
    full = fill(cells, (TYPES, DAYS, HOURS), ["i1", "i2", "i3"])
    return full.select(F.lit(0).cast("long").alias("i0"), "i1", "i2", "i3", "v")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S: (i0 = 0, i1 = 0, i2 = hour since the first day, v = sum of cents over all types)."""
    e = events_grid(spark, sf_dir)
    return e.groupBy("i0", F.lit(0).cast("long").alias("i1"), (F.col("i2") * HOURS + F.col("i3")).alias("i2")).agg(F.sum("v").alias("v"))


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E as one channel with three feature dimensions."""
    e = events_grid(spark, sf_dir)
    return e.select("i0", F.lit(0).cast("long").alias("i1"), F.col("i1").alias("i2"), F.col("i2").alias("i3"), F.col("i3").alias("i4"), "v")


def lineitem_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i0 = return flag as number, i1 = line status as number, quantity, price, discount, tax) of every line."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(F.ascii("l_returnflag").cast("long").alias("i0"), F.ascii("l_linestatus").cast("long").alias("i1"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def kernel(spark: SparkSession, out_channels: int, in_channels: int, sizes: tuple[int, ...]) -> DataFrame:
    """(co, ci, t2.., w): a closed form of eighths, so that products and sums are exact."""
    from cellweave.schema import grid

    names = ["co", "ci", *(f"t{d}" for d in range(2, 2 + len(sizes)))]
    flat = F.lit(0).cast("long")
    for name, n in zip(names[1:], (in_channels, *sizes), strict=True):
        flat = flat * n + F.col(name)
    return grid(spark, (out_channels, in_channels, *sizes), names).withColumn("w", eighths(flat * 7 + F.col("co") * 3))


def eighths(n: Column) -> Column:
    return (F.pmod(n, F.lit(11)) - 5) / 8.0


def write_tensor(cells: DataFrame, path: str) -> None:
    """Cells in order of their index within each file, so that ranges of the first index are skipped by file statistics."""
    names = [c for c in cells.columns if c.startswith("i")]
    cells.repartitionByRange(*names[:1]).sortWithinPartitions(*names).write.parquet(path)


def read_tensor(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def local(cells: DataFrame, shape: tuple[int, ...], p: CartesianPartition) -> DataFrame:
    """(rank, l0.., v) from placed cells: indices counted from the start of the owner's block."""
    from cellweave.functions.index import owner
    from cellweave.operators.move import place

    placed = place(cells, shape, p)
    moved = [(F.col(c) - start_column(n, q, owner(F.col(c), n, q))).cast("long").alias(f"l{d}") for d, (c, n, q) in enumerate(zip(index_columns(len(shape)), shape, p.shape, strict=True))]
    return placed.select("rank", *moved, "v")
