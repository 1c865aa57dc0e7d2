"""Running batch statistics over a stream: each micro-batch is one step of the fold, the state is a small table per channel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.norm import batch_stats


class RunningStats:
    """foreachBatch target.  State: (i1, running_mean, running_var, steps), one row per channel, kept as a table at `path`.

    Each version is written to its own folder and named by the batch id, so a batch that is delivered again is folded once.  A new object
    on the same path goes on from the newest version that was written whole, so statistics survive a restart of the driver.  A path
    belongs to one stream with its checkpoint, whose batch ids it follows.
    """

    def __init__(self, path: str, momentum: float | None = 0.1):
        self.path, self.momentum, self.last, self.looked = path.rstrip("/"), momentum, None, False

    def _newest(self, spark) -> int | None:
        """The largest batch id whose folder has been written whole."""
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return None
        done = lambda s: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return max((int(s.getPath().getName()) for s in fs.listStatus(root) if s.getPath().getName().isdigit() and done(s)), default=None)

    def current(self, spark) -> DataFrame | None:
        if not self.looked:
            self.last, self.looked = self._newest(spark), True
        return None if self.last is None else spark.read.parquet(f"{self.path}/{self.last}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        old = self.current(batch.sparkSession)
        if self.last is not None and batch_id <= self.last:
            return
        new = batch_stats(batch)
        if old is None:
            both = new.withColumns({"running_mean": F.lit(0.0), "running_var": F.lit(1.0), "steps": F.lit(0).cast("long")})
        else:
            both = old.join(new, "i1", "full")
        seen = F.col("mean").isNotNull()
        steps = F.coalesce("steps", F.lit(0).cast("long"))
        share = F.lit(float(self.momentum)) if self.momentum else 1.0 / (steps + 1)
        mix = lambda old, now, first: F.when(seen, (1 - share) * F.coalesce(old, F.lit(first)) + share * F.col(now)).otherwise(F.col(old))
        both.select("i1", mix("running_mean", "mean", 0.0).alias("running_mean"), mix("running_var", "var", 1.0).alias("running_var"), (steps + seen.cast("long")).alias("steps")).write.mode("overwrite").parquet(f"{self.path}/{batch_id}")
        self.last = batch_id


def watch(stream: DataFrame, stats: RunningStats, checkpoint: str, then: Callable[[DataFrame], None] | None = None):
    """Start folding a stream of cells (i1, v, ..); `then` gets the statistics after each batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        stats(batch, batch_id)
        if then is not None:
            then(stats.current(batch.sparkSession))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
