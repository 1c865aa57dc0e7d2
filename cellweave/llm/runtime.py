"""What every operator of this package needs from the session: shared scratch space, code shipping, batch slicing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words: space and tab to carriage return.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of text that a Python worker handles at once.  A single longer text is handled alone.
SLICE_BYTES = 4 << 20


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per session, so that they need no copy of the repository."""
    sc = spark.sparkContext
    if getattr(sc, "_cellweave_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / "cellweave_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(target))
    sc._cellweave_shipped = True


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under spark.checkpoint.dir.  Where that is unset on a local master (tests), a temporary folder becomes it; on a
    cluster that is an error, as its executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cellweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives a lost executor.  `scratch` is its folder."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whichever store it is in."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer used.  It does so when the driver's garbage is collected, which may
    otherwise happen after a whole job."""
    gc.collect()
    spark._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id in decimal, modulo n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that column `text` of each holds at most `budget` bytes, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + budget, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def lean(run: Callable) -> Callable:
    """run, a function over record batches, that gives freed memory back to the system when its task ends: workers are used again, and
    what one stage's arrays have left in their heap would come on top of the next stage's."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def packed(x: np.ndarray, rising: bool = False) -> bytes:
    """Values as planes of bytes, first bytes first, which compress well; rising ones as differences."""
    if rising:
        x = np.diff(x, prepend=x.dtype.type(0))
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def joined(rows: list, kind: str, rising: bool = False) -> np.ndarray:
    """What packed() has made of several arrays, one after another."""
    width = np.dtype(kind).itemsize
    parts = [np.ascontiguousarray(np.frombuffer(r, np.uint8).reshape(width, len(r) // width).T).view(kind).ravel() for r in rows if r]
    return np.concatenate([np.cumsum(x, dtype=kind) for x in parts] if rising else parts) if parts else np.zeros(0, kind)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def stable_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows whose hashed key is smallest: the same rows whatever the partitioning, never more than n."""
    return df.orderBy(F.xxhash64(key), key).limit(n)

