"""Bounded samples of labelled rows, by which classifiers are fitted.

Rows are drawn by hashes of their id and text, so the sample depends neither on the partitioning nor on the order of the input, and
copies of a row count once.  Null labels and texts do not take part, nor does the held-out fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.runtime import crc_mod, lean, ship_package, slices, stable_sample, texts_of

#: Labelled rows that a classifier is fitted on, and the bytes of text up to which a row may be among them where the text itself
#: must come to the driver.
SAMPLE_ROWS = 6000
SAMPLE_TEXT_BYTES = 20_000


def _usable(docs: DataFrame, text_bytes: int | None) -> DataFrame:
    out = docs.withColumn("text", F.col("text").cast("string")).where(F.col("text").isNotNull())
    return out if text_bytes is None else out.where(F.octet_length("text") <= text_bytes)


def _once(rows: DataFrame, *by: str) -> DataFrame:
    """One row of each (by, hash of id and text); copies meet in the tasks that read them."""
    hashed = rows.withColumn("hash", F.xxhash64("doc_id", "text"))
    first = hashed.groupBy(*by, "hash").agg(F.min(F.struct("doc_id", "text", "label")).alias("_r"))
    return first.select("_r.*", "hash", *(c for c in by if c not in ("doc_id", "text", "label")))


def _picked(docs: DataFrame, labels: DataFrame, label: str, rows: int, text_bytes: int | None) -> DataFrame:
    """(doc_id, text, label) of all rows whose id is among the `rows` labelled ones with the smallest hashes."""
    picked = labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & (crc_mod("_id", 4) != 2))
    picked = stable_sample(picked.groupBy("_id").agg(F.min("_label").alias("_label")), "_id", rows)
    found = _usable(docs.select("doc_id", "text"), text_bytes).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    return found.select("doc_id", "text", F.col("_label").alias("label"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_TEXT_BYTES) -> DataFrame:
    """(doc_id, text, label) of at most `rows` documents with a labelled id; of an id's labels the least counts, null ids do not take part.

    The ids with the smallest hashes are taken; where ids repeat with different texts, the first `rows` rows in order of hashes.
    """
    found = _once(_picked(docs, labels, label, rows, text_bytes), "doc_id")
    return found.orderBy(F.xxhash64("doc_id"), "doc_id", "hash").limit(rows).select("doc_id", "text", "label")


def measured(docs: DataFrame, labels: DataFrame, label: str, measure: Callable[[list[str]], dict[str, np.ndarray]], names: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """(label, names), all double: what `measure` makes of the texts of the rows that labelled() would draw if no text were too long.

    Texts are measured by the task that reads them, and only numbers are sorted and sent on: `rows` long texts are more than one task holds.
    """
    ship_package(docs.sparkSession)
    found = _picked(docs, labels, label, rows, None).select("doc_id", "text", F.col("label").cast("double"), F.xxhash64("doc_id", "text").alias("hash"))
    columns = ["doc_id", "hash", "label", *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = measure(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(2), *(pa.array(np.asarray(x[k], float)) for k in names)], names=columns)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, hash long, " + ", ".join(f"`{k}` double" for k in ("label", *names))
    once = found.mapInArrow(lean(run), schema).groupBy("doc_id", "hash").agg(F.min(F.struct("label", *names)).alias("_r"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id", "hash").limit(rows).select("_r.*")


def by_label(docs: DataFrame, label: str, rows: int, text_bytes: int | None = SAMPLE_TEXT_BYTES) -> DataFrame:
    """(doc_id, text, label) of at most `rows` documents, an equal share for each label; a rare label gives all it has.

    More labels than rows: the most frequent ones, ties in their order.
    """
    usable = _usable(docs.select("doc_id", "text", F.col(label).alias("label")), text_bytes).where(F.col("label").isNotNull() & (crc_mod("doc_id", 4) != 2))
    counts = usable.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(rows).collect()
    # Labels with fewer rows than an equal share leave theirs to the others.
    left, quota = rows, {}
    for k, r in enumerate(sorted(counts, key=lambda r: r["n"])):
        quota[r["label"]] = min(r["n"], left // (len(counts) - k))
        left -= quota[r["label"]]
    kind = docs.schema[label].dataType.simpleString()
    # A little more than the share passes by its hash alone, so that no task has to rank a whole label.
    shares = docs.sparkSession.createDataFrame([(r["label"], quota[r["label"]], min(1.0, (1.2 * quota[r["label"]] + 60) / r["n"])) for r in counts], f"label {kind}, quota long, share double")
    hashed = usable.withColumn("hash", F.xxhash64("doc_id", "text")).join(F.broadcast(shares), "label").where(F.pmod("hash", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    ranked = _once(hashed.select("doc_id", "text", "label", "quota"), "label", "quota")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.pmod("hash", F.lit(1 << 30)), "hash", "doc_id")))
    return ranked.where("rank <= quota").select("doc_id", "text", "label")
