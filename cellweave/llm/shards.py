"""Shards with size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable Parquet shards in a folder of their own.  Shards are grouped into tiers by size (each tier
FANOUT times the one below).  Compaction takes the tiers that hold FANOUT shards or more, reads these shards as they are and
coalesces them, without a shuffle, into files of about the target size: shards of one tier are of similar size, so equal numbers
of them make files of similar size.  Shards at the target size are left alone.

A manifest names the parts that list the shards of a version, with rows and bytes.  A commit adds a part with its new shards and
rewrites only those parts that name a shard that goes; parts are joined where a version has over PARTS of them, smallest first.  A new version is
written beside and renamed into place only if that version is still free.  A writer that finds it taken reads the newer version and tries again with
the files that it has written; a compaction tries again if its shards are all still there, else it raises Conflict.  Readers see whole versions
only, and files that no manifest names (of a lost task or failed job) are never read.

A shard's folder has the number of the commit that it was written for, the kind of work and its tier, and its files the number of their
task, so its name in `ShardStore.shard_name()` is the same whenever the same arrivals come in the same order.

Columns and rows are kept as they are, nulls, empty tables and repeated rows included.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.runtime import read, remove, shared_dir

FANOUT = 4
SMALLEST = 1 << 20
TARGET_BYTES = 128 << 20
#: Parts of a manifest above which they are joined, and how often a commit is tried.
PARTS = 64
TRIES = 20


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int
    tier: int


def tier_of(size: int, smallest: int = SMALLEST, fanout: int = FANOUT) -> int:
    return max(0, math.floor(math.log(max(size, 1) / smallest, fanout)) + 1) if size >= smallest else 0


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, smallest: int = SMALLEST):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.fanout, self.smallest = target_bytes, fanout, smallest
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _context(self):
        return self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)

    def _list(self, name: str) -> list:
        fs = self._path("").getFileSystem(self._conf)
        return list(fs.listStatus(self._path(name))) if fs.exists(self._path(name)) else []

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        names = [s.getPath().getName() for s in self._list("manifests")]
        return max((int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n)), default=0)

    def _text(self, name: str) -> str:
        stream = self._path("").getFileSystem(self._conf).open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        out = self._path("").getFileSystem(self._conf).create(self._path(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def head(self, version: int | None = None) -> dict:
        """version, schema, and the parts of a version with the number of shards that each lists."""
        v = self.version() if version is None else version
        return json.loads(self._text(f"manifests/{v:08d}.json")) if v else {"version": 0, "schema": None, "parts": []}

    def _shards(self, part: str) -> list[Shard]:
        return [Shard(*x) for x in json.loads(self._text(f"manifests/{part}"))]

    def manifest(self, version: int | None = None) -> dict:
        """version, schema and all shards of a version."""
        got = self.head(version)
        return {"version": got["version"], "schema": got["schema"], "shards": [s for p, _ in got["parts"] for s in self._shards(p)]}

    def _part(self, shards: list[Shard]) -> list:
        name = f"part-{uuid.uuid4().hex}.json"
        self._put(f"manifests/{name}", json.dumps([[s.path, s.rows, s.bytes, s.tier] for s in shards]))
        return [name, len(shards)]

    def _publish(self, version: int, schema: str, parts: list) -> int:
        """Rename a manifest into place, if this version is still free."""
        draft = f"manifests/draft-{uuid.uuid4().hex}"
        self._put(draft, json.dumps({"version": version, "schema": schema, "parts": parts}))
        options = getattr(self._jvm.org.apache.hadoop.fs.Options, "Rename")
        none = self.spark.sparkContext._gateway.new_array(options, 1)
        none[0] = options.NONE
        try:
            self._context().rename(self._path(draft), self._path(f"manifests/{version:08d}.json"), none)
        except Exception as e:
            self._path("").getFileSystem(self._conf).delete(self._path(draft), False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    def commit(self, base: int, schema: str, new: list[Shard], gone: frozenset[str] = frozenset()) -> int:
        """Version base + 1, if it is still free: that of base without the shards in `gone` and with the new ones."""
        parts, left, missing = [], [], set(gone)
        for name, n in self.head(base)["parts"] if base else []:
            shards = self._shards(name) if gone else []
            if any(s.path in gone for s in shards):
                missing -= {s.path for s in shards}
                left += [s for s in shards if s.path not in gone]
            else:
                parts.append([name, n])
        if missing:
            raise Conflict(f"{len(missing)} shards are no longer in version {base}")
        if len(parts) > PARTS:
            parts.sort(key=lambda p: p[1])
            left += [s for name, _ in parts[: PARTS // 2] for s in self._shards(name)]
            parts = parts[PARTS // 2 :]
        return self._publish(base + 1, schema, [*parts, *([self._part(left + new)] if left or new else [])])

    def _retried(self, schema: str, new: list[Shard], gone: frozenset[str] = frozenset()) -> int:
        for _ in range(TRIES - 1):
            try:
                return self.commit(self.version(), schema, new, gone)
            except Conflict:
                if not gone <= {s.path for s in self.manifest()["shards"]}:
                    raise
        return self.commit(self.version(), schema, new, gone)

    def _write(self, df: DataFrame, label: str) -> list[Shard]:
        """Write df into a folder of its own and list its files; their rows are counted in tasks, from the files' footers."""
        folder = f"data/{label}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        sizes = {s.getPath().getName(): int(s.getLen()) for s in self._list(folder) if s.getPath().getName().endswith(".parquet")}
        if not sizes:
            return []
        back = self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}")
        rows = {r["name"]: r["n"] for r in back.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n")).collect()}
        return [Shard(f"{folder}/{name}", rows[name], size, tier_of(size, self.smallest, self.fanout)) for name, size in sorted(sizes.items()) if rows.get(name, 0)]

    def append(self, df: DataFrame) -> int:
        shards = self._write(df, f"{self.version() + 1:08d}-arrival")
        return self._retried(df.schema.json(), shards)

    def compact(self) -> int:
        """One round over all tiers that hold enough shards below the target; the same version if there is nothing to do."""
        base = self.manifest()
        small: dict[int, list[Shard]] = {}
        for s in base["shards"]:
            if s.bytes < self.target // 2:
                small.setdefault(s.tier, []).append(s)
        made, gone = [], set()
        for tier, shards in sorted(small.items()):
            if len(shards) < self.fanout:
                continue
            files = max(1, round(sum(s.bytes for s in shards) / self.target))
            if files >= len(shards):
                continue
            made += self._write(self._frame(base["schema"], shards).coalesce(files), f"{base['version'] + 1:08d}-tier{tier}")
            gone |= {s.path for s in shards}
        if not gone:
            return base["version"]
        return self._retried(base["schema"], made, frozenset(gone))

    @staticmethod
    def shard_name(file_path: Column) -> Column:
        """Commit, kind, tier and task of a shard, from the path of its file."""
        return F.regexp_replace(file_path, r"^.*/(\d{8}-[a-z0-9]+)-[0-9a-f]+/part-(\d+)-.*$", "$1-$2")

    def _frame(self, schema: str, shards: list[Shard]) -> DataFrame:
        from pyspark.sql.types import StructType

        if not shards:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(schema)))
        # All paths in one call to the JVM, however many they are.
        paths = self._jvm.java.util.regex.Pattern.compile("\n").split("\n".join(f"{self.root}/{s.path}" for s in shards))
        session = self.spark._jsparkSession
        return DataFrame(session.read().schema(session.parseDataType(schema)).parquet(paths), self.spark)

    def read(self, version: int | None = None) -> DataFrame:
        got = self.manifest(version)
        if got["schema"] is None:
            raise ValueError("nothing has been committed")
        return self._frame(got["schema"], got["shards"])

    def vacuum(self) -> None:
        """Delete the data files that the newest version does not name; older versions can no longer be read."""
        live = {s.path for s in self.manifest()["shards"]}
        for folder in self._list("data"):
            name = f"data/{folder.getPath().getName()}"
            files = [f"{name}/{s.getPath().getName()}" for s in self._list(name)]
            if not any(f in live for f in files):
                remove(self.spark, f"{self.root}/{name}")


def query(spark, sf_dir: str, arrivals: int = 4) -> DataFrame:
    """Documents arrive in four parts by id, are compacted, and are read back from the last version: a row per document with its shard."""
    store = ShardStore(spark, shared_dir(spark, "shards"))
    docs = read(spark, sf_dir, "documents")
    nth = F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))
    for k in range(arrivals):
        store.append(docs.where(nth == k))
    store.compact()
    store.vacuum()
    back = store.read()
    return back.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("text_bytes"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        "lang",
        "source",
        "n_chars",
        F.lit(store.version()).cast("long").alias("manifest_version"),
        store.shard_name(F.col("_metadata.file_path")).alias("shard"),
        F.col("_metadata.file_size").alias("shard_bytes"),
    )
