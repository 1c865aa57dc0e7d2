"""Versions of a shard store: parts, writers that meet, names that come again."""

import pytest
from pyspark.sql import functions as F

from cellweave.llm import shards
from cellweave.llm.runtime import shared_dir


class Late(shards.ShardStore):
    """A writer that reads the version before another one commits."""

    stale = 0

    def version(self):
        if self.stale:
            self.stale -= 1
            return super().version() - 1
        return super().version()


def test_a_late_writer_tries_again(spark, odd):
    root = shared_dir(spark, "shards")
    first, late = shards.ShardStore(spark, root), Late(spark, root)
    first.append(odd)
    first.append(odd)
    late.stale = 3
    assert late.append(odd) == 3 and first.read().count() == 3 * odd.count()
    assert first.read(2).count() == 2 * odd.count()


def test_compaction_beside_an_append_and_beside_another_compaction(spark, odd):
    root = shared_dir(spark, "shards")
    store, n = shards.ShardStore(spark, root), odd.count()
    for _ in range(4):
        store.append(odd.coalesce(1))

    class Overtaken(shards.ShardStore):
        def _write(self, df, label):
            out = super()._write(df, label)
            work.pop()()
            return out

    work = [lambda: store.append(odd.coalesce(1))]
    assert Overtaken(spark, root).compact() == 6 and store.read().count() == 5 * n and len(store.manifest()["shards"]) == 2
    for _ in range(3):
        store.append(odd.coalesce(1))
    work = [store.compact]
    with pytest.raises(shards.Conflict):
        Overtaken(spark, root).compact()
    assert store.read().count() == 8 * n


def test_parts_are_joined_and_only_touched_ones_rewritten(spark, odd, monkeypatch):
    monkeypatch.setattr(shards, "PARTS", 4)
    store, n = shards.ShardStore(spark, shared_dir(spark, "shards")), odd.count()
    for k in range(9):
        store.append(odd.coalesce(1))
        assert len(store.head()["parts"]) <= 5 and len(store.manifest()["shards"]) == k + 1
    assert sum(s.rows for s in store.manifest()["shards"]) == 9 * n and store.read(4).count() == 4 * n
    before = {p for p, _ in store.head()["parts"]}
    store.append(odd.coalesce(1))
    assert len(before & {p for p, _ in store.head()["parts"]}) >= 1


def test_names_come_again(spark):
    names = []
    for _ in range(2):
        store = shards.ShardStore(spark, shared_dir(spark, "shards"), target_bytes=1 << 20)
        for k in range(5):
            store.append(spark.range(100 * k, 100 * k + 100, 1, 2))
        store.compact()
        store.append(spark.range(7))
        names.append(sorted((r["id"], r["s"]) for r in store.read().select("id", store.shard_name(F.col("_metadata.file_path")).alias("s")).collect()))
    assert names[0] == names[1] and len({s for _, s in names[0]}) >= 2 and all("/" not in s for _, s in names[0])
