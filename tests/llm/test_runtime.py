from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from cellweave.llm import runtime


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=context), "x")


def test_lean_tasks_give_the_same_rows():
    batches = [pa.RecordBatch.from_arrays([pa.array([k])], names=["a"]) for k in range(3)]
    assert list(runtime.lean(lambda b: (x for x in b))(iter(batches))) == batches


def test_slices_hold_a_budget_or_one_row():
    texts = ["a" * n for n in (10, 5, 100, 1, 1, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "t"])
    got = [s.column(0).to_pylist() for s in runtime.slices([batch], 1, 16)]
    assert sum(got, []) == list(range(7)) and got[0] == [0, 1] and [2] in got


@pytest.mark.parametrize("kind", ["<i8", "<u4", "<i4", "<f4"])
def test_packed_arrays_come_back(kind):
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 30, n).astype(kind) for n in (0, 1, 5, 1000, 0)]
    assert (runtime.joined([runtime.packed(x) for x in parts], kind) == np.concatenate(parts)).all()
    assert runtime.joined([], kind).dtype == kind and not len(runtime.joined([b""], kind))
    if kind != "<f4":
        parts = [np.sort(x) for x in parts]
        got = runtime.joined([runtime.packed(x, rising=True) for x in parts], kind, rising=True)
        assert got.dtype == kind and (got == np.concatenate(parts)).all()
