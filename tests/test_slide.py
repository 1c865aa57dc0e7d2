import brute
import numpy as np
import pytest

from cellweave.operators import conv as C
from cellweave.operators import pool as K
from cellweave.plans.geometry import windows

# (x, kernel, padding, stride, dilation) of the sliding-window cases
GEOMETRIES = {
    "plain": ([1, 2, 6, 6], 3, 1, 1, 1),
    "stride-2": ([1, 2, 7, 7], 5, 2, 2, 1),
    "odd-local-shape": ([2, 2, 5, 5], 3, 1, 2, 1),
    "kernel-needs-offset": ([1, 2, 6, 10], 5, 2, 4, 1),
    "non-ideal-padding": ([1, 2, 7, 8], 5, 1, 1, 1),
    "even-kernel": ([1, 2, 6, 6], 4, 1, 1, 1),
    "3d": ([1, 2, 5, 5, 6], 5, 2, (2, 2, 1), 1),
    "1d": ([1, 3, 15], 3, 1, 1, 1),
    "dilation-2": ([1, 2, 10, 10], 5, 1, 1, 2),
    "mixed-3d": ([1, 1, 9, 8, 9], (3, 2, 3), (1, 1, 1), (3, 1, 2), (2, 3, 1)),
    "far-padding": ([1, 1, 4], 2, 3, 1, 1),
}


@pytest.mark.parametrize("name", GEOMETRIES)
def test_conv_and_adjoints(spark, name):
    shape, k, p, s, d = GEOMETRIES[name]
    rng = np.random.default_rng(1)
    wins, co = windows(shape, k, s, p, d), 3
    x = rng.normal(size=shape)
    w = rng.normal(size=(co, shape[1], *(v.kernel for v in wins[2:])))
    b = rng.normal(size=co)
    xs = brute.cells(spark, x)
    names = ["co", "ci", *(f"t{j}" for j in range(2, len(shape)))]
    ws = brute.cells(spark, w).toDF(*names, "w")
    bs = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "co long, b double")
    want = brute.conv(x, w, wins) + b.reshape(1, -1, *[1] * (len(shape) - 2))
    assert np.allclose(brute.dense(C.conv(xs, ws, bs, wins, co), want.shape), want)
    dy = rng.normal(size=want.shape)
    dys = brute.cells(spark, dy)
    assert np.allclose(brute.dense(C.conv_dx(dys, ws, wins, co), shape), brute.conv_dx(dy, w, wins, shape))
    assert np.allclose(brute.dense(C.conv_dw(xs, dys, wins, co), w.shape, names, "w"), brute.conv_dw(x, dy, wins, w.shape))
    assert np.allclose(brute.dense(C.conv_db(dys), (co,), ["co"], "b"), dy.sum(axis=(0, *range(2, dy.ndim))))


@pytest.mark.parametrize("name", GEOMETRIES)
def test_pools_and_adjoints(spark, name):
    shape, k, p, s, d = GEOMETRIES[name]
    rng = np.random.default_rng(2)
    wins = windows(shape, k, s, p, d)
    x = rng.integers(0, 4, size=shape).astype(float)  # with ties
    xs = brute.cells(spark, x)
    want = brute.pool(x, wins, "max")
    assert np.array_equal(brute.dense(K.max_pool(xs, wins), want.shape), want)
    if name != "far-padding":
        dy = rng.normal(size=want.shape)
        assert np.allclose(brute.dense(K.max_pool_adjoint(xs, brute.cells(spark, dy), wins), shape), brute.max_pool_dx(x, dy, wins))
    if all(w.dilation == 1 for w in wins):
        want = brute.pool(x, wins, "avg")
        assert np.allclose(brute.dense(K.avg_pool(xs, wins), want.shape), want)
        dy = rng.normal(size=want.shape)
        assert np.allclose(brute.dense(K.avg_pool_adjoint(brute.cells(spark, dy), wins), shape), brute.avg_pool_dx(dy, wins, shape))
    else:
        with pytest.raises(ValueError):
            K.avg_pool(xs, wins)


def test_grouped_conv(spark):
    rng = np.random.default_rng(3)
    shape, wins = [2, 4, 7], windows([2, 4, 7], 3, 1, 1)
    x, w = rng.normal(size=shape), rng.normal(size=(6, 2, 3))
    ws = brute.cells(spark, w).toDF("co", "ci", "t2", "w")
    xs = brute.cells(spark, x)
    assert np.allclose(brute.dense(C.conv(xs, ws, None, wins, 6, groups=2), (2, 6, 7)), brute.conv(x, w, wins, 2))
    dy = brute.cells(spark, rng.normal(size=(2, 6, 7)))
    assert C.conv_dw(xs, dy, wins, 6, groups=2).count() == 6 * 2 * 3


@pytest.mark.parametrize("mode, pad", [("reflect", "reflect"), ("replicate", "edge"), ("circular", "wrap")])
def test_padding_modes(spark, mode, pad):
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=(1, 2, 6, 5)), rng.normal(size=(2, 2, 3, 3))
    wide = np.pad(x, ((0, 0), (0, 0), (2, 2), (2, 2)), mode=pad)
    want = brute.conv(wide, w, windows(wide.shape, 3))
    got = C.conv(brute.cells(spark, x), brute.cells(spark, w).toDF("co", "ci", "t2", "t3", "w"), None, windows(x.shape, 3, 1, 2), 2, padding_mode=mode)
    assert np.allclose(brute.dense(got, want.shape), want)


def test_frames_equal_expansion(spark):
    x = np.random.default_rng(5).normal(size=(2, 2, 20))
    wins = windows(x.shape, 4)
    want = brute.pool(x, wins, "max")
    assert np.array_equal(brute.dense(K.max_pool_1d_frames(brute.cells(spark, x), wins[2]), want.shape), want)


def test_wrong_lengths():
    with pytest.raises(ValueError):
        windows([1, 1, 5, 5], (3, 3, 3))
