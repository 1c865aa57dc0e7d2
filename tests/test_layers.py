import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import interp as U
from cellweave.operators import linear as L
from cellweave.operators import loss as S
from cellweave.operators import norm as N
from cellweave.sources import tensors as T
from cellweave.streaming.running import RunningStats, watch


def test_linear(spark):
    rng = np.random.default_rng(0)
    x, w, b, dy = rng.normal(size=(3, 12)), rng.normal(size=(6, 12)), rng.normal(size=6), rng.normal(size=(3, 6))
    xs, dys = brute.cells(spark, x), brute.cells(spark, dy)
    ws = brute.cells(spark, w).toDF("o", "i", "w")
    bs = brute.cells(spark, b).toDF("o", "b")
    assert np.allclose(brute.dense(L.linear(xs, ws, bs, 72), (3, 6)), x @ w.T + b)
    assert np.allclose(brute.dense(L.linear_dx(dys, ws, 72), (3, 12)), dy @ w)
    assert np.allclose(brute.dense(L.linear_dw(xs, dys), (6, 12), ["o", "i"], "w"), dy.T @ x)
    assert np.allclose(brute.dense(L.linear_db(dys), (6,), ["o"], "b"), dy.sum(0))
    rows = T.to_arrays(xs)
    got = rows.select("i0", L.linear_rows(rows, "data", w.tolist(), b.tolist()).alias("y")).orderBy("i0").collect()
    assert np.allclose([r["y"] for r in got], x @ w.T + b)


@pytest.mark.parametrize("shape", [(4, 3, 10), (7, 13), (3, 5, 4, 3)])
def test_batchnorm(spark, shape):
    rng = np.random.default_rng(1)
    x, dy, c = rng.normal(size=shape), rng.normal(size=shape), shape[1]
    axes = (0, *range(2, len(shape)))
    wide = [1, c] + [1] * (len(shape) - 2)
    gamma, beta = 1 + np.arange(c) / 4, np.arange(c) - 1.0
    aff = spark.createDataFrame([(i, float(g), float(b)) for i, (g, b) in enumerate(zip(gamma, beta, strict=True))], "i1 long, gamma double, beta double")
    mean, var = x.mean(axes, keepdims=True), x.var(axes, keepdims=True)
    hat = (x - mean) / np.sqrt(var + 1e-5)
    xs, dys = brute.cells(spark, x), brute.cells(spark, dy)
    assert np.allclose(brute.dense(N.normalise(xs, N.batch_stats(xs), c, 1e-5, aff), shape), hat * gamma.reshape(wide) + beta.reshape(wide))
    dx, params = N.gradients(xs, dys, c, 1e-5, aff)
    want = gamma.reshape(wide) / np.sqrt(var + 1e-5) * (dy - dy.mean(axes, keepdims=True) - hat * (dy * hat).mean(axes, keepdims=True))
    assert np.allclose(brute.dense(dx, shape), want)
    assert np.allclose(brute.dense(params, (c,), ["i1"], "dgamma"), (dy * hat).sum(axes))
    with pytest.raises(ValueError):
        N.check(1, 3, 3)
    with pytest.raises(ValueError):
        N.check(2, 3, 4)


@pytest.mark.parametrize("momentum", [0.1, None, 0])
def test_running_stats(spark, momentum):
    rng = np.random.default_rng(2)
    m, v = rng.normal(size=(5, 2)), rng.uniform(1, 2, size=(5, 2))
    rows = [(s, c, float(m[s, c]), float(v[s, c])) for s in (3, 0, 4, 1, 2) for c in range(2)]
    got = N.running_stats(spark.createDataFrame(rows, "step long, i1 long, mean double, var double"), momentum).orderBy("i1").collect()
    mean, var = np.zeros(2), np.ones(2)
    for s in range(5):
        share = momentum or 1 / (s + 1)
        mean, var = (1 - share) * mean + share * m[s], (1 - share) * var + share * v[s]
    assert np.allclose([r["running_mean"] for r in got], mean) and np.allclose([r["running_var"] for r in got], var)


def test_running_stats_of_a_stream(spark, tmp_path):
    rng = np.random.default_rng(3)
    batches = [rng.normal(size=(6, 2)) for _ in range(3)]
    schema = "i0 long, i1 long, v double"
    for k, b in enumerate(batches):
        brute.cells(spark, b).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stats = RunningStats(str(tmp_path / "state"), 0.1)
    for k in range(3):
        stats(spark.read.schema(schema).parquet(str(tmp_path / "in" / f"b{k}")), k)
    stats(spark.read.schema(schema).parquet(str(tmp_path / "in" / "b0")), 1)  # delivered again
    mean = np.zeros(2)
    for b in batches:
        mean = 0.9 * mean + 0.1 * b.mean(0)
    assert np.allclose([r["running_mean"] for r in stats.current(spark).orderBy("i1").collect()], mean)
    live = RunningStats(str(tmp_path / "live"), None)
    q = watch(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), live, str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert live.current(spark).count() == 2


def reference_weights(n_in, n_out, mode, align=False, scale=None, window=None):
    a, b = window or (0, n_in)
    w = np.zeros((n_out, n_in))
    for j in range(n_out):
        if mode == "nearest":
            w[j, min(max(j * n_in // n_out - a, 0), b - a - 1) + a] += 1
            continue
        src = j * (n_in - 1) / max(n_out - 1, 1) if align else (j + 0.5) * (1 / scale if scale else n_in / n_out) - 0.5
        src = max(src - a, 0.0)
        lo = min(int(src), b - a - 1)
        f = src - lo
        f = 0.0 if abs(f) < 1e-4 else 1.0 if abs(f - 1) < 1e-4 else f
        w[j, lo + a] += 1 - f
        w[j, min(lo + 1, b - a - 1) + a] += f
    return w


@pytest.mark.parametrize("mode, align", [("nearest", False), ("linear", False), ("linear", True)])
@pytest.mark.parametrize("kw", [{"scale_factor": 1}, {"scale_factor": 2}, {"scale_factor": 1.5}, {"size": 1.5}])
def test_upsample(spark, mode, align, kw):
    rng = np.random.default_rng(4)
    shape = (2, 2, 7, 5)
    if "size" in kw:
        kw = {"size": (2, 2, 11, 8)}
    out = U.out_extents(shape, kw.get("size"), kw.get("scale_factor"))
    x = rng.normal(size=shape)
    a, b = (reference_weights(shape[d], out[d], mode, align, kw.get("scale_factor")) for d in (2, 3))
    want = np.einsum("bcij,yi,xj->bcyx", x, a, b)
    assert np.allclose(brute.dense(U.upsample(brute.cells(spark, x), shape, mode=mode, align_corners=align, **kw), out), want)
    dy = rng.normal(size=out)
    assert np.allclose(brute.dense(U.upsample_adjoint(brute.cells(spark, dy), shape, mode=mode, align_corners=align, **kw), shape), np.einsum("bcyx,yi,xj->bcij", dy, a, b))


@pytest.mark.parametrize("mode", ["nearest", "linear"])
def test_interpolation_windows(spark, mode):
    rng = np.random.default_rng(5)
    shape, out, win, owin = (1, 2, 13), (1, 2, 20), (4, 10), (6, 12)
    x = rng.normal(size=shape)
    w = reference_weights(13, 20, mode, window=win)[owin[0] : owin[1]]
    got = U.interpolate(brute.cells(spark, x), U.tables(spark, shape, out, mode, window=(win,), out_window=(owin,)), [40]).withColumn("i2", F.col("i2") - owin[0])
    assert np.allclose(brute.dense(got, (1, 2, 6)), np.einsum("bci,ji->bcj", x, w))


def test_interpolation_errors(spark):
    x = brute.cells(spark, np.ones((1, 1, 3)))
    for kw in ({}, {"size": (1, 1, 6), "scale_factor": 2}):
        with pytest.raises(ValueError):
            U.upsample(x, (1, 1, 3), **kw)
    with pytest.raises(NotImplementedError):
        U.upsample(x, (1, 1, 3), scale_factor=2, mode="cubic")
    assert np.allclose(brute.dense(U.upsample(x, (1, 1, 3), size=(1, 1, 1), align_corners=True), (1, 1, 1)), 1)


def numpy_losses(x, y):
    ln = lambda v: np.maximum(np.log(np.maximum(v, 1e-300)), -100)
    return {
        "l1": (abs(x - y), np.sign(x - y)),
        "mse": ((x - y) ** 2, 2 * (x - y)),
        "poisson_nll": (np.exp(x) - y * x, np.exp(x) - y),
        "bce": (-(y * ln(x) + (1 - y) * ln(1 - x)), (x - y) / np.maximum(x * (1 - x), 1e-12)),
        "bce_logits": (np.maximum(x, 0) - x * y + np.log1p(np.exp(-abs(x))), 1 / (1 + np.exp(-x)) - y),
        "kl": (np.where(y > 0, y * (np.log(np.where(y > 0, y, 1)) - x), 0), -y),
    }


@pytest.mark.parametrize("kind", list(S.FORMS))
def test_losses(spark, kind):
    rng = np.random.default_rng(6)
    x, y = rng.uniform(size=(4, 3, 5)), rng.uniform(size=(4, 3, 5))
    y[0, 0, 0], x[1, 1, 1] = 0.0, 0.0
    both = S.paired(brute.cells(spark, x), brute.cells(spark, y)).cache()
    want, slope = numpy_losses(x, y)[kind]
    assert np.allclose(brute.dense(S.loss(both, kind, "none"), x.shape), want)
    assert np.isclose(S.loss(both, kind, "sum").first()[0], want.sum()) and np.isclose(S.loss(both, kind, "mean").first()[0], want.mean())
    assert np.allclose(brute.dense(S.gradient(both, kind, "mean", x.shape), x.shape), slope / x.size)
    if kind == "kl":
        assert np.isclose(S.loss(both, kind, "batchmean").first()[0], want.sum() / 4)
    else:
        with pytest.raises(ValueError):
            S.loss(both, kind, "batchmean")
    with pytest.raises(ValueError):
        S.loss(both, kind, "median")


def test_tensors_to_files_and_back(spark, sf, tmp_path):
    x = T.embeddings(spark, sf)
    T.write_tensor(x, str(tmp_path / "x"))
    back = T.read_tensor(spark, str(tmp_path / "x"))
    assert back.dtypes == x.dtypes and back.exceptAll(x).count() == 0 and back.count() == x.count()
    rows = T.to_arrays(back).count()
    assert rows == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert T.events_grid(spark, sf).count() == 3600 and T.hourly(spark, sf).count() == 720 and T.volume(spark, sf).count() == 3600


@pytest.mark.parametrize("case", ["broadcast", "sum_reduce", "halo"])
def test_partition_invariance_and_adjoints(spark, case):
    """<F x, y> = <x, F* y> on random cells, for the movers whose adjoint changes the number of cells."""
    from cellweave.operators import move as M
    from cellweave.plans.geometry import windows
    from cellweave.plans.partition import grid_of

    rng = np.random.default_rng(7)
    if case == "halo":
        wins, p = windows((1, 1, 10, 7), 3), grid_of((1, 1, 3, 3))
        x = brute.cells(spark, rng.normal(size=(1, 1, 10, 7)))
        names, f = ["rank", "i0", "i1", "i2", "i3"], M.halo_exchange(x, wins, p).drop("ghost")
        back = lambda y: M.halo_exchange_adjoint(y, wins, p).drop("rank")
        x_names = names[1:]
    else:
        a, b = (grid_of((2, 2, 1)), grid_of((3, 2, 2))) if case == "broadcast" else (grid_of((2, 2, 3)), grid_of((2, 2, 1)))
        x = brute.cells(spark, rng.normal(size=(a.size, 7, 5))).toDF("rank", "l0", "l1", "v")
        kw = {"transpose_src": True} if case == "broadcast" else {}
        forward, adjoint = (M.broadcast, M.broadcast_adjoint) if case == "broadcast" else (M.sum_reduce, M.sum_reduce_adjoint)
        names = x_names = ["rank", "l0", "l1"]
        f, back = forward(x, a, b, **kw), lambda y: adjoint(y, a, b, **kw)
    f = f.cache()
    y = f.select(*names, (F.xxhash64(*names) / 1e18).alias("v")).cache()
    dot = lambda p, q, on: p.join(q.withColumnRenamed("v", "w"), on).agg(F.sum(F.col("v") * F.col("w"))).first()[0]
    assert np.isclose(dot(f, y, names), dot(x, back(y), x_names))


@pytest.mark.parametrize("odd", [("2024-01-05 03:00:00", "zz sixth"), ("2024-01-31 00:00:00", "click"), ("2023-12-31 23:00:00", "click"), ("2024-01-05 03:00:00", None), (None, "click")])
def test_events_outside_the_grid_are_an_error(spark, tmp_path, odd):
    rows = [(f"2024-01-{d:02d} 05:00:00", t, 1.5) for d in (1, 30) for t in ("buy", "cart", "click", "login", "view")]
    for name, more in (("good", []), ("bad", [(*odd, 2.0)])):
        (tmp_path / name).mkdir()
        table = spark.createDataFrame(rows + more, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
        table.write.parquet(str(tmp_path / name / "events.parquet"))
    assert T.events_grid(spark, str(tmp_path / "good")).agg(F.sum("v")).first()[0] == 1500
    with pytest.raises(Exception, match="outside the grid"):
        T.events_grid(spark, str(tmp_path / "bad")).agg(F.sum("v")).collect()


def test_running_stats_after_a_restart(spark, tmp_path):
    batches = [brute.cells(spark, np.random.default_rng(k).normal(k, 1 + k, (4, 3))) for k in range(4)]
    whole = RunningStats(str(tmp_path / "a"), 0.2)
    for k, b in enumerate(batches):
        whole(b, k)
    for k, b in enumerate(batches):
        RunningStats(str(tmp_path / "b"), 0.2)(b, k)
    rows = lambda s: sorted(tuple(round(v, 9) for v in r) for r in s.current(spark).collect())
    fresh = RunningStats(str(tmp_path / "b"), 0.2)
    assert rows(whole) == rows(fresh) and {r["steps"] for r in fresh.current(spark).collect()} == {4}
    fresh(batches[0], 2)
    assert rows(whole) == rows(fresh)
    (tmp_path / "b" / "9").mkdir()
    assert rows(RunningStats(str(tmp_path / "b"), 0.2)) == rows(whole)
