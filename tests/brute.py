"""NumPy by definition: loops over output cells."""

from itertools import product

import numpy as np


def cells(spark, a):
    rows = [(*map(int, i), float(a[i])) for i in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, ", ".join([*(f"i{d} long" for d in range(a.ndim)), "v double"])) if rows else None


def dense(df, shape, names=None, value="v"):
    pdf = df.toPandas()
    names = names or [f"i{d}" for d in range(len(shape))]
    out = np.full(shape, np.nan)
    assert len(pdf) == np.prod(shape), (len(pdf), shape)
    out[tuple(pdf[n].to_numpy() for n in names)] = pdf[value].to_numpy()
    assert not np.isnan(out).any()
    return out


def taps(w):
    """(o, t, i) of every tap that hits the extent."""
    return [(o, t, o * w.stride + t * w.dilation - w.padding) for o in range(w.out) for t in range(w.kernel) if 0 <= o * w.stride + t * w.dilation - w.padding < w.n]


def conv(x, k, wins, groups=1):
    co_all, cin = k.shape[0], k.shape[1]
    y = np.zeros((x.shape[0], co_all, *(w.out for w in wins[2:])))
    for hit in product(*(taps(w) for w in wins[2:])):
        o, t, i = (tuple(h[j] for h in hit) for j in range(3))
        for co in range(co_all):
            g = co // (co_all // groups)
            y[(slice(None), co, *o)] += x[(slice(None), slice(g * cin, (g + 1) * cin), *i)] @ k[(co, slice(None), *t)]
    return y


def conv_dx(dy, k, wins, shape):
    dx = np.zeros(shape)
    for hit in product(*(taps(w) for w in wins[2:])):
        o, t, i = (tuple(h[j] for h in hit) for j in range(3))
        dx[(slice(None), slice(None), *i)] += dy[(slice(None), slice(None), *o)] @ k[(slice(None), slice(None), *t)]
    return dx


def conv_dw(x, dy, wins, shape):
    dw = np.zeros(shape)
    for hit in product(*(taps(w) for w in wins[2:])):
        o, t, i = (tuple(h[j] for h in hit) for j in range(3))
        dw[(slice(None), slice(None), *t)] += dy[(slice(None), slice(None), *o)].T @ x[(slice(None), slice(None), *i)]
    return dw


def pool(x, wins, kind):
    y = np.full((*x.shape[:2], *(w.out for w in wins[2:])), -np.inf if kind == "max" else 0.0)
    for hit in product(*(taps(w) for w in wins[2:])):
        o, i = (tuple(h[j] for h in hit) for j in (0, 2))
        y[(..., *o)] = np.maximum(y[(..., *o)], x[(..., *i)]) if kind == "max" else y[(..., *o)] + x[(..., *i)]
    return y if kind == "max" else y / np.prod([w.kernel for w in wins[2:]])


def max_pool_dx(x, dy, wins):
    dx = np.zeros(x.shape)
    outs = product(*(range(w.out) for w in wins[2:]))
    per = [{o: [i for oo, _, i in taps(w) if oo == o] for o in range(w.out)} for w in wins[2:]]
    for o in outs:
        where = list(product(*(per[d][o[d]] for d in range(len(o)))))
        for b in range(x.shape[0]):
            for c in range(x.shape[1]):
                best = max(where, key=lambda i: (x[(b, c, *i)], tuple(-j for j in i)))
                dx[(b, c, *best)] += dy[(b, c, *o)]
    return dx


def avg_pool_dx(dy, wins, shape):
    dx = np.zeros(shape)
    for hit in product(*(taps(w) for w in wins[2:])):
        o, i = (tuple(h[j] for h in hit) for j in (0, 2))
        dx[(..., *i)] += dy[(..., *o)]
    return dx / np.prod([w.kernel for w in wins[2:]])
