"""Every query by name, and for each the SQL that gives the same rows.

The SQL is written from the definitions (output cell by output cell), not from the way the operators compute.  Values are rounded to six
places on both sides, as sums of doubles differ in their last bits between engines.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.index import (
    assemble_slices, between, block_start, block_stop, filtered_range_index, index_filter, intersection, partition_intersection, range_index, slice_shape, slice_volume, start_index, stop_index, worker_layout,
)
from cellweave.operators import conv as C
from cellweave.operators import interp as U
from cellweave.operators import linear as L
from cellweave.operators import loss as S
from cellweave.operators import move as M
from cellweave.operators import norm as N
from cellweave.operators import pool as K
from cellweave.operators import team as W
from cellweave.plans.geometry import Window, halos, windows
from cellweave.plans.partition import CartesianPartition, Partition, grid_of
from cellweave.schema import DTYPES, grid, index_columns, zero_volume
from cellweave.sources import tensors as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WIDTH = 64  # of an embedding
E_SHAPE = (1, 5, T.DAYS, T.HOURS)
S_SHAPE = (1, 1, T.DAYS * T.HOURS)
V_SHAPE = (1, 1, 5, T.DAYS, T.HOURS)


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = query
    ORACLE_SQL[name] = sql


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns or ("v",)})


def vectors(spark: SparkSession, sf_dir: str) -> int:
    """How many vectors there are: from file footers alone."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


# Tensors in SQL ------------------------------------------------------------------------------------------------------------

X = "x AS (SELECT vec_id AS i0, CAST(d.d - 1 AS BIGINT) AS i1, CAST(embedding[d.d] AS DOUBLE) AS v FROM embeddings, range(1, 65) d(d))"
NX = "(SELECT count(*) FROM embeddings)"
E = """e AS (
  SELECT CAST(0 AS BIGINT) AS i0, c.c AS i1, d.d AS i2, h.h AS i3, CAST(coalesce(s.n, 0) AS DOUBLE) AS v
  FROM (SELECT CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS c, event_type FROM (SELECT DISTINCT event_type FROM events)) c
  CROSS JOIN range(30) d(d) CROSS JOIN range(24) h(h)
  LEFT JOIN (
    SELECT event_type, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d, hour(ts) AS h, sum(CAST(round(value * 100) AS BIGINT)) AS n
    FROM events GROUP BY ALL
  ) s ON s.event_type = c.event_type AND s.d = d.d AND s.h = h.h
)"""
HOUR = E + ", s AS (SELECT i0, CAST(0 AS BIGINT) AS i1, i2 * 24 + i3 AS i2, sum(v) AS v FROM e GROUP BY ALL)"
VOL = E + ", g AS (SELECT i0, CAST(0 AS BIGINT) AS i1, i1 AS i2, i2 AS i3, i3 AS i4, v FROM e)"


def own(i: str, n: str | int, p: int) -> str:
    """Owner of index i: how many blocks end at or before it."""
    if p == 1:
        return "CAST(0 AS BIGINT)"
    stops = [f"(({n}) // {p} * {k + 1} + least({k + 1}, ({n}) % {p}))" for k in range(p - 1)]
    return "CAST(" + " + ".join(f"(CASE WHEN {i} >= {s} THEN 1 ELSE 0 END)" for s in stops) + " AS BIGINT)"


def start(k: str, n: str | int, p: int) -> str:
    return f"(({n}) // {p} * ({k}) + least({k}, ({n}) % {p}))"


def rank(n0: str | int, p: tuple[int, int], first: int = 0) -> str:
    return f"({own('i0', n0, p[0])} * {p[1]} + {own('i1', WIDTH, p[1])} + {first})"


def values(rows: list[tuple], *names: str) -> str:
    """A literal table."""
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"CAST({v} AS BIGINT)" for v in r) + ")" for r in rows) + f") t({', '.join(names)}))"


# Blocks --------------------------------------------------------------------------------------------------------------------


def _bounds(spark, sf_dir):
    return M.block_bounds(spark, (vectors(spark, sf_dir), WIDTH), grid_of((7, 3)))


add("block_decompose", _bounds, f"""
SELECT a.k * 3 + b.k AS rank, {start("a.k", NX, 7)} AS start0, {start("a.k + 1", NX, 7)} - {start("a.k", NX, 7)} AS size0, {start("a.k + 1", NX, 7)} AS stop0,
       {start("b.k", WIDTH, 3)} AS start1, {start("b.k + 1", WIDTH, 3)} - {start("b.k", WIDTH, 3)} AS size1, {start("b.k + 1", WIDTH, 3)} AS stop1
FROM range(7) a(k), range(3) b(k)
""")


def _subtensor(spark, sf_dir):
    """Which cells the blocks hold, found from the data."""
    placed = M.place(T.embeddings(spark, sf_dir), (vectors(spark, sf_dir), WIDTH), grid_of((4, 3)))
    return placed.groupBy("rank").agg(F.min("i0").alias("start0"), (F.max("i0") + 1).alias("stop0"), F.min("i1").alias("start1"), (F.max("i1") + 1).alias("stop1"), F.count("*").alias("cells"))


add("subtensor_bounds", _subtensor, f"""
WITH {X} SELECT {rank(NX, (4, 3))} AS rank, min(i0) AS start0, max(i0) + 1 AS stop0, min(i1) AS start1, max(i1) + 1 AS stop1, count(*) AS cells
FROM x GROUP BY {rank(NX, (4, 3))}
""")


def _unbalanced(spark, sf_dir):
    """Blocks as wide as there are event types by day group: sizes 1, 2, 3, .. that are summed up along each dimension."""
    sizes = grid(spark, (4, 3), ["k0", "k1"]).select("k0", "k1", (F.col("k0") * 3 + 1).alias("size0"), (F.col("k1") * F.col("k1") + 2).alias("size1"))
    return M.unbalanced_bounds(sizes, 2)


add("unbalanced_bounds", _unbalanced, """
WITH s AS (SELECT a.k AS k0, b.k AS k1, a.k * 3 + 1 AS size0, b.k * b.k + 2 AS size1 FROM range(4) a(k), range(3) b(k))
SELECT k0, k1, size0, size1,
       CAST(sum(size0) OVER (PARTITION BY k1 ORDER BY k0) AS BIGINT) AS stop0, CAST(sum(size0) OVER (PARTITION BY k1 ORDER BY k0) - size0 AS BIGINT) AS start0,
       CAST(sum(size1) OVER (PARTITION BY k0 ORDER BY k1) AS BIGINT) AS stop1, CAST(sum(size1) OVER (PARTITION BY k0 ORDER BY k1) - size1 AS BIGINT) AS start1
FROM s
""")

add("partition_overlap", lambda spark, d: M.overlaps(spark, (vectors(spark, d), WIDTH), grid_of((4, 1)), grid_of((3, 4))), f"""
WITH {X} SELECT {rank(NX, (4, 1))} AS src, {rank(NX, (3, 4))} AS dst, count(*) AS cells FROM x GROUP BY ALL
""")

add("infer_shape", lambda spark, d: T.embeddings(spark, d).agg((F.max("i0") + 1).alias("n0"), (F.max("i1") + 1).alias("n1"), F.count("*").alias("cells")), f"""
WITH {X} SELECT max(i0) + 1 AS n0, max(i1) + 1 AS n1, count(*) AS cells FROM x
""")

# Repartition ---------------------------------------------------------------------------------------------------------------


def _by_worker(placed: DataFrame) -> DataFrame:
    return rounded(placed.groupBy("rank").agg(F.count("*").alias("cells"), F.sum("v").alias("v"), F.sum(F.col("i0") * WIDTH + F.col("i1")).alias("index_sum")))


def _repartition(p_x, p_y, first_y=0, back=False):
    def query(spark, sf_dir):
        x, shape = T.embeddings(spark, sf_dir), (vectors(spark, sf_dir), WIDTH)
        f = M.repartition_adjoint if back else M.repartition
        return _by_worker(f(x, shape, grid_of(p_x), grid_of(p_y, first_y)))

    return query


def _repartition_sql(p, first=0):
    r = rank(NX, p, first)
    return f"WITH {X} SELECT {r} AS rank, count(*) AS cells, round(sum(v), 6) + 0.0 AS v, CAST(sum(i0 * {WIDTH} + i1) AS BIGINT) AS index_sum FROM x GROUP BY {r}"


add("repartition", _repartition((4, 1), (2, 2)), _repartition_sql((2, 2)))
add("repartition_overlap", _repartition((4, 1), (3, 4)), _repartition_sql((3, 4)))
add("repartition_disjoint", _repartition((4, 1), (3, 4), 4), _repartition_sql((3, 4), 4))
add("repartition_scatter", _repartition((1, 1), (3, 4)), _repartition_sql((3, 4)))
add("repartition_gather", _repartition((3, 4), (1, 1)), _repartition_sql((1, 1)))
add("repartition_adjoint", _repartition((4, 1), (2, 2), back=True), _repartition_sql((4, 1)))


def _from_unbalanced(spark, sf_dir):
    """Cells lie in blocks of growing sizes; how many go from each to each balanced block."""
    n = vectors(spark, sf_dir)
    sizes = ((n // 10, n // 5, n - n // 10 - n // 5), (WIDTH,))
    held = M.place(T.embeddings(spark, sf_dir), (n, WIDTH), grid_of((3, 1)), sizes).withColumnRenamed("rank", "src")
    moved = M.repartition(held, (n, WIDTH), grid_of((3, 1)), grid_of((2, 2)), move=False)
    return rounded(moved.groupBy("src", "rank").agg(F.count("*").alias("cells"), F.sum("v").alias("v")))


add("repartition_unbalanced", _from_unbalanced, f"""
WITH {X}, h AS (SELECT *, CAST(CASE WHEN i0 < {NX} // 10 THEN 0 WHEN i0 < {NX} // 10 + {NX} // 5 THEN 1 ELSE 2 END AS BIGINT) AS src FROM x)
SELECT src, {rank(NX, (2, 2))} AS rank, count(*) AS cells, round(sum(v), 6) + 0.0 AS v FROM h GROUP BY ALL
""")

# Broadcast and reductions: blocks of X over a grid, with local indices -------------------------------------------------------


def _blocks(spark, sf_dir, p: CartesianPartition) -> DataFrame:
    """X over a 2-D grid; grids of more dimensions see it as one block row per leading place."""
    flat = grid_of((math.prod(p.shape[:-1]), p.shape[-1]), p.ranks[0])
    return T.local(T.embeddings(spark, sf_dir), (vectors(spark, sf_dir), WIDTH), flat)


def _blocks_sql(shape: tuple[int, ...]) -> str:
    a, b = math.prod(shape[:-1]), shape[-1]
    o0, o1 = own("i0", NX, a), own("i1", WIDTH, b)
    return f"{X}, b AS (SELECT {o0} * {b} + {o1} AS rank, CAST(i0 - {start(o0, NX, a)} AS BIGINT) AS l0, CAST(i1 - {start(o1, WIDTH, b)} AS BIGINT) AS l1, v FROM x)"


def _copy_sql(pairs, blocks, come_from, go_to):
    return f"WITH {_blocks_sql(blocks)} SELECT p.{go_to} AS rank, l0, l1, round(v, 6) + 0.0 AS v FROM b JOIN {values(pairs, 'src', 'dst')} p ON b.rank = p.{come_from}"


def _sum_sql(pairs, blocks, come_from, go_to):
    return f"WITH {_blocks_sql(blocks)} SELECT p.{go_to} AS rank, l0, l1, round(sum(v), 6) + 0.0 AS v FROM b JOIN {values(pairs, 'src', 'dst')} p ON b.rank = p.{come_from} GROUP BY ALL"


#: Grid places that each case connects, written out by hand.
_ROWS_TO_GRID = [(r, r * 3 + c) for r in range(2) for c in range(3)]  # [2,1] to [2,3]: along the row
_TURNED = [(c, r * 4 + c) for r in range(2) for c in range(4)]  # [4,1], reversed to [1,4], to [2,4]: by column


def _moved(f, p_x, p_y, held, **turn):
    return lambda spark, d: rounded(f(_blocks(spark, d, grid_of(held)), grid_of(p_x), grid_of(p_y), **turn))


add("broadcast", _moved(M.broadcast, (2, 1), (2, 3), (2, 1)), _copy_sql(_ROWS_TO_GRID, (2, 1), "src", "dst"))
add("broadcast_transpose", _moved(M.broadcast, (4, 1), (2, 4), (4, 1), transpose_src=True), _copy_sql(_TURNED, (4, 1), "src", "dst"))
add("broadcast_adjoint", _moved(M.broadcast_adjoint, (2, 1), (2, 4), (2, 4)), _sum_sql([(r, r * 4 + c) for r in range(2) for c in range(4)], (2, 4), "dst", "src"))
add("broadcast_adjoint_transpose", _moved(M.broadcast_adjoint, (4, 1), (2, 4), (2, 4), transpose_src=True), _sum_sql(_TURNED, (2, 4), "dst", "src"))
add("sum_reduce", _moved(M.sum_reduce, (2, 4), (2, 1), (2, 4)), _sum_sql([(r * 4 + c, r) for r in range(2) for c in range(4)], (2, 4), "src", "dst"))
add("sum_reduce_transpose", _moved(M.sum_reduce, (2, 4), (4, 1), (2, 4), transpose_dest=True), _sum_sql([(d, s) for s, d in _TURNED], (2, 4), "src", "dst"))
add("sum_reduce_adjoint", _moved(M.sum_reduce_adjoint, (2, 3), (2, 1), (2, 1)), _copy_sql([(b, a) for a, b in _ROWS_TO_GRID], (2, 1), "dst", "src"))


def _all_sum(axes):
    return lambda spark, d: rounded(M.all_reduce(_blocks(spark, d, grid_of((2, 4))), grid_of((2, 4)), axes_reduce=axes))


def _all_sum_sql(keep: str) -> str:
    return f"WITH {_blocks_sql((2, 4))} SELECT rank, l0, l1, round(sum(v) OVER (PARTITION BY {keep}l0, l1), 6) + 0.0 AS v FROM b"


add("all_sum_reduce_0d", _all_sum(()), f"WITH {_blocks_sql((2, 4))} SELECT rank, l0, l1, round(v, 6) + 0.0 AS v FROM b")
add("all_sum_reduce_1d", _all_sum((1,)), _all_sum_sql("rank // 4, "))
add("all_sum_reduce_rows", _all_sum((0,)), _all_sum_sql("rank % 4, "))
add("all_sum_reduce_2d", _all_sum((0, 1)), _all_sum_sql(""))


def _all_op(op):
    def query(spark, sf_dir):
        b = _blocks(spark, sf_dir, grid_of((2, 4)))
        # The product is taken of 1 + v / 8, which stays near 1.
        b = b.withColumn("v", 1 + F.col("v") / 8) if op == "prod" else b
        return rounded(M.all_reduce(b, grid_of((2, 4)), axes_keep=(0,), op=op))

    return query


for _op, _sql in (("prod", "product(1 + v / 8)"), ("min", "min(v)"), ("max", "max(v)")):
    add(f"all_reduce_{_op}", _all_op(_op), f"WITH {_blocks_sql((2, 4))}, r AS (SELECT rank // 4 AS k, l0, l1, {_sql} AS v FROM b GROUP BY ALL) SELECT b.rank, b.l0, b.l1, round(r.v, 6) + 0.0 AS v FROM b JOIN r ON r.k = b.rank // 4 AND r.l0 = b.l0 AND r.l1 = b.l1")

# Halos ---------------------------------------------------------------------------------------------------------------------

_S_WINS = windows(S_SHAPE, 5, 1, 2)
_E_WINS = windows(E_SHAPE, 3, 1, 1)


def _holder_sql(source: str, n: int, p: int, w: Window, i: str) -> str:
    """Which workers hold index i: those whose block, widened to what their windows read, contains it."""
    rows = []
    for k in range(p):
        left, right = w.reaches(p, k)
        rows.append((k, max(0, block_start(n, p, k) - max(0, left)), min(n, block_stop(n, p, k) + max(0, right))))
    return f"JOIN {values(rows, 'k', 'a', 'b')} {source} ON {i} >= {source}.a AND {i} < {source}.b"


add("halo_exchange_1d", lambda spark, d: rounded(M.halo_exchange(T.hourly(spark, d), _S_WINS, grid_of((1, 1, 4)))), f"""
WITH {HOUR} SELECT h.k AS rank, i0, i1, i2, round(v, 6) + 0.0 AS v, {own("i2", 720, 4)} <> h.k AS ghost
FROM s {_holder_sql("h", 720, 4, _S_WINS[2], "i2")}
""")
add("halo_exchange_2d", lambda spark, d: rounded(M.halo_exchange(T.events_grid(spark, d), _E_WINS, grid_of((1, 1, 3, 2)))), f"""
WITH {E} SELECT a.k * 2 + b.k AS rank, i0, i1, i2, i3, round(v, 6) + 0.0 AS v, ({own("i2", 30, 3)} <> a.k OR {own("i3", 24, 2)} <> b.k) AS ghost
FROM e {_holder_sql("a", 30, 3, _E_WINS[2], "i2")} {_holder_sql("b", 24, 2, _E_WINS[3], "i3")}
""")


def _halo_back(spark, sf_dir):
    p = grid_of((1, 1, 3, 2))
    held = M.halo_exchange(T.events_grid(spark, sf_dir), _E_WINS, p)
    return rounded(M.halo_exchange_adjoint(held.drop("ghost"), _E_WINS, p))


add("halo_exchange_adjoint", _halo_back, f"""
WITH {E} SELECT {own("i2", 30, 3)} * 2 + {own("i3", 24, 2)} AS rank, i0, i1, i2, i3, round(sum(v), 6) + 0.0 AS v
FROM e {_holder_sql("a", 30, 3, _E_WINS[2], "i2")} {_holder_sql("b", 24, 2, _E_WINS[3], "i3")} GROUP BY ALL
""")

_GOLDEN = windows((1, 1, 10), 2, 2)


def _halo_shapes(spark, sf_dir):
    rows = [(h.place, h.left, h.right, h.send_left, h.send_right, h.needed_start, h.needed_stop) for h in halos(grid_of((1, 1, 4)), _GOLDEN) if h.dim == 2]
    return spark.createDataFrame(rows, "rank long, left_halo long, right_halo long, send_left long, send_right long, needed_start long, needed_stop long")


add("halo_shapes", _halo_shapes, f"""
SELECT * FROM {values([(0, 0, 1, 0, 0, 0, 4), (1, 0, 0, 1, 0, 1, 3), (2, 0, 0, 0, 0, 0, 2), (3, 0, 0, 0, 0, 0, 2)], "rank", "left_halo", "right_halo", "send_left", "send_right", "needed_start", "needed_stop")}
""")

# Linear --------------------------------------------------------------------------------------------------------------------

_OUT = 6
_W_CELLS = _OUT * WIDTH


def _weights(spark):
    return grid(spark, (_OUT, WIDTH), ["o", "i"]).withColumn("w", T.eighths(F.col("i") * 7 + F.col("o") * 3))


def _bias(spark):
    return spark.range(_OUT).select(F.col("id").alias("o"), (F.col("id") / 4.0 - 0.5).alias("b"))


WSQL = f"w AS (SELECT o.o, i.i, ((i.i * 7 + o.o * 3) % 11 - 5) / 8.0 AS w FROM range({_OUT}) o(o), range({WIDTH}) i(i))"
YSQL = f"y AS (SELECT x.i0, w.o AS i1, sum(x.v * w.w) + w.o / 4.0 - 0.5 AS v FROM x JOIN w ON x.i1 = w.i GROUP BY x.i0, w.o)"


def _y(spark, d):
    return L.linear(T.embeddings(spark, d), _weights(spark), _bias(spark), _W_CELLS)


add("linear", lambda spark, d: rounded(_y(spark, d)), f"WITH {X}, {WSQL}, {YSQL} SELECT i0, i1, round(v, 6) + 0.0 AS v FROM y")


def _linear_arrays(spark, sf_dir):
    w = [[((i * 7 + o * 3) % 11 - 5) / 8.0 for i in range(WIDTH)] for o in range(_OUT)]
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    y = rows.select(F.col("vec_id").alias("i0"), F.posexplode(L.linear_rows(rows, "embedding", w, [o / 4.0 - 0.5 for o in range(_OUT)])).alias("p", "v"))
    return rounded(y.select("i0", F.col("p").cast("long").alias("i1"), "v"))


add("linear_arrays", _linear_arrays, ORACLE_SQL["linear"])
# Gradients: dy = y, so that all of it comes from the data.
add("linear_dx", lambda spark, d: rounded(L.linear_dx(_y(spark, d), _weights(spark), _W_CELLS)), f"WITH {X}, {WSQL}, {YSQL} SELECT y.i0, w.i AS i1, round(sum(y.v * w.w), 6) + 0.0 AS v FROM y JOIN w ON y.i1 = w.o GROUP BY y.i0, w.i")
add("linear_dw", lambda spark, d: rounded(L.linear_dw(T.embeddings(spark, d), _y(spark, d)), "w"), f"WITH {X}, {WSQL}, {YSQL} SELECT y.i1 AS o, x.i1 AS i, round(sum(x.v * y.v), 6) + 0.0 AS w FROM x JOIN y ON x.i0 = y.i0 GROUP BY ALL")
add("linear_db", lambda spark, d: rounded(L.linear_db(_y(spark, d)), "b"), f"WITH {X}, {WSQL}, {YSQL} SELECT i1 AS o, round(sum(v), 6) + 0.0 AS b FROM y GROUP BY i1")

# Convolution ---------------------------------------------------------------------------------------------------------------


def _kernel_sql(co: int, ci: int, sizes: tuple[int, ...]) -> str:
    flat = "ci.ci"
    for d, n in enumerate(sizes, 2):
        flat = f"({flat}) * {n} + t{d}.t{d}"
    names = ["co", "ci", *(f"t{d}" for d in range(2, 2 + len(sizes)))]
    return f"k AS (SELECT {', '.join(f'{n}.{n}' for n in names)}, ((({flat}) * 7 + co.co * 3) % 11 - 5) / 8.0 AS w FROM " + ", ".join(f"range({n}) {a}({a})" for a, n in zip(names, (co, ci, *sizes), strict=True)) + ")"


def _at(w: Window, d: int) -> str:
    return f"o{d}.o{d} * {w.stride} + t{d} * {w.dilation} - {w.padding}"


def _outs(wins) -> str:
    return ", ".join(f"range({w.out}) o{d}(o{d})" for d, w in enumerate(wins[2:], 2))


def _names(wins, prefix="o") -> str:
    return ", ".join(f"{prefix}{d}.o{d} AS i{d}" if prefix == "o" else f"{prefix}{d}" for d in range(2, len(wins)))


def _y_sql(x: str, wins, bias: bool = True) -> str:
    """Output cell by output cell: every kernel tap looks up the input cell below it; taps in the padding find none."""
    hit = " AND ".join(f"x.i{d} = {_at(w, d)}" for d, w in enumerate(wins[2:], 2))
    return f"y AS (SELECT CAST(0 AS BIGINT) AS i0, k.co AS i1, {_names(wins)}, sum(coalesce(x.v, 0) * k.w){' + k.co / 4.0' if bias else ''} AS v FROM {_outs(wins)}, k LEFT JOIN {x} x ON x.i1 = k.ci AND {hit} GROUP BY ALL)".replace(" GROUP BY ALL", f" GROUP BY k.co, {', '.join(f'o{d}.o{d}' for d in range(2, len(wins)))}")


def _conv_sql(with_: str, x: str, wins, co: int, select: str | None = None) -> str:
    k = _kernel_sql(co, wins[1].n, tuple(w.kernel for w in wins[2:]))
    idx = ", ".join(index_columns(len(wins)))
    return f"WITH {with_}, {k}, {_y_sql(x, wins)} " + (select or f"SELECT {idx}, round(v, 6) + 0.0 AS v FROM y")


def _conv_bias(spark, co):
    return spark.range(co).select(F.col("id").alias("co"), (F.col("id") / 4.0).alias("b"))


def _conv(tensor, wins, co, **kw):
    def query(spark, sf_dir):
        k = T.kernel(spark, co, wins[1].n, tuple(w.kernel for w in wins[2:]))
        return C.conv(tensor(spark, sf_dir), k, _conv_bias(spark, co), wins, co, **kw)

    return query


_C1, _C2, _C3 = windows(S_SHAPE, 7, 1, 3), windows(E_SHAPE, 3, 1, 1), windows(V_SHAPE, (3, 3, 3), 1, 1)
_C2S = windows(E_SHAPE, (5, 3), (2, 3), (4, 1), (2, 1))
_SM, _EM, _VM = ((HOUR, "s"), (E, "e"), (VOL, "g"))

for _n, _t, _src, _w, _co in (("conv1d", T.hourly, _SM, _C1, 2), ("conv2d", T.events_grid, _EM, _C2, 3), ("conv3d", T.volume, _VM, _C3, 2), ("conv2d_strided_dilated", T.events_grid, _EM, _C2S, 3)):
    add(_n, (lambda q: lambda spark, d: rounded(q(spark, d)))(_conv(_t, _w, _co)), _conv_sql(*_src, _w, _co))

# The channel and general layouts: the same cells, with their owner in P_y.
for _n, _p in (("conv2d_channel", (1, 3, 1, 1)), ("conv2d_general", (1, 3, 2, 2))):
    _r = f"{own('i1', 3, 3)} * {_p[2] * _p[3]} + {own('i2', _C2[2].out, _p[2])} * {_p[3]} + {own('i3', _C2[3].out, _p[3])}"
    add(_n, (lambda q: lambda spark, d: rounded(q(spark, d)))(_conv(T.events_grid, _C2, 3, p_y=grid_of(_p))), _conv_sql(*_EM, _C2, 3, f"SELECT i0, i1, i2, i3, round(v, 6) + 0.0 AS v, {_r} AS rank FROM y"))


def _edge_sql(mode: str, i: str, n: int) -> str:
    return {"reflect": f"(CASE WHEN {i} < 0 THEN -({i}) WHEN {i} >= {n} THEN {2 * (n - 1)} - ({i}) ELSE {i} END)", "replicate": f"greatest(0, least({n - 1}, {i}))", "circular": f"(({i} + {n}) % {n})"}[mode]


for _mode in ("reflect", "replicate", "circular"):
    _hit = " AND ".join(f"x.i{d} = {_edge_sql(_mode, _at(_C2[d], d), _C2[d].n)}" for d in (2, 3))
    add(f"conv2d_{_mode}", (lambda q: lambda spark, d: rounded(q(spark, d)))(_conv(T.events_grid, _C2, 3, padding_mode=_mode)), f"WITH {E}, {_kernel_sql(3, 5, (3, 3))} SELECT CAST(0 AS BIGINT) AS i0, k.co AS i1, o2.o2 AS i2, o3.o3 AS i3, round(sum(x.v * k.w) + k.co / 4.0, 6) + 0.0 AS v FROM {_outs(_C2)}, k JOIN e x ON x.i1 = k.ci AND {_hit} GROUP BY k.co, o2.o2, o3.o3")

# Gradients: dy is the output itself.
_DX = "SELECT x.i0, x.i1, x.i2, x.i3, round(coalesce(sum(y.v * k.w), 0), 6) + 0.0 AS v FROM e x LEFT JOIN k ON k.ci = x.i1 LEFT JOIN y ON y.i1 = k.co AND " + " AND ".join(f"y.i{d} * {w.stride} + k.t{d} * {w.dilation} - {w.padding} = x.i{d}" for d, w in enumerate(_C2S[2:], 2)) + " GROUP BY x.i0, x.i1, x.i2, x.i3"
_DW = "SELECT k.co, k.ci, k.t2, k.t3, round(coalesce(sum(y.v * x.v), 0), 6) + 0.0 AS w FROM k LEFT JOIN y ON y.i1 = k.co LEFT JOIN e x ON x.i1 = k.ci AND " + " AND ".join(f"x.i{d} = y.i{d} * {w.stride} + k.t{d} * {w.dilation} - {w.padding}" for d, w in enumerate(_C2S[2:], 2)) + " GROUP BY k.co, k.ci, k.t2, k.t3"
_conv2 = _conv(T.events_grid, _C2S, 3)
add("conv2d_dx", lambda spark, d: rounded(C.conv_dx(_conv2(spark, d), T.kernel(spark, 3, 5, (5, 3)), _C2S, 3)), _conv_sql(*_EM, _C2S, 3, _DX))
add("conv2d_dw", lambda spark, d: rounded(C.conv_dw(T.events_grid(spark, d), _conv2(spark, d), _C2S, 3), "w"), _conv_sql(*_EM, _C2S, 3, _DW))
add("conv2d_db", lambda spark, d: rounded(C.conv_db(_conv2(spark, d)), "b"), _conv_sql(*_EM, _C2S, 3, "SELECT i1 AS co, round(sum(v), 6) + 0.0 AS b FROM y GROUP BY i1"))

# Pooling -------------------------------------------------------------------------------------------------------------------


def _pool_sql(with_: str, x: str, wins, kind: str) -> str:
    hit = " AND ".join(f"x.i{d} >= o{d}.o{d} * {w.stride} - {w.padding} AND x.i{d} <= o{d}.o{d} * {w.stride} - {w.padding} + {w.reach} AND (x.i{d} - o{d}.o{d} * {w.stride} + {w.padding}) % {w.dilation} = 0" for d, w in enumerate(wins[2:], 2))
    v = "max(x.v)" if kind == "max" else f"sum(x.v) / {math.prod(w.kernel for w in wins[2:])}"
    return f"WITH {with_} SELECT x.i0, x.i1, {_names(wins)}, round({v}, 6) + 0.0 AS v FROM {x} x, {_outs(wins)} WHERE {hit} GROUP BY x.i0, x.i1, {', '.join(f'o{d}.o{d}' for d in range(2, len(wins)))}"


_P1, _P2, _P3, _PD = windows(S_SHAPE, 6, 6), windows(E_SHAPE, (5, 3), 2, (2, 1)), windows(V_SHAPE, (2, 3, 4), (1, 3, 4)), windows(E_SHAPE, 3, (2, 1), 1, (3, 2))
for _n, _t, _src, _w in (("pool1d", T.hourly, _SM, _P1), ("pool2d", T.events_grid, _EM, _P2), ("pool3d", T.volume, _VM, _P3)):
    for _k, _f in (("max", K.max_pool), ("avg", K.avg_pool)):
        add(f"{_k}_{_n}", (lambda t, w, f: lambda spark, d: rounded(f(t(spark, d), w)))(_t, _w, _f), _pool_sql(*_src, _w, _k))
add("max_pool_dilated", lambda spark, d: rounded(K.max_pool(T.events_grid(spark, d), _PD)), _pool_sql(*_EM, _PD, "max"))
_PF = windows(S_SHAPE, 24)
add("max_pool1d_frames", lambda spark, d: rounded(K.max_pool_1d_frames(T.hourly(spark, d), _PF[2])), _pool_sql(*_SM, _PF, "max"))

_HIT2 = " AND ".join(f"x.i{d} BETWEEN y.i{d} * {w.stride} - {w.padding} AND y.i{d} * {w.stride} - {w.padding} + {w.reach}" for d, w in enumerate(_P2[2:], 2))


def _pool_y(kind: str) -> str:
    return _pool_sql(*_EM, _P2, kind).replace("WITH ", "", 1).replace(" SELECT x.i0, x.i1, o2", ", y AS (SELECT x.i0, x.i1, o2", 1).replace("round(", "(").replace(", 6) + 0.0", ")") + ")"


add("avg_pool_adjoint", lambda spark, d: rounded(K.avg_pool_adjoint(K.avg_pool(T.events_grid(spark, d), _P2), _P2)), f"WITH {_pool_y('avg')} SELECT x.i0, x.i1, x.i2, x.i3, round(coalesce(sum(y.v) / 15, 0), 6) + 0.0 AS v FROM e x LEFT JOIN y ON y.i1 = x.i1 AND {_HIT2} GROUP BY x.i0, x.i1, x.i2, x.i3")
add("max_pool_adjoint", lambda spark, d: rounded(K.max_pool_adjoint(T.events_grid(spark, d), K.max_pool(T.events_grid(spark, d), _P2), _P2)), f"""
WITH {_pool_y("max")}, r AS (
  SELECT y.i1, y.i2 AS o2, y.i3 AS o3, y.v AS dy, x.i2, x.i3, row_number() OVER (PARTITION BY y.i1, y.i2, y.i3 ORDER BY x.v DESC, x.i2, x.i3) AS n FROM y JOIN e x ON x.i1 = y.i1 AND {_HIT2}
)
SELECT x.i0, x.i1, x.i2, x.i3, round(coalesce(sum(r.dy), 0), 6) + 0.0 AS v FROM e x LEFT JOIN r ON r.n = 1 AND r.i1 = x.i1 AND r.i2 = x.i2 AND r.i3 = x.i3 GROUP BY x.i0, x.i1, x.i2, x.i3
""")

# Batch normalisation -------------------------------------------------------------------------------------------------------

EPS = 1e-5


def _affine(spark, n):
    return spark.range(n).select(F.col("id").alias("i1"), (1 + F.col("id") / 8.0).alias("gamma"), (F.col("id") / 4.0 - 1).alias("beta"))


STATS = "st AS (SELECT i1, avg(v) AS mean, var_pop(v) AS var FROM {x} GROUP BY i1)"
add("batchnorm_train", lambda spark, d: rounded(N.normalise(T.embeddings(spark, d), N.batch_stats(T.embeddings(spark, d)), WIDTH, EPS, _affine(spark, WIDTH))), f"WITH {X}, {STATS.format(x='x')} SELECT i0, i1, round((v - mean) / sqrt(var + {EPS}) * (1 + i1 / 8.0) + i1 / 4.0 - 1, 6) + 0.0 AS v FROM x JOIN st USING (i1)")
add("batchnorm_train_2d", lambda spark, d: rounded(N.normalise(T.events_grid(spark, d), N.batch_stats(T.events_grid(spark, d)), 5, 1e-3)), f"WITH {E}, {STATS.format(x='e')} SELECT i0, i1, i2, i3, round((v - mean) / sqrt(var + 0.001), 6) + 0.0 AS v FROM e JOIN st USING (i1)")


def _steps(spark, sf_dir):
    """Days as batches of events: mean and variance per type and day."""
    return T.events_grid(spark, sf_dir).groupBy(F.col("i2").alias("step"), "i1").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"))


_STEPS = "b AS (SELECT i2 AS step, i1, avg(v) AS mean, var_pop(v) AS var FROM e GROUP BY i2, i1)"
_EMA = f"{_STEPS}, r AS (SELECT i1, sum(mean * 0.1 * pow(0.9, 29 - step)) AS running_mean, pow(0.9, 30) + sum(var * 0.1 * pow(0.9, 29 - step)) AS running_var FROM b GROUP BY i1)"
add("batchnorm_running_ema", lambda spark, d: rounded(N.running_stats(_steps(spark, d), 0.1), "running_mean", "running_var"), f"WITH {E}, {_EMA} SELECT i1, round(running_mean, 6) + 0.0 AS running_mean, round(running_var, 6) + 0.0 AS running_var FROM r")
add("batchnorm_running_cma", lambda spark, d: rounded(N.running_stats(_steps(spark, d), None), "running_mean", "running_var"), f"WITH {E}, {_STEPS} SELECT i1, round(avg(mean), 6) + 0.0 AS running_mean, round(avg(var), 6) + 0.0 AS running_var FROM b GROUP BY i1")


def _running(spark, sf_dir):
    return N.running_stats(_steps(spark, sf_dir), 0.1).toDF("i1", "mean", "var")


add("batchnorm_eval", lambda spark, d: rounded(N.normalise(T.events_grid(spark, d), _running(spark, d), 5, EPS, _affine(spark, 5))), f"WITH {E}, {_EMA} SELECT i0, i1, i2, i3, round((v - running_mean) / sqrt(running_var + {EPS}) * (1 + i1 / 8.0) + i1 / 4.0 - 1, 6) + 0.0 AS v FROM e JOIN r USING (i1)")
_G = f"WITH {X}, {STATS.format(x='x')}, h AS (SELECT i0, i1, v, (v - mean) / sqrt(var + {EPS}) AS hat, var FROM x JOIN st USING (i1)), q AS (SELECT i1, sum(v * hat) AS dgamma, sum(v) AS dbeta, count(*) AS n FROM h GROUP BY i1)"
add("batchnorm_dx", lambda spark, d: rounded(N.gradients(T.embeddings(spark, d), T.embeddings(spark, d), WIDTH, EPS, _affine(spark, WIDTH))[0]), _G + f" SELECT i0, i1, round((1 + i1 / 8.0) / sqrt(var + {EPS}) * (v - dbeta / n - hat * dgamma / n), 6) + 0.0 AS v FROM h JOIN q USING (i1)")
add("batchnorm_dparams", lambda spark, d: rounded(N.gradients(T.embeddings(spark, d), T.embeddings(spark, d), WIDTH, EPS)[1], "dgamma", "dbeta"), _G + " SELECT i1, round(dgamma, 6) + 0.0 AS dgamma, round(dbeta, 6) + 0.0 AS dbeta FROM q")
add("batchnorm_eval_dx", lambda spark, d: rounded(N.eval_gradient(T.events_grid(spark, d), _running(spark, d), 5, EPS, _affine(spark, 5))), f"WITH {E}, {_EMA} SELECT i0, i1, i2, i3, round(v * (1 + i1 / 8.0) / sqrt(running_var + {EPS}), 6) + 0.0 AS v FROM e JOIN r USING (i1)")

# Interpolation -------------------------------------------------------------------------------------------------------------


def _table_sql(name: str, n_in: int, n_out: int, mode: str, align=False, scale=None, window=None, out_window=None) -> str:
    a, b = window or (0, n_in)
    first, stop = out_window or (0, n_out)
    if mode == "nearest":
        return f"{name} AS (SELECT j.j, greatest({a}, least({b - 1}, j.j * {n_in} // {n_out})) AS i, CAST(1 AS DOUBLE) AS w FROM range({first}, {stop}) j(j))"
    if align:
        src = f"j.j * CAST({n_in - 1} AS DOUBLE) / {max(n_out - 1, 1)}"
    else:
        src = f"(j.j + 0.5) * {f'(1.0 / CAST({scale} AS DOUBLE))' if scale else f'(CAST({n_in} AS DOUBLE) / {n_out})'} - 0.5"
    return f"""{name}_s AS (SELECT j.j, greatest(CAST(0 AS DOUBLE), {src} - {a}) AS s FROM range({first}, {stop}) j(j)),
{name}_l AS (SELECT j, least(CAST(floor(s) AS BIGINT), {b - a - 1}) AS lo, s - least(CAST(floor(s) AS BIGINT), {b - a - 1}) AS f FROM {name}_s),
{name}_f AS (SELECT j, lo, CASE WHEN abs(f) < 0.0001 THEN 0 WHEN abs(f - 1) < 0.0001 THEN 1 ELSE f END AS f FROM {name}_l),
{name} AS (SELECT j, lo + {a} AS i, 1 - f AS w FROM {name}_f UNION ALL SELECT j, least(lo + 1, {b - a - 1}) + {a}, f FROM {name}_f)"""


def _interp_sql(src, shape, out, mode, align=False, scale=None, window=None, out_window=None, back=False) -> str:
    with_, x = src
    dims = range(len(shape) - 2)
    tabs = ", ".join(_table_sql(f"t{d + 2}", shape[d + 2], out[d + 2], mode, align, scale, window[d] if window else None, out_window[d] if out_window else None) for d in dims)
    prod = " * ".join(f"t{d + 2}.w" for d in dims)
    joins = " ".join(f"JOIN t{d + 2} ON t{d + 2}.i = x.i{d + 2}" for d in dims)
    js = ", ".join(f"t{d + 2}.j AS i{d + 2}" for d in dims)
    fwd = f"SELECT x.i0, x.i1, {js}, sum(x.v * {prod}) AS v FROM {x} x {joins} GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY x.i0, x.i1, " + ", ".join(f"t{d + 2}.j" for d in dims))
    idx = ", ".join(f"i{d}" for d in range(len(shape)))
    if not back:
        return f"WITH {with_}, {tabs}, y AS ({fwd}) SELECT {idx}, round(v, 6) + 0.0 AS v FROM y"
    to = " ".join(f"JOIN t{d + 2} ON t{d + 2}.j = y.i{d + 2}" for d in dims)
    z = f"z AS (SELECT y.i0, y.i1, {', '.join(f't{d + 2}.i AS i{d + 2}' for d in dims)}, sum(y.v * {prod}) AS v FROM y {to} GROUP BY y.i0, y.i1, {', '.join(f't{d + 2}.i' for d in dims)})"
    return f"WITH {with_}, {tabs}, y AS ({fwd}), {z} SELECT {', '.join(f'x.i{d}' for d in range(len(shape)))}, round(coalesce(z.v, 0), 6) + 0.0 AS v FROM {x} x LEFT JOIN z ON {' AND '.join(f'z.i{d} = x.i{d}' for d in range(len(shape)))}"


def _up(tensor, shape, **kw):
    return lambda spark, d: rounded(U.upsample(tensor(spark, d), shape, **kw))


add("upsample_nearest", _up(T.events_grid, E_SHAPE, scale_factor=2, mode="nearest"), _interp_sql(_EM, E_SHAPE, (1, 5, 60, 48), "nearest"))
add("upsample_linear", _up(T.hourly, S_SHAPE, scale_factor=1.5), _interp_sql(_SM, S_SHAPE, (1, 1, 1080), "linear", scale=1.5))
add("upsample_bilinear", _up(T.events_grid, E_SHAPE, scale_factor=2), _interp_sql(_EM, E_SHAPE, (1, 5, 60, 48), "linear", scale=2))
add("upsample_trilinear", _up(T.volume, V_SHAPE, scale_factor=1.5), _interp_sql(_VM, V_SHAPE, (1, 1, 7, 45, 36), "linear", scale=1.5))
add("upsample_align_corners", _up(T.events_grid, E_SHAPE, scale_factor=2, align_corners=True), _interp_sql(_EM, E_SHAPE, (1, 5, 60, 48), "linear", True))
add("upsample_size", _up(T.events_grid, E_SHAPE, size=(1, 5, 44, 35)), _interp_sql(_EM, E_SHAPE, (1, 5, 44, 35), "linear"))
add("upsample_adjoint", lambda spark, d: rounded(U.upsample_adjoint(U.upsample(T.events_grid(spark, d), E_SHAPE, size=(1, 5, 44, 35)), E_SHAPE, size=(1, 5, 44, 35))), _interp_sql(_EM, E_SHAPE, (1, 5, 44, 35), "linear", back=True))
add("upsample_nearest_adjoint", lambda spark, d: rounded(U.upsample_adjoint(U.upsample(T.events_grid(spark, d), E_SHAPE, scale_factor=2, mode="nearest"), E_SHAPE, scale_factor=2, mode="nearest")), _interp_sql(_EM, E_SHAPE, (1, 5, 60, 48), "nearest", back=True))

_WIN, _OWIN = ((4, 20), (3, 17)), ((10, 30), (0, 35))


def _window(mode):
    def query(spark, sf_dir):
        index = U.tables(spark, E_SHAPE, (1, 5, 44, 35), mode, window=_WIN, out_window=_OWIN)
        return rounded(U.interpolate(T.events_grid(spark, sf_dir), index, [88, 70]))

    return query


for _mode in ("nearest", "linear"):
    add(f"interpolate_window_{_mode}", _window(_mode), _interp_sql(_EM, E_SHAPE, (1, 5, 44, 35), _mode, window=_WIN, out_window=_OWIN))

# Losses: neighbouring days of the events grid, scaled into [0, 1) --------------------------------------------------------------

_SCALE = 65536.0


def _pair(spark, sf_dir):
    """v: a cell in [0, 1), y: the same hour a day later (the last day: the first)."""
    e = T.events_grid(spark, sf_dir).withColumn("v", F.pmod(F.col("v"), F.lit(_SCALE)) / _SCALE)
    later = e.withColumn("i2", F.pmod(F.col("i2") + T.DAYS - 1, F.lit(T.DAYS)))
    return S.paired(e, later)


_PAIR = f"{E}, a AS (SELECT i0, i1, i2, i3, (v % {_SCALE}) / {_SCALE} AS v FROM e), p AS (SELECT a.i0, a.i1, a.i2, a.i3, a.v AS x, b.v AS y FROM a JOIN a b ON b.i0 = a.i0 AND b.i1 = a.i1 AND b.i3 = a.i3 AND b.i2 = (a.i2 + 1) % 30)"
_LN = "(CASE WHEN {0} > 0 THEN greatest(ln(CASE WHEN {0} > 0 THEN {0} ELSE 1 END), -100) ELSE -100 END)"
_LOSS = {
    "l1": ("abs(x - y)", "sign(x - y)"),
    "mse": ("pow(x - y, 2)", "2 * (x - y)"),
    "poisson_nll": ("exp(x) - x * y", "exp(x) - y"),
    "bce": (f"-(y * {_LN.format('x')} + (1 - y) * {_LN.format('(1 - x)')})", "(x - y) / greatest(x * (1 - x), 1e-12)"),
    "bce_logits": ("greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))", "1 / (1 + exp(-x)) - y"),
    "kl": ("CASE WHEN y > 0 THEN y * (ln(CASE WHEN y > 0 THEN y ELSE 1 END) - x) ELSE 0 END", "CASE WHEN y > 0 THEN -y ELSE 0 END"),
}
for _kind, (_form, _grad) in _LOSS.items():
    for _red, _agg in (("none", None), ("sum", "sum({})"), ("mean", "sum({}) / 3600"), ("batchmean", "sum({}) / 1")):
        if _red == "batchmean" and _kind != "kl":
            continue
        _q = (lambda k, r: lambda spark, d: rounded(S.loss(_pair(spark, d), k, r)))(_kind, _red)
        add(f"loss_{_kind}_{_red}", _q, f"WITH {_PAIR} SELECT " + (f"i0, i1, i2, i3, round({_form}, 6) + 0.0 AS v FROM p" if _agg is None else f"round({_agg.format(_form)}, 6) + 0.0 AS v FROM p"))
    # Gradients of the mean, with an upstream gradient of 7.  The slope of bce has no bound near 0, so there its input is 1/65536 at least.
    _least = 1 / _SCALE if _kind == "bce" else 0.0
    add(f"loss_{_kind}_grad", (lambda k, m: lambda spark, d: rounded(S.gradient(_pair(spark, d).withColumn("v", F.greatest("v", F.lit(m))), k, "mean", E_SHAPE, 7.0)))(_kind, _least), f"WITH {_PAIR}, q AS (SELECT i0, i1, i2, i3, greatest(x, CAST({_least!r} AS DOUBLE)) AS x, y FROM p) SELECT i0, i1, i2, i3, round(({_grad}) * 7 / 3600, 6) + 0.0 AS v FROM q")

# Adjoint identities: <F x, y> and <x, F* y> as two columns of one row ---------------------------------------------------------


def _dot(a: DataFrame, b: DataFrame, names: list[str], as_: str) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "_b"), names).agg(F.sum(F.col("v") * F.col("_b")).alias(as_))


def _identity(forward: DataFrame, y: DataFrame, y_names, x: DataFrame, back: DataFrame, x_names) -> DataFrame:
    """left: <F x, y>, right: <x, F* y>, rounded; same: whether they agree to a billionth."""
    left, right = _dot(forward, y, y_names, "left_side"), _dot(x, back, x_names, "right_side")
    both = left.select("left_side", F.lit(1).alias("_k")).join(right.select("right_side", F.lit(1).alias("_k")), "_k").drop("_k")
    same = F.abs(F.col("left_side") - F.col("right_side")) <= 1e-9 * F.greatest(F.abs("left_side"), F.abs("right_side"), F.lit(1.0))
    return both.select(F.round("left_side", 4).alias("left_side"), same.alias("same"))


def _wave(df: DataFrame, names: list[str]) -> DataFrame:
    """A second tensor on the same cells: eighths by index."""
    flat = F.lit(0).cast("long")
    for n in names:
        flat = flat * 13 + F.col(n)
    return df.select(*names, T.eighths(flat).alias("v"))


def _id_broadcast(spark, d):
    p_x, p_y, names = grid_of((2, 1)), grid_of((2, 3)), ["rank", "l0", "l1"]
    x = _blocks(spark, d, p_x)
    f = M.broadcast(x, p_x, p_y)
    y = _wave(f, names)
    return _identity(f, y, names, x, M.broadcast_adjoint(y, p_x, p_y), names)


def _id_sum_reduce(spark, d):
    p_x, p_y, names = grid_of((2, 4)), grid_of((2, 1)), ["rank", "l0", "l1"]
    x = _blocks(spark, d, p_x)
    f = M.sum_reduce(x, p_x, p_y)
    y = _wave(f, names)
    return _identity(f, y, names, x, M.sum_reduce_adjoint(y, p_x, p_y), names)


def _id_repartition(spark, d):
    p_x, p_y, names, shape = grid_of((4, 1)), grid_of((2, 2)), ["i0", "i1"], (vectors(spark, d), WIDTH)
    x = T.embeddings(spark, d)
    f = M.repartition(x, shape, p_x, p_y).drop("rank")
    y = _wave(f, names)
    return _identity(f, y, names, x, M.repartition_adjoint(y, shape, p_x, p_y).drop("rank"), names)


def _id_halo(spark, d):
    p, names = grid_of((1, 1, 3, 2)), ["i0", "i1", "i2", "i3"]
    x = T.events_grid(spark, d)
    f = M.halo_exchange(x, _E_WINS, p).drop("ghost")
    y = _wave(f, ["rank", *names])
    return _identity(f, y, ["rank", *names], x, M.halo_exchange_adjoint(y, _E_WINS, p).drop("rank"), names)


def _id_linear(spark, d):
    x, w, names = T.embeddings(spark, d), _weights(spark), ["i0", "i1"]
    f = L.linear(x, w, None, _W_CELLS)
    y = _wave(f, names)
    return _identity(f, y, names, x, L.linear_dx(y, w, _W_CELLS), names)


def _id_conv(spark, d):
    x, k, names = T.events_grid(spark, d), T.kernel(spark, 3, 5, (5, 3)), ["i0", "i1", "i2", "i3"]
    f = C.conv(x, k, None, _C2S, 3)
    y = _wave(f, names)
    return _identity(f, y, names, x, C.conv_dx(y, k, _C2S, 3), names)


def _id_upsample(spark, d):
    x, names = T.events_grid(spark, d), ["i0", "i1", "i2", "i3"]
    f = U.upsample(x, E_SHAPE, scale_factor=2)
    y = _wave(f, names)
    return _identity(f, y, names, x, U.upsample_adjoint(y, E_SHAPE, scale_factor=2), names)


def _wave_sql(names: list[str]) -> str:
    flat = "0"
    for n in names:
        flat = f"({flat}) * 13 + {n}"
    return f"(({flat}) % 11 - 5) / 8.0"


def _id_sql(forward: str, names: list[str]) -> str:
    """forward: SQL that ends with a table f (names.., v)."""
    return f"WITH {forward} SELECT round(sum(v * {_wave_sql(names)}), 4) AS left_side, true AS same FROM f"


_BLK = ["rank", "l0", "l1"]
_IDX = ["i0", "i1", "i2", "i3"]
add("adjoint_identity_broadcast", _id_broadcast, _id_sql(f"{_blocks_sql((2, 1))}, f AS (SELECT p.dst AS rank, l0, l1, v FROM b JOIN {values(_ROWS_TO_GRID, 'src', 'dst')} p ON b.rank = p.src)", _BLK))
add("adjoint_identity_sum_reduce", _id_sum_reduce, _id_sql(f"{_blocks_sql((2, 4))}, f AS (SELECT rank // 4 AS rank, l0, l1, sum(v) AS v FROM b GROUP BY rank // 4, l0, l1)", _BLK))
add("adjoint_identity_repartition", _id_repartition, _id_sql(f"{X}, f AS (SELECT * FROM x)", ["i0", "i1"]))
add("adjoint_identity_halo", _id_halo, _id_sql(f"{E}, f AS (SELECT a.k * 2 + b.k AS rank, i0, i1, i2, i3, v FROM e {_holder_sql('a', 30, 3, _E_WINS[2], 'i2')} {_holder_sql('b', 24, 2, _E_WINS[3], 'i3')})", ["rank", *_IDX]))
add("adjoint_identity_linear", _id_linear, _id_sql(f"{X}, {WSQL}, f AS (SELECT x.i0, w.o AS i1, sum(x.v * w.w) AS v FROM x JOIN w ON x.i1 = w.i GROUP BY x.i0, w.o)", ["i0", "i1"]))
add("adjoint_identity_conv", _id_conv, _id_sql(f"{E}, {_kernel_sql(3, 5, (5, 3))}, {_y_sql('e', _C2S, bias=False)}, f AS (SELECT * FROM y)", _IDX))
add("adjoint_identity_upsample", _id_upsample, _id_sql(_interp_sql(_EM, E_SHAPE, (1, 5, 60, 48), "linear", scale=2).removeprefix("WITH ").replace(") SELECT i0, i1, i2, i3, round(v, 6) + 0.0 AS v FROM y", "), f AS (SELECT * FROM y)"), _IDX))


# Teams ---------------------------------------------------------------------------------------------------------------------

# Beyond the edge is -1 here, so that the columns stay integers in every client.
add("worker_grid", lambda spark, d: W.worker_grid(spark, grid_of((3, 4))).fillna(-1), """
SELECT a.k * 4 + b.k AS rank, a.k AS k0, b.k AS k1, CASE WHEN a.k > 0 THEN (a.k - 1) * 4 + b.k ELSE -1 END AS left0, CASE WHEN a.k < 2 THEN (a.k + 1) * 4 + b.k ELSE -1 END AS right0,
       CASE WHEN b.k > 0 THEN a.k * 4 + b.k - 1 ELSE -1 END AS left1, CASE WHEN b.k < 3 THEN a.k * 4 + b.k + 1 ELSE -1 END AS right1
FROM range(3) a(k), range(4) b(k)
""")
add("sub_grids", lambda spark, d: W.sub_grids(spark, grid_of((2, 3, 4)), (True, False, True)), """
SELECT b.k AS line, (a.k * 3 + b.k) * 4 + c.k AS rank, a.k * 4 + c.k AS place FROM range(2) a(k), range(3) b(k), range(4) c(k)
""")


def _unbalanced_shapes(spark, sf_dir):
    n = vectors(spark, sf_dir)
    sizes = ((n // 10, n // 5, n - n // 10 - n // 5), (20, WIDTH - 20))
    return W.block_shapes(M.place(T.embeddings(spark, sf_dir), (n, WIDTH), grid_of((3, 2)), sizes), 2)


add("block_shapes_unbalanced", _unbalanced_shapes, f"""
WITH n AS (SELECT count(*) AS n FROM embeddings), s AS (SELECT 0 AS k, n // 10 AS n0 FROM n UNION ALL SELECT 1, n // 5 FROM n UNION ALL SELECT 2, n - n // 10 - n // 5 FROM n)
SELECT CAST(s.k * 2 + t.k AS BIGINT) AS rank, s.n0, CAST(CASE WHEN t.k = 0 THEN 20 ELSE 44 END AS BIGINT) AS n1 FROM s, range(2) t(k)
""")


def _worker_vectors(spark, sf_dir):
    """Each worker's number of cells and smallest and largest index."""
    placed = M.place(T.embeddings(spark, sf_dir), (vectors(spark, sf_dir), WIDTH), grid_of((4, 1)))
    return placed.groupBy("rank").agg(F.array(F.count("*"), F.min("i0"), F.max("i0") + 1).alias("data"))


_VEC = f"v AS (SELECT {own('i0', NX, 4)} AS rank, count(*) AS a, min(i0) AS b, max(i0) + 1 AS c FROM x GROUP BY 1)"
add("all_gather", lambda spark, d: W.all_gather(_worker_vectors(spark, d), 4 * 3).select("rank", F.posexplode("gathered").alias("p", "g")).select("rank", F.col("p").cast("long").alias("source"), F.col("g")[0].alias("cells"), F.col("g")[1].alias("first"), F.col("g")[2].alias("stop")), f"WITH {X}, {_VEC} SELECT r.rank, v.rank AS source, v.a AS cells, v.b AS first, v.c AS stop FROM v r, v")
for _op in ("sum", "min", "max"):
    add(f"all_reduce_vectors_{_op}", (lambda op: lambda spark, d: W.all_reduce_vectors(_worker_vectors(spark, d), op))(_op), f"WITH {X}, {_VEC} SELECT CAST(0 AS BIGINT) AS position, CAST({_op}(a) AS BIGINT) AS v FROM v UNION ALL SELECT 1, CAST({_op}(b) AS BIGINT) FROM v UNION ALL SELECT 2, CAST({_op}(c) AS BIGINT) FROM v")
add("broadcast_vector", lambda spark, d: W.broadcast_vector(_worker_vectors(spark, d), 2, (0, 2, 3, 7)).select("rank", F.col("data")[0].alias("cells"), F.col("data")[1].alias("first")), f"WITH {X}, {_VEC} SELECT r.r AS rank, a AS cells, b AS first FROM v, {values([(0,), (2,), (3,), (7,)], 'r')} r WHERE v.rank = 2")

# Line items as a tensor of four channels -------------------------------------------------------------------------------------

_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _lines(spark, sf_dir):
    """(i1 = column, v) of every line; only the four columns are read."""
    t = T.lineitem_columns(spark, sf_dir).select(F.posexplode(F.array(*_COLUMNS)).alias("p", "v"))
    return t.select(F.col("p").cast("long").alias("i1"), "v")


_LINES = "l AS (" + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS i1, {c} AS v FROM lineitem" for k, c in enumerate(_COLUMNS)) + ")"
add("batch_stats_lines", lambda spark, d: N.batch_stats(_lines(spark, d)).select("i1", F.round("mean", 4).alias("mean"), F.round(F.sqrt("var"), 4).alias("deviation")), f"WITH {_LINES} SELECT i1, round(avg(v), 4) AS mean, round(sqrt(var_pop(v)), 4) AS deviation FROM l GROUP BY i1")


def _line_sums(spark, sf_dir):
    """Cents of each flag and status, summed over all statuses and over all."""
    p = grid_of((3, 2))
    t = T.lineitem_columns(spark, sf_dir)
    at = F.expr("case i0 when 65 then 0 when 78 then 1 else 2 end * 2 + case i1 when 70 then 0 else 1 end")
    blocks = t.select(at.cast("long").alias("rank"), F.lit(0).cast("long").alias("l0"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("v"))
    held = blocks.groupBy("rank", "l0").agg(F.sum("v").alias("v"))
    return M.all_reduce(held, p, axes_reduce=(1,))


add("all_sum_reduce_lines", _line_sums, """
WITH h AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS f, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS s, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS v FROM lineitem GROUP BY ALL)
SELECT CAST(f * 2 + s AS BIGINT) AS rank, CAST(0 AS BIGINT) AS l0, CAST(sum(v) OVER (PARTITION BY f) AS BIGINT) AS v FROM h
""")


def _line_loss(spark, sf_dir):
    t = T.lineitem_columns(spark, sf_dir)
    return rounded(S.loss(t.select(F.col("l_discount").alias("v"), F.col("l_tax").alias("y")), "bce", "mean"))


add("loss_bce_lines", _line_loss, f"SELECT round(avg(-(y * {_LN.format('x')} + (1 - y) * {_LN.format('(1 - x)')})), 6) + 0.0 AS v FROM (SELECT l_discount AS x, l_tax AS y FROM lineitem)")


def _id_all_sum(spark, d):
    p, names = grid_of((2, 4)), ["rank", "l0", "l1"]
    x = _blocks(spark, d, p)
    f = M.all_reduce(x, p, axes_reduce=(1,))
    y = _wave(f, names)
    return _identity(f, y, names, x, M.all_reduce(y, p, axes_reduce=(1,)), names)


add("adjoint_identity_all_sum_reduce", _id_all_sum, _id_sql(f"{_blocks_sql((2, 4))}, f AS (SELECT rank, l0, l1, sum(v) OVER (PARTITION BY rank // 4, l0, l1) AS v FROM b)", _BLK))


def _id_avg_pool(spark, d):
    x = T.events_grid(spark, d)
    f = K.avg_pool(x, _P2)
    y = _wave(f, _IDX)
    return _identity(f, y, _IDX, x, K.avg_pool_adjoint(y, _P2), _IDX)


add("adjoint_identity_avg_pool", _id_avg_pool, _id_sql(f"{_pool_y('avg')}, f AS (SELECT * FROM y)", _IDX))


# Vectors as a batch that grows with the data -----------------------------------------------------------------------------------


def _batch(spark, sf_dir):
    """(i0 = vector, i1 = 0, i2 = position, v) and its shape."""
    x = T.embeddings(spark, sf_dir).select("i0", F.lit(0).cast("long").alias("i1"), F.col("i1").alias("i2"), "v")
    return x, (vectors(spark, sf_dir), 1, WIDTH)


def _batch_conv(spark, sf_dir):
    x, shape = _batch(spark, sf_dir)
    return rounded(C.conv(x, T.kernel(spark, 2, 1, (3,)), _conv_bias(spark, 2), windows(shape, 3, 1, 1), 2))


def _batch_pool(kind):
    def query(spark, sf_dir):
        x, shape = _batch(spark, sf_dir)
        return rounded(kind(x, windows(shape, 4, 2)))

    return query


def _batch_up(spark, sf_dir):
    x, shape = _batch(spark, sf_dir)
    return rounded(U.upsample(x, shape, scale_factor=2))


_BX = f"{X}, b AS (SELECT i0, CAST(0 AS BIGINT) AS i1, i1 AS i2, v FROM x)"
add("conv1d_batch", _batch_conv, f"""
WITH {_BX}, {_kernel_sql(2, 1, (3,))}, o AS (SELECT n.i0, o.o FROM (SELECT DISTINCT i0 FROM x) n, range({WIDTH}) o(o))
SELECT o.i0, k.co AS i1, o.o AS i2, round(sum(coalesce(b.v, 0) * k.w) + k.co / 4.0, 6) + 0.0 AS v FROM o CROSS JOIN k LEFT JOIN b ON b.i0 = o.i0 AND b.i2 = o.o + k.t2 - 1 GROUP BY o.i0, k.co, o.o
""")
for _k, _f, _v in (("max", K.max_pool, "max(b.v)"), ("avg", K.avg_pool, "sum(b.v) / 4")):
    add(f"{_k}_pool1d_batch", _batch_pool(_f), f"WITH {_BX} SELECT b.i0, b.i1, o.o AS i2, round({_v}, 6) + 0.0 AS v FROM b, range({(WIDTH - 4) // 2 + 1}) o(o) WHERE b.i2 BETWEEN o.o * 2 AND o.o * 2 + 3 GROUP BY b.i0, b.i1, o.o")
add("upsample_batch", _batch_up, f"WITH {_BX}, {_table_sql('t2', WIDTH, 2 * WIDTH, 'linear', scale=2)} SELECT b.i0, b.i1, t2.j AS i2, round(sum(b.v * t2.w), 6) + 0.0 AS v FROM b JOIN t2 ON t2.i = b.i2 GROUP BY b.i0, b.i1, t2.j")

# Algebra of teams, boxes and indices: values on the driver, as tables ------------------------------------------------------------


def _teams(spark, sf_dir):
    """Members of teams made from others, in order: chosen places, unions, grids; and whether teams are equal."""
    a, b = Partition((4, 5, 6, 7, 8, 9)), Partition((2, 4, 11, 9))
    made = {"inclusive": a.inclusive((3, 0, 4)), "union": a.union(b), "union_back": b.union(a), "cartesian": a.cartesian((2, 3)), "none": a.inclusive(()), "equal": Partition((int(a.union(a) == a), int(a == b), int(a.inclusive(range(6)) == a) + 1))}
    return spark.createDataFrame([(name, k, r) for name, p in made.items() for k, r in enumerate(p.ranks)], "made string, place long, rank long")


add("team_algebra", _teams, """
WITH a AS (SELECT r - 4 AS k, r FROM range(4, 10) t(r)), b AS (SELECT * FROM (VALUES (0, 2), (1, 4), (2, 11), (3, 9)) t(k, r)),
ab AS (SELECT k, r FROM a UNION ALL SELECT 6 + row_number() OVER (ORDER BY k) - 1, r FROM b WHERE r NOT IN (SELECT r FROM a)),
ba AS (SELECT k, r FROM b UNION ALL SELECT 4 + row_number() OVER (ORDER BY k) - 1, r FROM a WHERE r NOT IN (SELECT r FROM b)),
m AS (
  SELECT 'inclusive' AS made, c.place, a.r FROM (VALUES (0, 3), (1, 0), (2, 4)) c(place, k) JOIN a ON a.k = c.k
  UNION ALL SELECT 'union', k, r FROM ab UNION ALL SELECT 'union_back', k, r FROM ba UNION ALL SELECT 'cartesian', k, r FROM a
  UNION ALL SELECT 'equal', * FROM (VALUES (0, 1), (1, 0), (2, 2)) t(k, r)
)
SELECT made, CAST(place AS BIGINT) AS place, CAST(r AS BIGINT) AS rank FROM m
""")


def _grid_index(spark, sf_dir):
    """Coordinates and place of each member of a grid whose ranks are no range, and the place that the coordinates lead back to."""
    p = CartesianPartition((7, 3, 9, 1, 5, 2), (3, 2))
    return spark.createDataFrame([(p.ranks[k], *p.index(k), p.place(p.index(k))) for k in range(p.size)], "rank long, k0 long, k1 long, place long")


add("grid_index", _grid_index, "SELECT CAST(r AS BIGINT) AS rank, CAST(k // 2 AS BIGINT) AS k0, CAST(k % 2 AS BIGINT) AS k1, CAST(k AS BIGINT) AS place FROM (VALUES (0, 7), (1, 3), (2, 9), (3, 1), (4, 5), (5, 2)) t(k, r)")


def _boxes(spark, sf_dir):
    """What each block of one grid shares with each of another: from the start of the tensor, and from the start of either block."""
    shape, p, q = (vectors(spark, sf_dir), WIDTH), (4, 3), (3, 5)
    rows = []
    for r in range_index(p):
        for s in range_index(q):
            boxes = (start_index(p, r, shape), stop_index(p, r, shape), start_index(q, s, shape), stop_index(q, s, shape))
            start, stop, extent = intersection(*boxes)
            here, there = partition_intersection(p, r, q, s, shape), partition_intersection(q, s, p, r, shape)
            if here is None:
                rows.append((*r, *s, -1, -1, -1, -1, *extent, 0))
                continue
            assert slice_shape(here) == slice_shape(assemble_slices(start, stop)) == extent
            rows.append((*r, *s, here[0].start, here[1].start, there[0].start, there[1].start, *slice_shape(here), slice_volume(here)))
    return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ("r0", "r1", "s0", "s1", "in_r0", "in_r1", "in_s0", "in_s1", "n0", "n1", "cells")))


add("box_intersections", _boxes, f"""
WITH b AS (
  SELECT a.k AS r0, b.k AS r1, c.k AS s0, d.k AS s1,
         {start("a.k", NX, 4)} AS a0, {start("a.k + 1", NX, 4)} AS z0, {start("b.k", WIDTH, 3)} AS a1, {start("b.k + 1", WIDTH, 3)} AS z1,
         {start("c.k", NX, 3)} AS c0, {start("c.k + 1", NX, 3)} AS y0, {start("d.k", WIDTH, 5)} AS c1, {start("d.k + 1", WIDTH, 5)} AS y1
  FROM range(4) a(k), range(3) b(k), range(3) c(k), range(5) d(k)
), n AS (SELECT *, greatest(0, least(z0, y0) - greatest(a0, c0)) AS n0, greatest(0, least(z1, y1) - greatest(a1, c1)) AS n1 FROM b)
SELECT r0, r1, s0, s1, CASE WHEN n0 * n1 > 0 THEN greatest(a0, c0) - a0 ELSE -1 END AS in_r0, CASE WHEN n0 * n1 > 0 THEN greatest(a1, c1) - a1 ELSE -1 END AS in_r1,
       CASE WHEN n0 * n1 > 0 THEN greatest(a0, c0) - c0 ELSE -1 END AS in_s0, CASE WHEN n0 * n1 > 0 THEN greatest(a1, c1) - c1 ELSE -1 END AS in_s1, n0, n1, n0 * n1 AS cells
FROM n
""")


def _cells_of_box(spark, sf_dir):
    """Cells of a block's slices, by a predicate on the index that reaches the scan."""
    shape = (vectors(spark, sf_dir), WIDTH)
    box = assemble_slices(start_index((5, 4), (2, 1), shape), stop_index((5, 4), (2, 1), shape))
    return rounded(T.embeddings(spark, sf_dir).where(between([F.col("i0"), F.col("i1")], box)))


add("block_cells", _cells_of_box, f"WITH {X} SELECT i0, i1, round(v, 6) + 0.0 AS v FROM x WHERE i0 >= {start('2', NX, 5)} AND i0 < {start('3', NX, 5)} AND i1 >= {start('1', WIDTH, 4)} AND i1 < {start('2', WIDTH, 4)}")


def _filtered(spark, sf_dir):
    """The indices of a shape that agree with one of them in some dimensions, or in all others, and their ranks."""
    shape, at, ranks = (3, 4, 5), (2, 1, 3), worker_layout((3, 4, 5))
    rows = [(name, *i, ranks[i]) for name, fixed in (("in", index_filter(at, (0, 2))), ("not_in", index_filter(at, (0, 2), invert=True))) for i in filtered_range_index(shape, fixed)]
    return spark.createDataFrame(rows, "kind string, i0 long, i1 long, i2 long, rank long")


add("index_filters", _filtered, """
WITH i AS (SELECT a.k AS i0, b.k AS i1, c.k AS i2, (a.k * 4 + b.k) * 5 + c.k AS rank FROM range(3) a(k), range(4) b(k), range(5) c(k))
SELECT 'in' AS kind, * FROM i WHERE i0 = 2 AND i2 = 3 UNION ALL SELECT 'not_in', * FROM i WHERE i1 = 1
""")
add("zero_volume", lambda spark, d: zero_volume(spark, 3).groupBy().agg(F.count("*").alias("cells"), F.coalesce(F.max("i2") + 1, F.lit(0)).alias("extent")), "SELECT CAST(0 AS BIGINT) AS cells, CAST(0 AS BIGINT) AS extent")
add("element_types", lambda spark, d: spark.createDataFrame([(n, t.simpleString()) for n, t in DTYPES.items()], "name string, held_as string"), """
SELECT * FROM (VALUES ('bool', 'boolean'), ('uint8', 'smallint'), ('int8', 'tinyint'), ('int16', 'smallint'), ('int32', 'int'), ('int64', 'bigint'), ('float16', 'float'), ('float32', 'float'), ('float64', 'double'),
  ('complex64', 'struct<re:float,im:float>'), ('complex128', 'struct<re:double,im:double>')) t(name, held_as)
""")
add("transpose_alias", lambda spark, d: M.transpose(T.embeddings(spark, d), (vectors(spark, d), WIDTH), grid_of((4, 1)), grid_of((2, 2))).groupBy("rank").agg(F.count("*").alias("cells")), f"WITH {X} SELECT {rank(NX, (2, 2))} AS rank, count(*) AS cells FROM x GROUP BY 1")
