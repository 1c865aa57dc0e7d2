from itertools import product

import pytest
from pyspark.sql import functions as F

from cellweave.functions import index as I
from cellweave.operators import conv as C
from cellweave.operators import move as M
from cellweave.plans.geometry import halos, windows
from cellweave.plans.partition import CartesianPartition, Partition, axes_to_reduce, check_repartition, grid_of, reduction, replication
from cellweave.schema import TensorSchema, fill, grid, infer_schema, zero_volume


def test_blocks_cover_every_extent():
    for n, p in product(range(40), range(1, 12)):
        owners = [k for k in range(p) for _ in range(I.block_size(n, p, k))]
        assert len(owners) == n
        assert [I.block_start(n, p, k) for k in range(p)] == [sum(I.block_size(n, p, j) for j in range(k)) for k in range(p)]


def test_owner_column(spark):
    cases = [(n, p) for n in (1, 5, 7, 12, 55, 77) for p in (1, 2, 3, 4, 7, 13)]
    rows = spark.range(77).select("id", *(I.owner(F.col("id"), n, p).alias(f"c{j}") for j, (n, p) in enumerate(cases))).collect()
    for j, (n, p) in enumerate(cases):
        for r in rows[:n]:
            assert I.block_start(n, p, r[f"c{j}"]) <= r["id"] < I.block_stop(n, p, r[f"c{j}"])


def test_owner_of_unbalanced_blocks(spark):
    got = [r[0] for r in spark.range(10).orderBy("id").select(I.owner_unbalanced(F.col("id"), (2, 0, 5, 3))).collect()]
    assert got == [0, 0, 2, 2, 2, 2, 2, 3, 3, 3]


def test_intersections():
    assert I.intersection_slice((0, 0), (4, 4), (2, 3), (9, 9)) == (slice(2, 4), slice(3, 4))
    assert I.intersection_slice((0,), (2,), (2,), (4,)) is None
    assert I.intersection((0,), (3,), (5,), (7,))[2] == (0,)
    with pytest.raises(ValueError):
        I.intersection_slice(((0, 1),), ((2, 3),), (1,), (2,))
    assert I.slice_volume(I.assemble_slices((1, 2), (4, 4))) == 6
    # [4,1] against [2,2] on 7 x 5: block 1 is rows 2-3, and worker (0,0) holds rows 0-3 of columns 0-2
    assert I.partition_intersection((4, 1), (1, 0), (2, 2), (0, 0), (7, 5)) == (slice(0, 2), slice(0, 3))


def test_index_filters():
    fixed = I.index_filter((1, 2), (0,))
    assert fixed == (1, None) and list(I.filtered_range_index((2, 3), fixed)) == [(1, 0), (1, 1), (1, 2)]
    assert I.index_filter((1, 2), (0,), invert=True) == (None, 2)
    assert I.worker_layout((2, 3))[(1, 0)] == 3


def test_flat_orders(spark):
    r = spark.range(1).select(I.flat_c([F.lit(1), F.lit(2)], (3, 4)).alias("c"), I.flat_f([F.lit(1), F.lit(2)], (3, 4)).alias("f")).first()
    assert (r["c"], r["f"]) == (6, 7)


def test_partitions():
    p = Partition((3, 5, 7, 9))
    assert p.inclusive((2, 0)).ranks == (7, 3) and p.union(Partition((5, 1))).ranks == (3, 5, 7, 9, 1)
    g = p.cartesian((2, 2))
    assert g.index(2) == (1, 0) and g.neighbours(0) == [(None, 2), (None, 1)] and g.neighbours(3) == [(1, None), (2, None)]
    assert [q.ranks for q in g.lines((False, True))] == [(3, 5), (7, 9)] and g.line_through(3, (True, False)).ranks == (5, 9)
    assert not Partition().active and Partition((1, 2)) == Partition((1, 2))
    for bad in (lambda: p.cartesian((3,)), lambda: g.index(4), lambda: Partition((1, 1)), lambda: g.lines((True,))):
        with pytest.raises(ValueError):
            bad()


def test_broadcast_rules():
    assert replication(grid_of((1,)), grid_of((2, 3))) == [(0, k) for k in range(6)]
    assert replication(grid_of((3, 1)), grid_of((3, 4))) == [(k // 4, k) for k in range(12)]
    assert replication(grid_of((1, 3)), grid_of((3, 4)), transpose_src=True) == [(k // 4, k) for k in range(12)]
    assert replication(grid_of((4, 1)), grid_of((3, 4)), transpose_dest=True) == [(k % 4, k) for k in range(12)]
    assert replication(grid_of((2, 2, 1)), grid_of((3, 2, 2)), transpose_src=True) == [(k % 4, k) for k in range(12)]
    for a, b in (((1, 1, 3), (3, 3, 2)), ((1, 3), (3, 1)), ((2, 2), (2,))):
        with pytest.raises(ValueError):
            replication(grid_of(a), grid_of(b))
    assert reduction(grid_of((2, 3)), grid_of((2, 1))) == [(k, k // 3) for k in range(6)]
    with pytest.raises(ValueError):
        reduction(grid_of((2,)), grid_of((2, 2)))


def test_axes_and_repartition_errors():
    g = grid_of((2, 3))
    assert axes_to_reduce(g, axes_keep=(0,)) == (1,) == axes_to_reduce(g, axes_reduce=(1,))
    for kw in ({}, {"axes_reduce": (0,), "axes_keep": (1,)}, {"axes_reduce": (2,)}):
        with pytest.raises(ValueError):
            axes_to_reduce(g, **kw)
    for a, b, shape in (((1, 4, 1, 1), (1, 2), (1, 16, 5, 5)), ((1, 4, 1, 1), (1, 2, 1, 2), (16, 5, 5)), ((1, 4, 1, 1), (1, 2, 1, 2), (1, 16, 5, 1))):
        with pytest.raises(ValueError):
            check_repartition(grid_of(a), grid_of(b), shape)


def test_golden_halos():
    got = {h.place: (h.left, h.right, h.send_left, h.send_right, h.needed_start, h.needed_stop) for h in halos(grid_of((1, 1, 4)), windows((1, 1, 10), 2, 2)) if h.dim == 2}
    assert got == {0: (0, 1, 0, 0, 0, 4), 1: (0, 0, 1, 0, 1, 3), 2: (0, 0, 0, 0, 0, 2), 3: (0, 0, 0, 0, 0, 2)}


def test_conv_layouts():
    g = grid_of
    assert C.layout(g((1, 1, 2, 2))) == "feature"
    assert C.layout(g((1, 2, 1)), g((1, 3, 1)), g((3, 2, 1))) == "channel"
    assert C.layout(g((1, 2, 2)), g((1, 2, 2)), g((2, 2, 2))) == "general"
    for bad in ((g((1, 2, 1)), None, g((3, 2, 1))), (g((1, 2, 1)), g((1, 3, 1)), g((2, 2, 1))), (g((1, 2, 2)), g((1, 3, 1)), g((3, 2, 2))), (g((1, 2, 2)),)):
        with pytest.raises(ValueError):
            C.layout(*bad)


def test_schema(spark):
    cells = grid(spark, (3, 4)).withColumn("v", F.lit(1.0))
    assert infer_schema(cells, 2) == TensorSchema((3, 4)) and TensorSchema((3, 4)) != TensorSchema((3, 4), "float32")
    assert zero_volume(spark, 2).count() == 0 and infer_schema(zero_volume(spark, 2), 2).shape == (0, 0)
    assert fill(cells.where("i0 = 1"), (3, 4), ["i0", "i1"]).agg(F.count("*"), F.sum("v")).first()[:] == (12, 4.0)
    with pytest.raises(ValueError):
        TensorSchema((1,), "quaternion")


def test_examples_with_known_results(spark):
    """7 x 5 values by owner, moved from [4,1] to [2,2]; 6 x 6 over [2,3] summed along rows and columns."""
    x = M.place(grid(spark, (7, 5)), (7, 5), grid_of((4, 1))).withColumn("v", F.col("rank") + 1.0)
    y = M.repartition(x, (7, 5), grid_of((4, 1)), grid_of((2, 2)))
    assert y.rdd.getNumPartitions() == 4
    inside = y.withColumn("p", F.spark_partition_id()).where(F.col("p") != F.col("rank")).count()
    assert inside == 0
    assert {r["rank"]: (r["n"], r["s"]) for r in y.groupBy("rank").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()} == {0: (12, 18.0), 1: (8, 12.0), 2: (9, 30.0), 3: (6, 20.0)}
    g = grid_of((2, 3))
    b = spark.createDataFrame([(k, i, float(k + 1)) for k in range(6) for i in range(4)], "rank long, l0 long, v double")
    got = lambda **kw: sorted({(r["rank"], r["v"]) for r in M.all_reduce(b, g, **kw).collect()})
    assert [v for _, v in got(axes_reduce=(1,))] == [6.0] * 3 + [15.0] * 3
    assert [v for _, v in got(axes_keep=(1,))] == [5.0, 7.0, 9.0] * 2
    assert {v for _, v in got(axes_reduce=(0, 1))} == {21.0}
    assert [v for _, v in got(axes_reduce=())] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    with pytest.raises(ValueError):
        M.all_reduce(b, g, axes_reduce=(0,), op="mean")


def test_idle_and_disjoint_ranks(spark):
    p = CartesianPartition(tuple(range(5, 17)), (3, 4))
    y = M.repartition(grid(spark, (77, 55)).withColumn("v", F.lit(1.0)), (77, 55), grid_of((4, 1)), p, move=False)
    assert y.select("rank").distinct().count() == 12 and y.agg(F.min("rank")).first()[0] == 5
    odd = CartesianPartition((9, 2, 7, 4), (2, 2))
    assert {r[0] for r in M.place(grid(spark, (4, 4)), (4, 4), odd).select("rank").distinct().collect()} == {9, 2, 7, 4}
    with pytest.raises(ValueError):
        M.place(grid(spark, (4, 4)), (4, 4), odd, ((1, 1), (2, 2)))


@pytest.mark.parametrize("dtype", ["float", "int", "double"])
def test_types_are_kept(spark, dtype):
    x = grid(spark, (8, 3)).withColumn("v", F.col("i0").cast(dtype))
    assert dict(M.repartition(x, (8, 3), grid_of((2, 1)), grid_of((2, 3))).dtypes)["v"] == dtype
    p = M.place(x, (8, 3), grid_of((2, 1)))
    assert dict(M.broadcast(p, grid_of((2, 1)), grid_of((2, 2))).dtypes)["v"] == dtype


def test_nothing_moves_onto_the_same_grid(spark):
    x = M.place(grid(spark, (4, 4)).withColumn("v", F.lit(1.0)), (4, 4), grid_of((2, 2)))
    g = grid_of((2, 2))
    assert M.broadcast(x, g, g) is x and M.sum_reduce(x, g, g) is x and M.broadcast_adjoint(x, g, g) is x


def test_team_operators(spark):
    from cellweave.operators import team as W

    p = CartesianPartition((3, 5, 7, 9), (2, 2))
    got = {r["rank"]: r for r in W.worker_grid(spark, p).collect()}
    for k, rank in enumerate(p.ranks):
        near = [None if n is None else p.ranks[n] for pair in p.neighbours(k) for n in pair]
        assert (got[rank]["k0"], got[rank]["k1"]) == p.index(k) and [got[rank][c] for c in ("left0", "right0", "left1", "right1")] == near
    lines = {}
    for r in W.sub_grids(spark, p, (False, True)).orderBy("place").collect():
        lines.setdefault(r["line"], []).append(r["rank"])
    assert [tuple(v) for _, v in sorted(lines.items())] == [q.ranks for q in p.lines((False, True))]
    v = spark.createDataFrame([(5, [1, 2]), (3, [4, 8])], "rank long, data array<long>")
    assert {r["rank"]: r["gathered"] for r in W.all_gather(v).collect()} == {3: [[4, 8], [1, 2]], 5: [[4, 8], [1, 2]]}
    assert {op: [r["v"] for r in W.all_reduce_vectors(v, op).orderBy("position").collect()] for op in ("sum", "prod", "min", "max")} == {"sum": [5, 10], "prod": [4, 16], "min": [1, 2], "max": [4, 8]}
    assert {r["rank"]: r["data"] for r in W.broadcast_vector(v, 3, (3, 8)).collect()} == {3: [4, 8], 8: [4, 8]}
    for bad in (lambda: W.broadcast_vector(v, 3, (5,)), lambda: W.all_reduce_vectors(v, "mean"), lambda: W.sub_grids(spark, p, (True,))):
        with pytest.raises(ValueError):
            bad()


def test_halos_beyond_the_next_block(spark):

    x = spark.range(10).selectExpr("cast(0 as bigint) i0", "cast(0 as bigint) i1", "id i2", "1.0D v")
    with pytest.raises(ValueError, match="beyond the next block"):
        M.halo_exchange(x, windows((1, 1, 10), 7, 1, 3), grid_of((1, 1, 5)))
    assert M.halo_exchange(x, windows((1, 1, 10), 5, 1, 2), grid_of((1, 1, 5))).where("ghost").count() == 16


def test_former_name_of_repartition(spark):

    x = spark.range(6).selectExpr("id i0", "cast(0 as bigint) i1", "1.0D v")
    with pytest.warns(DeprecationWarning, match="repartition"):
        old = M.transpose(x, (6, 1), grid_of((3, 1)), grid_of((2, 1)))
    assert sorted(old.collect()) == sorted(M.repartition(x, (6, 1), grid_of((3, 1)), grid_of((2, 1))).collect())


def test_values_are_printed_in_order_of_rank(spark, capsys):
    from cellweave.operators import team as W

    W.print_sequential(spark.createDataFrame([(2, "c"), (0, "a"), (1, "b")], "rank long, value string").repartition(3))
    assert capsys.readouterr().out.splitlines() == ["rank = 0, value = a", "rank = 1, value = b", "rank = 2, value = c"]
