"""Data movement between worker grids, each operator with its adjoint.

Cells that workers hold are rows (rank, local indices, v); cells of a global tensor are rows (i0.., v).  The adjoint of copying is summing
and the other way round.  Nothing is moved where both grids are the same.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.index import block_size, block_start, block_stop, flat_c, owner, owner_unbalanced, rank_column, start_column
from cellweave.plans.geometry import Window as Slide
from cellweave.plans.partition import CartesianPartition, axes_to_reduce, check_repartition, reduction, replication
from cellweave.schema import index_columns, known_small


def _local(x: DataFrame) -> list[str]:
    return [c for c in x.columns if c not in ("rank", "v")]


def _pairs(x: DataFrame, pairs: list[tuple[int, int]], source: CartesianPartition, dest: CartesianPartition) -> DataFrame:
    table = x.sparkSession.createDataFrame([(source.ranks[s], dest.ranks[d]) for s, d in pairs], "src long, dst long")
    return known_small(table, len(pairs))


def _copy(x: DataFrame, pairs: DataFrame, come_from: str, go_to: str) -> DataFrame:
    return x.join(pairs, x["rank"] == pairs[come_from]).select(F.col(go_to).alias("rank"), *_local(x), "v")


def _sum(x: DataFrame, pairs: DataFrame, come_from: str, go_to: str) -> DataFrame:
    return x.join(pairs, x["rank"] == pairs[come_from]).groupBy(F.col(go_to).alias("rank"), *_local(x)).agg(F.sum("v").alias("v"))


def broadcast(x: DataFrame, p_x: CartesianPartition, p_y: CartesianPartition, transpose_src: bool = False, transpose_dest: bool = False) -> DataFrame:
    """Every destination worker gets the cells of its one source."""
    pairs = replication(p_x, p_y, transpose_src, transpose_dest)
    return x if p_x == p_y and all(a == b for a, b in pairs) else _copy(x, _pairs(x, pairs, p_x, p_y), "src", "dst")


def broadcast_adjoint(dy: DataFrame, p_x: CartesianPartition, p_y: CartesianPartition, transpose_src: bool = False, transpose_dest: bool = False) -> DataFrame:
    """Gradients of all copies are summed at the source."""
    pairs = replication(p_x, p_y, transpose_src, transpose_dest)
    return dy if p_x == p_y and all(a == b for a, b in pairs) else _sum(dy, _pairs(dy, pairs, p_x, p_y), "dst", "src")


def sum_reduce(x: DataFrame, p_x: CartesianPartition, p_y: CartesianPartition, transpose_src: bool = False, transpose_dest: bool = False) -> DataFrame:
    """Cells of all sources of a destination are summed there."""
    pairs = reduction(p_x, p_y, transpose_src, transpose_dest)
    return x if p_x == p_y and all(a == b for a, b in pairs) else _sum(x, _pairs(x, pairs, p_x, p_y), "src", "dst")


def sum_reduce_adjoint(dy: DataFrame, p_x: CartesianPartition, p_y: CartesianPartition, transpose_src: bool = False, transpose_dest: bool = False) -> DataFrame:
    """Every source gets its destination's gradient."""
    pairs = reduction(p_x, p_y, transpose_src, transpose_dest)
    return dy if p_x == p_y and all(a == b for a, b in pairs) else _copy(dy, _pairs(dy, pairs, p_x, p_y), "dst", "src")


REDUCERS = {"sum": F.sum, "prod": F.product, "min": F.min, "max": F.max}


def all_reduce(x: DataFrame, p: CartesianPartition, axes_reduce: Sequence[int] | None = None, axes_keep: Sequence[int] | None = None, op: str = "sum") -> DataFrame:
    """Cells are combined along worker axes and every contributor gets the result; with op="sum" the operator is its own adjoint."""
    axes = axes_to_reduce(p, axes_reduce, axes_keep)
    if op not in REDUCERS:
        raise ValueError(f"no reduction {op}")
    if not axes:
        return x
    kept = [d for d in range(p.dim) if d not in axes]
    places = [(p.ranks[k], *(p.index(k)[d] for d in kept)) for k in range(p.size)]
    table = x.sparkSession.createDataFrame(places, ", ".join(["_rank long", *(f"_k{d} long" for d in kept)]))
    located = x.join(known_small(table, p.size), x["rank"] == table["_rank"])
    over = Window.partitionBy(*(f"_k{d}" for d in kept), *_local(x))
    return located.select("rank", *_local(x), REDUCERS[op]("v").over(over).alias("v"))


def place(cells: DataFrame, shape: Sequence[int], p: CartesianPartition, sizes: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """Cells with the rank of their owner: balanced blocks, or blocks of the given sizes in each dimension."""
    index = [F.col(c) for c in index_columns(len(shape))]
    if sizes is None:
        at = rank_column(index, shape, p.shape)
    else:
        if any(sum(s) != n or len(s) != q for s, n, q in zip(sizes, shape, p.shape, strict=True)):
            raise ValueError("block sizes do not cover the tensor")
        at = flat_c([owner_unbalanced(i, s) for i, s in zip(index, sizes, strict=True)], p.shape)
    return cells.withColumn("rank", _rank_of_place(at, p))


def _rank_of_place(at, p: CartesianPartition):
    first = p.ranks[0]
    if p.ranks == tuple(range(first, first + p.size)):
        return (at + first).cast("long")
    return F.element_at(F.array(*(F.lit(r).cast("long") for r in p.ranks)), (at + 1).cast("int"))


def repartition(cells: DataFrame, shape: Sequence[int], p_x: CartesianPartition, p_y: CartesianPartition, move: bool = True) -> DataFrame:
    """Cells with their owner in the grid p_y, values unchanged.  With move, rank k's cells are Spark partition k.

    The owner is computed from the index, so it does not matter how p_x had split the cells, balanced or not.
    """
    check_repartition(p_x, p_y, shape)
    out = place(cells.drop("rank"), shape, p_y)
    return out.repartitionById(max(p_y.ranks) + 1, F.col("rank").cast("int")) if move else out


def repartition_adjoint(dy: DataFrame, shape: Sequence[int], p_x: CartesianPartition, p_y: CartesianPartition, move: bool = True) -> DataFrame:
    """Gradients go back to the owners in p_x."""
    return repartition(dy, shape, p_y, p_x, move)


def transpose(cells: DataFrame, shape: Sequence[int], p_x: CartesianPartition, p_y: CartesianPartition, move: bool = True) -> DataFrame:
    """The former name of repartition()."""
    warnings.warn("transpose() is now repartition()", DeprecationWarning, stacklevel=2)
    return repartition(cells, shape, p_x, p_y, move)


def overlaps(spark, shape: Sequence[int], p_x: CartesianPartition, p_y: CartesianPartition) -> DataFrame:
    """(src, dst, cells): how many cells each worker of p_x sends to each of p_y, from block bounds alone; empty overlaps are left out."""
    check_repartition(p_x, p_y, shape)
    names = index_columns(len(shape))
    per_dim = []
    for n, a, b in zip(shape, p_x.shape, p_y.shape, strict=True):
        # Block bounds of both grids cut the extent into at most a + b - 1 runs, each with one owner on either side.
        cuts = sorted({block_start(n, a, k) for k in range(a)} | {block_start(n, b, k) for k in range(b)} | {n})
        per_dim.append([(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False) if hi > lo])
    out = spark.range(1).select(F.lit(1).cast("long").alias("cells"))
    for name, runs in zip(names, per_dim, strict=True):
        table = F.array(*(F.struct(F.lit(lo).cast("long").alias("at"), F.lit(n).cast("long").alias("n")) for lo, n in runs))
        out = out.withColumn("_r", F.explode(table)).withColumn(name, F.col("_r.at")).withColumn("cells", F.col("cells") * F.col("_r.n")).drop("_r")
    index = [F.col(c) for c in names]
    src, dst = (_rank_of_place(rank_column(index, shape, p.shape), p) for p in (p_x, p_y))
    return out.groupBy(src.alias("src"), dst.alias("dst")).agg(F.sum("cells").alias("cells"))


def halo_exchange(cells: DataFrame, wins: Sequence[Slide], p: CartesianPartition) -> DataFrame:
    """(rank, i0.., v, ghost): every worker's own cells, and copies of those of its neighbours that its windows reach.

    Owners are computed per dimension and combined, so corners come out right, and a cell is copied without a range join.  Halos reach at most
    the next block, as in an exchange between neighbours; ValueError if one would reach further.
    """
    names = index_columns(len(wins))
    for d, (w, q) in enumerate(zip(wins, p.shape, strict=True)):
        for k in range(q):
            left, right = w.reaches(q, k)
            if (k > 0 and left > block_size(w.n, q, k - 1)) or (k < q - 1 and right > block_size(w.n, q, k + 1)):
                raise ValueError(f"the halo of worker {k} in dimension {d} reaches beyond the next block")
    out, own = cells.select(*names, "v"), []
    for d, (w, q) in enumerate(zip(wins, p.shape, strict=True)):
        i, k = F.col(names[d]), owner(F.col(names[d]), w.n, q)
        own.append(k)
        out = out.withColumn(f"_o{d}", F.explode(_holders(i, k, w, q)))
    here = flat_c([F.col(f"_o{d}") for d in range(len(wins))], p.shape)
    ghost = F.lit(False)
    for d, k in enumerate(own):
        ghost = ghost | (F.col(f"_o{d}") != k)
    return out.select(_rank_of_place(here, p).alias("rank"), *names, "v", ghost.alias("ghost"))


def _holders(i, k, w: Slide, q: int):
    """The owner of index i, and its neighbours whose halo holds i."""
    lefts = [max(0, w.reaches(q, j)[0]) for j in range(q)]
    rights = [max(0, w.reaches(q, j)[1]) for j in range(q)]
    width = lambda table, j: F.element_at(F.array(*(F.lit(t).cast("long") for t in table)), (j + 1).cast("int"))
    start = start_column(w.n, q, k)
    stop = start_column(w.n, q, k + 1)
    right = F.when((k < q - 1) & (i >= stop - width(lefts, F.least(k + 1, F.lit(q - 1)))), k + 1)
    left = F.when((k > 0) & (i < start + width(rights, F.greatest(k - 1, F.lit(0)))), k - 1)
    return F.array_compact(F.array(k, left, right))


def halo_exchange_adjoint(dy: DataFrame, wins: Sequence[Slide], p: CartesianPartition) -> DataFrame:
    """(rank, i0.., v): ghosts' gradients are added to the owner's cell; the ghosts themselves become zero and are left out."""
    names = index_columns(len(wins))
    summed = dy.groupBy(*names).agg(F.sum("v").alias("v"))
    return place(summed, [w.n for w in wins], p).select("rank", *names, "v")


def block_bounds(spark, shape: Sequence[int], p: CartesianPartition) -> DataFrame:
    """(rank, start0, size0, stop0, ..): the balanced blocks of a grid, from column arithmetic."""
    from cellweave.functions.index import size_column
    from cellweave.schema import grid

    names = [f"k{d}" for d in range(p.dim)]
    out = grid(spark, p.shape, names)
    columns = [_rank_of_place(flat_c([F.col(n) for n in names], p.shape), p).alias("rank")]
    for d, (n, q) in enumerate(zip(shape, p.shape, strict=True)):
        k = F.col(names[d])
        columns += [start_column(n, q, k).cast("long").alias(f"start{d}"), size_column(n, q, k).cast("long").alias(f"size{d}"), start_column(n, q, k + 1).cast("long").alias(f"stop{d}")]
    return out.select(*columns)


def unbalanced_bounds(blocks: DataFrame, dim: int) -> DataFrame:
    """(k0.., size0.., start0.., stop0..) from the sizes of a grid's blocks: running sums along each dimension."""
    names = [f"k{d}" for d in range(dim)]
    out = blocks
    for d in range(dim):
        along = Window.partitionBy(*(n for n in names if n != names[d])).orderBy(names[d])
        out = out.withColumn(f"stop{d}", F.sum(f"size{d}").over(along))
        out = out.withColumn(f"start{d}", F.coalesce(F.lag(f"stop{d}").over(along), F.lit(0).cast("long")))
    return out


def stops(n: int, p: int) -> list[int]:
    return [block_stop(n, p, k) for k in range(p)]
