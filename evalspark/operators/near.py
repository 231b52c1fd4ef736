"""Exact nearest-neighbour and near-pair search over unit vectors.

The plan, after the ball trees and pivot-based joins of the literature:

1. the sources of a group are cut into cells level by level: an oversize cell
   gets pivots of its own, every vector goes to the nearest; a round of jobs
   cuts all oversize cells at once, until each fits a block of bounded size;
2. a target goes down the tree.  It first looks into its home leaf, the nearest
   at every level, which bounds how far an answer can be; then the triangle
   inequality on angles tells at each cell whether it can hold an answer, and
   all others are skipped, exactly;
3. the targets bound for a leaf are cut into shards of bounded size, so a leaf
   that a third of all targets look into becomes many equal tasks; a source is
   copied once for each shard of its own leaf, not once for each shard of all
   targets (``search_cost`` reports how often);
4. each (leaf block, target shard) task is one matrix product that emits one
   row per target, never a pair list.

Cells that pivots cannot cut, equal vectors above all, are cut into blocks by a
hash of their ids.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions.frames import attach
from ..session import materialize

FANOUT = 16  # pivots of a cell
LEVELS = 12  # of the tree at most; 16 ** 12 leaves
BLOCK_FLOATS = 2**20  # bound on the floats of a source block, and of a target shard
PRODUCT_CELLS = 2**22  # bound on the cells of one matrix product
FIRST_ROWS = 20_000  # of a group's first prefix, about
ANGLE_SLACK = 2e-3  # radians; covers rounding of 32-bit vectors in every bound
_ROOT = 1


def unit_vector(vec: str = "embedding") -> Column:
    """v / (‖v‖ + 1e-9) in 32-bit floats."""
    v = F.col(vec)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    scaled = F.transform(F.array(norm), lambda n: F.transform(v, lambda x: (x.cast("double") / (n + F.lit(1e-9))).cast("float")))
    return F.element_at(scaled, 1)


def _matrix(column) -> np.ndarray:
    """Arrow list column to a row-per-vector matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _products(targets, sources: np.ndarray):
    """Row slices of the targets with their cosines to all sources, a bounded product at a time."""
    mine = _matrix(targets)
    step = max(1, PRODUCT_CELLS // max(1, len(sources)))
    for i in range(0, len(mine), step):
        rows = slice(i, min(i + step, len(mine)))
        yield rows, mine[rows] @ sources.T


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


class Tree:
    """Sources placed in leaves: ``placed`` has ``node``, their leaf; ``levels`` the cells of each level with their pivots."""

    def __init__(self, placed: DataFrame, levels: list[DataFrame], rows: int):
        self.placed, self.levels, self.rows = placed, levels, rows


def _by_cell(batch: pa.RecordBatch, by: list[str]):
    """Places of the batch's rows by group and node."""
    groups: dict[tuple, list[int]] = {}
    for i, k in enumerate(zip(*[batch.column(c).to_pylist() for c in (*by, "node")])):
        groups.setdefault(k, []).append(i)
    return groups.items()


def _assign(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with ``_pivots`` to the cell of their nearest pivot; ``angle`` is how far that is."""
    kept, fanout = [c for c in rows.columns if c not in ("_pivots", "node", "angle")], FANOUT

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"))
            cell, angle = np.zeros(len(v), np.int64), np.zeros(len(v))
            for (*_, node), mine in _by_cell(b, by):
                a = _angles(v[mine], _matrix(b.column("_pivots")[mine[0]].values.field("v")))
                best = a.argmin(axis=1)
                cell[mine], angle[mine] = node * fanout + best, a[np.arange(len(best)), best]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(cell), pa.array(angle)], [*kept, "node", "angle"])

    fields = [rows.schema[c] for c in kept] + [StructField("node", LongType()), StructField("angle", DoubleType())]
    return rows.mapInArrow(run, StructType(fields))


def build_tree(sources: DataFrame, by: list[str]) -> Tree | None:
    """Cells of cells until each holds a block at most; None without sources."""
    some = sources.select("v").first()
    if some is None:
        return None
    block = max(1, BLOCK_FLOATS // max(1, len(some["v"])))
    placed = sources.withColumn("node", F.lit(_ROOT).cast("bigint")).withColumn("angle", F.lit(math.pi))
    levels: list[DataFrame] = []
    key = [*by, "node"]
    while len(levels) < LEVELS:
        # a zero vector is as far from everything as anything: it cuts no cell
        real = F.exists("v", lambda x: x != 0)
        sizes = placed.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.when(real, F.col("angle"))).alias("far"))
        # a cell of one direction cannot be cut
        big = materialize(sizes.where((F.col("n") > block) & (F.col("far") > ANGLE_SLACK)).select(*key), "oversize")
        if big.isEmpty():
            break
        own = placed.join(big, key, "left_semi")
        nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("id", F.lit(len(levels))), "id"))
        picked = own.select(*key, "id", "v", nth.alias("_nth")).where(F.col("_nth") < FANOUT)
        # the farthest vector is a pivot too, so that a cell of copies and a few others is cut
        last = own.where(real).groupBy(*key).agg(F.max_by(F.struct("id", "v"), F.struct("angle", "id")).alias("_l"))
        picked = picked.unionByName(last.select(*key, "_l.id", "_l.v", F.lit(FANOUT).alias("_nth")))
        # FANOUT entries at most
        pivots = materialize(picked.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_nth", "id", "v"))).alias("_pivots")), "pivots")
        moved = materialize(_assign(own.join(pivots, key), by), f"level-{len(levels)}")
        placed = placed.join(big, key, "left_anti").unionByName(moved)
        parent = F.expr(f"node div {FANOUT}")
        cells = moved.groupBy(*key).agg(F.count("*").alias("n"), F.max("angle").alias("far"))
        names = pivots.withColumnRenamed("node", "_up").select(*by, "_up", F.posexplode("_pivots").alias("_i", "_p"))
        names = names.select(*by, (F.col("_up") * FANOUT + F.col("_i")).alias("node"), F.col("_p.id").alias("pivot"), F.col("_p.v").alias("v"))
        cells = cells.join(names, key).select(*by, parent.alias("node"), F.struct(F.col("node").alias("cell"), "pivot", "v", "n", "far").alias("_c"))
        levels.append(materialize(cells.groupBy(*key).agg(F.array_sort(F.collect_list("_c")).alias("_cells")), f"cells-{len(levels)}"))
    return Tree(placed.drop("angle"), levels, block)


def _step(rows: DataFrame, by: list[str], how: str, skip_self: bool) -> DataFrame:
    """Targets with ``_cells``, one level down: ``home`` to the nearest cell, else to all cells within ``bound``.

    On the way to the ``nearest`` source the bound shrinks, as a pivot is a
    source itself; of all ``near`` ones it stays.
    """
    kept = [c for c in rows.columns if c not in ("_cells", "node", "bound")]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v, ids = _matrix(b.column("v")), b.column("id").to_numpy()
            bound = b.column("bound").to_numpy(zero_copy_only=False).copy()
            out: list = [None] * len(ids)
            for _, mine in _by_cell(b, by):
                cells = b.column("_cells")[mine[0]].values
                names, far = cells.field("cell").to_numpy(), cells.field("far").to_numpy()
                a = _angles(v[mine], _matrix(cells.field("v")))
                if how != "near":
                    own = cells.field("pivot").to_numpy()[None, :] == ids[mine, None]
                    other = np.where(own & skip_self, np.inf, a)
                    bound[mine] = np.minimum(bound[mine], other.min(axis=1) + ANGLE_SLACK)
                reach = a == a.min(axis=1, keepdims=True) if how == "home" else a - far[None, :] <= bound[mine, None] + ANGLE_SLACK
                for i, row in zip(mine, reach):
                    out[i] = names[row][:1].tolist() if how == "home" else names[row].tolist()
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(out, pa.list_(pa.int64())), pa.array(bound)], [*kept, "_down", "bound"])

    fields = [rows.schema[c] for c in kept] + [StructField("_down", ArrayType(LongType())), StructField("bound", DoubleType())]
    return rows.mapInArrow(run, StructType(fields)).select(*kept, F.explode("_down").alias("node"), "bound")


def _descend(targets: DataFrame, tree: Tree, by: list[str], how: str, skip_self: bool = False) -> DataFrame:
    """Targets (by…, id, v, bound, …) with ``node``, the leaves that they have to look into."""
    rows, key = targets.withColumn("node", F.lit(_ROOT).cast("bigint")), [*by, "node"]
    order = rows.columns
    done: list[DataFrame] = []
    for k, cells in enumerate(tree.levels):
        # a cell that was not cut is a leaf
        done.append(rows.join(cells.select(*key), key, "left_anti").select(*order))
        rows = materialize(_step(rows.join(cells, key).select(*order, "_cells"), by, how, skip_self).select(*order), f"down-{k}")
    return reduce(DataFrame.unionByName, [*done, rows])


def _products_of(routed: DataFrame, tree: Tree, by: list[str], kernel, schema: str) -> DataFrame:
    """``kernel`` on every (target shard, leaf block) of targets with the leaf ``node`` that they look into."""
    plan, key = _plan(routed, tree, by), [*by, "node"]
    slot = lambda n: F.pmod(F.xxhash64("id"), F.greatest(n, F.lit(1))).cast("int")
    left = routed.join(plan, key).withColumn("shard", slot(F.col("shards")))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("shards", "blocks", "n", "t")
    right = tree.placed.join(plan, key).withColumn("block", slot(F.col("blocks")))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards", "blocks", "n", "t")
    keys = [*key, "block", "shard"]
    right = right.toDF(*right.columns)  # both sides may come from one table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, schema)


def _plan(routed: DataFrame, tree: Tree, by: list[str]) -> DataFrame:
    """Per leaf that targets look into: sources ``n``, targets ``t``, and into how many blocks and shards they are cut."""
    key = [*by, "node"]
    cut = lambda c: F.ceil(F.col(c) / tree.rows).cast("int")
    sizes = tree.placed.groupBy(*key).agg(F.count("*").alias("n"))
    load = routed.groupBy(*key).agg(F.count("*").alias("t"))
    return sizes.join(load, key).select(*key, "n", "t", cut("n").alias("blocks"), cut("t").alias("shards"))


def _routed(targets: DataFrame, tree: Tree, by: list[str], limit_angle: float) -> DataFrame:
    """Targets with every leaf that can hold a source within a fixed angle."""
    return _descend(targets.select(*by, "id", "v", F.lit(float(limit_angle)).alias("bound")), tree, by, "near")


def search_cost(targets: DataFrame, sources: DataFrame, by: list[str] | None = None, threshold: float = 0.92) -> DataFrame:
    """One row on a search for near pairs: pairs compared of all pairs in groups, and how often a source is copied at most and on average."""
    by = list(by or [])
    limit = math.acos(max(-1.0, min(1.0, threshold)))
    tree = build_tree(sources.select(*by, "id", "v"), by)
    schema = "n_leaves bigint, pairs double, compared double, share_skipped double, copies_max bigint, copies_mean double"
    if tree is None:
        return targets.sparkSession.createDataFrame([(0, 0.0, 0.0, 0.0, 0, 0.0)], schema)
    plan = _plan(_routed(targets, tree, by, limit), tree, by)
    n, t = (df.groupBy(*by).agg(F.count("*").cast("double").alias(c)) for df, c in ((sources, "n_all"), (targets, "t_all")))
    pairs = (attach(n, t, by)).agg(F.sum(F.col("n_all") * F.col("t_all")).alias("pairs"))
    got = plan.agg(
        F.count("*").alias("n_leaves"), F.coalesce(F.sum(F.col("n").cast("double") * F.col("t")), F.lit(0.0)).alias("compared"),
        F.max("shards").cast("bigint").alias("copies_max"), (F.sum(F.col("n").cast("double") * F.col("shards")) / F.sum("n")).alias("copies_mean"),
    )
    out = attach(got, pairs, [])
    return out.select("n_leaves", "pairs", "compared", (1 - F.col("compared") / F.col("pairs")).alias("share_skipped"), "copies_max", "copies_mean")


def _key_ddl(df: DataFrame, by: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)


def nearest(targets: DataFrame, sources: DataFrame, by: list[str] | None = None, skip_self: bool = False) -> DataFrame:
    """``(by…, id, nn_sim, nn_id)``: greatest cosine to a source of the group, least id on ties.

    Both sides are ``(by…, id bigint, v array<float>)``.  With ``skip_self`` a
    target ignores the source of its own id.
    """
    by = list(by or [])

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        mine, ids = left["id"].to_numpy(), right["id"].to_numpy()
        best, at = np.full(len(mine), -np.inf), np.zeros(len(mine), dtype=np.int64)
        if len(mine) and len(ids):
            order = np.argsort(ids)  # so that the first maximum is that of the least id
            ids = ids[order]
            for rows, sims in _products(left["v"], _matrix(right["v"])[order]):
                if skip_self:
                    sims[mine[rows, None] == ids[None, :]] = -np.inf
                top = sims.argmax(axis=1)
                best[rows], at[rows] = sims[np.arange(len(top)), top], ids[top]
        out = pa.table({**{c: left[c] for c in (*by, "id")}, "s": pa.array(best), "r": pa.array(at)})
        return out.filter(pa.array(np.isfinite(best)))

    schema = _key_ddl(targets, by) + "id bigint, s double, r bigint"
    cols = [*by, "id", "v"]
    tree = build_tree(sources.select(*cols), by)
    if tree is None:
        none = targets.sparkSession.createDataFrame([], _key_ddl(targets, by) + "id bigint, nn_sim double, nn_id bigint")
        return none
    start = targets.select(*cols, F.lit(math.pi).alias("bound"))
    home = _descend(start, tree, by, "home", skip_self)
    found = _products_of(home, tree, by, kernel, schema)
    if tree.levels:
        # the best of the home leaf bounds the rest of the search; of a leaf with copies of one vector each block gives its best
        found = materialize(found, "home")
        home = materialize(home.select(*by, "id", F.col("node").alias("home"), "bound"), "homes")
        best = found.groupBy(*by, "id").agg(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.max("s")))).alias("_a"))
        near = home.join(best, [*by, "id"], "left")
        near = near.select(*by, "id", "home", F.least("bound", F.coalesce("_a", F.lit(math.pi)) + F.lit(ANGLE_SLACK)).alias("bound"))
        rest = _descend(targets.select(*cols).join(near, [*by, "id"]).select(*cols, "home", "bound"), tree, by, "nearest", skip_self)
        rest = rest.where("node <> home").drop("home")
        found = found.unionByName(_products_of(materialize(rest, "routed"), tree, by, kernel, schema))
    best = found.groupBy(*by, "id").agg(F.max(F.struct("s", (-F.col("r")).alias("r"))).alias("b"))
    return best.select(*by, "id", F.col("b.s").alias("nn_sim"), (-F.col("b.r")).alias("nn_id"))


def earlier_neighbours(targets: DataFrame, sources: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """``(by…, id, near_kept, near_open)``: has the target a near source of smaller id, kept or open?

    Sources carry ``kept boolean``.  Only flags leave the tasks, so a group of
    near copies costs one row per target and block, not a row per pair.
    """

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        mine, ids = left["id"].to_numpy(), right["id"].to_numpy()
        flags = np.zeros((2, len(mine)), dtype=bool)
        if len(mine) and len(ids):
            kept = right["kept"].to_numpy().astype(bool)
            for rows, sims in _products(left["v"], _matrix(right["v"])):
                near = (sims >= threshold) & (ids[None, :] < mine[rows, None])
                flags[0, rows], flags[1, rows] = near[:, kept].any(axis=1), near[:, ~kept].any(axis=1)
        out = pa.table({**{c: left[c] for c in (*by, "id")}, "near_kept": pa.array(flags[0]), "near_open": pa.array(flags[1])})
        return out.filter(pa.array(flags.any(axis=0)))

    schema = _key_ddl(targets, by) + "id bigint, near_kept boolean, near_open boolean"
    limit = math.acos(max(-1.0, min(1.0, threshold)))
    tree = build_tree(sources.select(*by, "id", "v", "kept"), by)
    if tree is None:
        return targets.sparkSession.createDataFrame([], schema)
    routed = _routed(targets, tree, by, limit)
    found = _products_of(materialize(routed, "routed") if tree.levels else routed, tree, by, kernel, schema)
    return found.groupBy(*by, "id").agg(F.bool_or("near_kept").alias("near_kept"), F.bool_or("near_open").alias("near_open"))


def _prefix_cut(rest: DataFrame, by: list[str], size: int) -> DataFrame:
    """``(by…, _cut)``: an id up to which each group has about ``size`` rows.

    Any prefix gives the same greedy result, so a sketch is exact enough; its
    error scales with the rows it has seen, hence it is repeated on the prefix
    until that is small.
    """
    grid = F.array(*[F.lit(i / 1000.0) for i in range(1, 1001)])
    stage = rest.select(*by, "id")
    while True:
        stats = materialize(
            stage.groupBy(*by).agg(F.count("*").alias("n"), F.max("id").alias("top"), F.percentile_approx("id", grid, 10_000).alias("p")),
            "cuts",
        )
        slot = F.greatest(F.floor(F.lit(size) * 1000.0 / F.col("n")).cast("int"), F.lit(1))
        whole = F.col("n") <= size * 1.5
        cut = stats.select(*by, F.when(whole, F.col("top")).otherwise(F.get("p", F.least(slot, F.lit(1000)) - 1)).alias("_cut"))
        if stats.where(~whole).isEmpty():
            return cut
        stage = attach(stage, cut, by).where(F.col("id") <= F.col("_cut")).drop("_cut")


def greedy_keep(vectors: DataFrame, by: list[str] | None = None, threshold: float = 0.92, first: int | None = None) -> DataFrame:
    """``(by…, id)`` of what a pass in id order keeps: a vector stays iff no kept earlier one is near.

    The greedy result is the lexicographically first independent set of the
    near-pair graph.  Identical vectors are first reduced to their earliest
    id.  Then prefixes of doubling size are settled one by one, and the
    survivors of a prefix at once clear the rest of the table: a large family
    of near copies is cut down by its first survivor instead of being compared
    with itself.  Each prefix is settled in rounds.
    """
    by = list(by or [])
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    if threshold > 1.0 + 1e-6:
        return vectors.select(*by, "id")
    # a zero vector has cosine 0 with everything, itself included: never dropped
    zero = ~F.exists("v", lambda x: x != 0)
    lone = vectors.where(zero).select(*by, "id")
    rest = materialize(vectors.where(~zero).groupBy(*by, "v").agg(F.min("id").alias("id")).select(*by, "id", "v"), "distinct")
    parts: list[DataFrame] = [lone]
    size = first or FIRST_ROWS
    while not rest.isEmpty():
        marked = attach(rest, _prefix_cut(rest, by, size), by)
        head = marked.where(F.col("id") <= F.col("_cut")).drop("_cut")
        tail = marked.where(F.col("id") > F.col("_cut")).drop("_cut")
        survivors = _settle(head, by, threshold)
        parts.append(survivors.select(*by, "id"))
        if not tail.isEmpty():
            hit = earlier_neighbours(tail, survivors.withColumn("kept", F.lit(True)), by, threshold)
            tail = materialize(tail.join(hit.select(*by, "id"), [*by, "id"], "left_anti"), "tail")
        rest, size = tail, size * 2
    return reduce(DataFrame.unionByName, parts)


def _settle(open_: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """The kept vectors of one prefix, in rounds.

    A round keeps what has no earlier open neighbour, drops what has a kept
    one, and leaves the rest open.
    """
    parts: list[DataFrame] = []
    newest: DataFrame | None = None
    key = [*by, "id"]
    while True:
        sources = open_.withColumn("kept", F.lit(False))
        if newest is not None:
            sources = sources.unionByName(newest.withColumn("kept", F.lit(True)))
        flags = earlier_neighbours(open_, sources, by, threshold)
        state = materialize(
            open_.join(flags, key, "left").select(
                *by, "id", "v",
                F.coalesce("near_kept", F.lit(False)).alias("_drop"),
                F.coalesce("near_open", F.lit(False)).alias("_wait"),
            ),
            "state",
        )
        newest = state.where(~F.col("_drop") & ~F.col("_wait")).drop("_drop", "_wait")
        open_ = state.where(~F.col("_drop") & F.col("_wait")).drop("_drop", "_wait")
        parts.append(newest)
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, parts)
