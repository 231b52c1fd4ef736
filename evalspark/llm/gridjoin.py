"""Embedding near-duplicates by an epsilon grid order join (operator 12).

Vectors of one label and length are compared; equal ones are first made one
class with a weight.  A cosine of at least c means that unit vectors lie within
eps = sqrt(2 - 2c).  The vectors are sorted over the cluster by their cells of
side eps on the leading principal dimensions, and the sequence is cut into
blocks of bounded bytes.

The join is recursive over sequence intervals.  Every interval has a box on all
principal dimensions and a ball around its mean.  Starting from each label's
whole sequence, a round of jobs looks at all pairs of intervals that are still
open: pairs provably farther apart than eps go, pairs provably closer are
settled at once (every vector gains the other side's weight, no vector is
looked at), the rest is opened into pairs of their parts.  Pairs of blocks that
stay open become one task each, which goes on in the same way down to small
products in double precision.

So a family of near copies costs its intervals and not its pairs; results are
one row per vector and task, never a pair list, and links reach the components
as each vector's least partner class in the task.

The principal dimensions come from a sample of ``SAMPLE`` vectors, the least by
hash; they only decide how much is skipped: any rotation gives the same links.
Vectors of other lengths than the sample's commonest keep their own axes.

Null, empty or zero vectors, those with null or non-finite components and those
without label link with nothing.  Repeated ids are vectors of their own, each
keeps its row; a null id never is a component's least unless all are null.
Empty tables give no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evalspark.functions.frames import ranked
from evalspark.llm.components import components
from evalspark.llm.frames import materialize

THRESHOLD, SAMPLE = 0.93, 2048
#: Grid dimensions; bytes of a block; parts of an interval; rows of the least interval within a task.
DIMENSIONS, BLOCK_BYTES, PARTS, LEAF = 8, 1 << 18, 4, 64
#: More than rounding can move a distance.
SLACK = 1e-6


def _units(flat: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    v = flat / np.abs(flat).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, length)


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, label (null if the vector links with nothing), v and 128 bits that stand for the vector."""
    e, infinite = F.col("embedding"), F.lit(math.inf)
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < infinite)) & F.exists(e, lambda x: x != 0)
    keys = [F.xxhash64(e).alias("k1"), F.xxhash64(F.lit(1), F.reverse(e)).alias("k2")]
    return vectors.select("vec_id", F.when(fine, F.col("label")).alias("label"), e.cast("array<double>").alias("v"), *keys)


def principal(classes: DataFrame) -> np.ndarray:
    """Rotation onto the principal dimensions, the leading first, of a bounded sample."""
    some = classes.select("v").orderBy("k1", "k2").limit(SAMPLE).collect()
    lengths = [len(r["v"]) for r in some]
    if not lengths:
        return np.eye(1)
    length = max(set(lengths), key=lambda n: (lengths.count(n), n))
    x = _units(np.array([r["v"] for r in some if len(r["v"]) == length], np.float64))
    x = x - x.mean(axis=0)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


def _rotated(u: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return u @ basis if u.shape[1] == len(basis) else u


def _bounds(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Box and ball of some rows."""
    mid = r.mean(axis=0)
    return r.min(axis=0), r.max(axis=0), mid, float(np.sqrt(((r - mid) ** 2).sum(axis=1).max()))


def _verdict(a, b, eps: float) -> int:
    """Two intervals' bounds: -1 no vector of one within eps of one of the other, 1 every one, 0 unknown."""
    between = float(np.sqrt(((a[2] - b[2]) ** 2).sum()))
    if between + a[3] + b[3] <= eps - SLACK:
        return 1
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return -1 if max(between - a[3] - b[3], float(np.sqrt((gap * gap).sum()))) > eps + SLACK else 0


def _least_rows(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row and column the least row that it is connected with in this product; the number of rows if none."""
    none = len(near)
    rows = np.where(near.any(axis=1), np.arange(none), none)
    while True:
        columns = np.where(near, rows[:, None], none).min(axis=0, initial=none)
        now = np.where(near, columns[None, :], none).min(axis=1, initial=none)
        if (now == rows).all():
            return rows, columns
        rows = now


def _join(ua, ub, ra, rb, wa, wb, threshold: float, same: bool):
    """Weights linked to each row of both sides, and each row's component among all (the b side counts after the a side).

    Of a block with itself, intervals are the same or one after the other, and
    both sides' weights add up to a row's.
    """
    eps = math.sqrt(2 - 2 * threshold)
    na, nb = len(ua), len(ub)
    linked, parent = [np.zeros(na, np.int64), np.zeros(nb, np.int64)], np.arange(na + (0 if same else nb))
    shift = 0 if same else na

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def unite(a, b) -> None:
        for x, y in zip(a, b):
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)

    known: dict = {}

    def bounds(side: int, lo: int, hi: int):
        if (side, lo, hi) not in known:
            known[side, lo, hi] = _bounds((ra, rb)[side][lo:hi])
        return known[side, lo, hi]

    open_pairs = [(0, na, 0, nb)]
    while open_pairs:
        a0, a1, b0, b1 = open_pairs.pop()
        diagonal = same and a0 == b0
        how = _verdict(bounds(0, a0, a1), bounds(1, b0, b1), eps)
        if how < 0:
            continue
        if how == 0 and max(a1 - a0, b1 - b0) > LEAF:
            if diagonal:
                m = (a0 + a1) // 2
                open_pairs += [(a0, m, a0, m), (a0, m, m, a1), (m, a1, m, a1)]
            elif a1 - a0 >= b1 - b0:
                m = (a0 + a1) // 2
                open_pairs += [(a0, m, b0, b1), (m, a1, b0, b1)]
            else:
                m = (b0 + b1) // 2
                open_pairs += [(a0, a1, b0, m), (a0, a1, m, b1)]
            continue
        if how > 0:
            linked[0][a0:a1] += wb[b0:b1].sum()
            if not diagonal:
                linked[1][b0:b1] += wa[a0:a1].sum()
            unite([a0] * (b1 - b0) + [b0 + shift] * (a1 - a0), [*range(b0 + shift, b1 + shift), *range(a0, a1)])
            continue
        near = ua[a0:a1] @ ub[b0:b1].T >= threshold
        linked[0][a0:a1] += near @ wb[b0:b1]
        if not diagonal:
            linked[1][b0:b1] += wa[a0:a1] @ near
        least = _least_rows(near)
        for rows, start in zip(least, (a0, b0 + shift)):
            got = np.flatnonzero(rows < len(near))
            unite((got + start).tolist(), (rows[got] + a0).tolist())
    roots = np.fromiter((find(x) for x in range(len(parent))), np.int64, len(parent))
    return linked[0], linked[1], roots


#: The block of a rank: blocks hold 16 to 1,024 rows, as many as their bytes allow.
_BLOCK = f"rank div greatest(16, least(1024, {BLOCK_BYTES} div (8 * len)))"


def _placed(classes: DataFrame, basis, threshold: float) -> DataFrame:
    """Every class with u, its unit vector as bytes, and its cells."""
    eps = math.sqrt(2 - 2 * threshold)
    kept = ["g", "k1", "k2", "weight", "len"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b["len"].to_numpy()
            for n in np.unique(size):
                part = b.filter(pa.array(size == n))
                u = _units(part["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, n))
                cells = np.floor(_rotated(u, basis.value)[:, :DIMENSIONS] / eps).astype(np.int32)
                added = [pa.array([x.tobytes() for x in u], pa.binary()), pa.array(cells.tolist(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in kept], *added], [*kept, "u", "cells"])

    return classes.select(*kept, "v").mapInArrow(run, "g long, k1 long, k2 long, weight long, len int, u binary, cells array<int>")


_BOUNDS = "lo array<double>, hi array<double>, mid array<double>, radius double"


def _blocked(classes: DataFrame, basis) -> DataFrame:
    """One row per block: g, len, i, its first class id, weight and bounds, and the classes' ids, weights and vectors as bytes."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        n = t["len"][0].as_py()
        lo, hi, mid, radius = _bounds(_rotated(_matrix(t["u"], n), basis.value))
        ids, weights = t["at"].to_numpy().astype("<i8"), t["weight"].to_numpy().astype("<i8")
        double = lambda x: pa.array([x.tolist()], pa.list_(pa.float64()))
        return pa.table({
            "g": t["g"][:1], "i": t["i"][:1], "len": t["len"][:1], "first": pa.array([int(ids[0])]), "n": pa.array([len(ids)]), "weight": pa.array([int(weights.sum())]),
            "lo": double(lo), "hi": double(hi), "mid": double(mid), "radius": pa.array([radius]),
            "ids": pa.array([ids.tobytes()]), "weights": pa.array([weights.tobytes()]), "u": pa.array([b"".join(t["u"].to_pylist())], pa.binary()),
        })

    schema = f"g long, i long, len int, first long, n long, weight long, {_BOUNDS}, ids binary, weights binary, u binary"
    return classes.select("g", "i", "len", "at", "weight", "u").groupBy("g", "i").applyInArrow(run, schema)


def _merged(t: pa.Table) -> pa.Table:
    """Up to ``PARTS`` neighbouring intervals as one."""
    t = t.sort_by("i")
    lo, hi, mid = (np.array(t[c].to_pylist()) for c in ("lo", "hi", "mid"))
    n = t["n"].to_numpy()
    centre = (mid * n[:, None]).sum(axis=0) / n.sum()
    radius = (np.sqrt(((mid - centre) ** 2).sum(axis=1)) + t["radius"].to_numpy()).max()
    double = lambda x: pa.array([x.tolist()], pa.list_(pa.float64()))
    return pa.table({
        "g": t["g"][:1], "i": pa.array([t["i"][0].as_py() // PARTS], pa.int64()), "first": t["first"][:1], "n": pa.array([int(n.sum())]), "weight": pa.array([int(t["weight"].to_numpy().sum())]),
        "lo": double(lo.min(axis=0)), "hi": double(hi.max(axis=0)), "mid": double(centre), "radius": pa.array([float(radius)]),
    })


_NODE = f"g long, i long, first long, n long, weight long, {_BOUNDS}"


def _judged(pairs: DataFrame, nodes: DataFrame, eps: float) -> DataFrame:
    """Pairs (g, i, j) of intervals with ``how`` (0 open, 1 all linked) and what settles them; those too far apart are gone."""
    fields = [c for c in nodes.columns if c not in ("g", "i")]
    a = nodes.select("g", "i", F.struct(*fields).alias("a"))
    b = nodes.select("g", F.col("i").alias("j"), F.struct(*fields).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            how = []
            for x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
                sides = [(np.array(s["lo"]), np.array(s["hi"]), np.array(s["mid"]), s["radius"]) for s in (x, y)]
                how.append(_verdict(*sides, eps))
            out = [*[batch[c] for c in ("g", "i", "j")], pa.array(how, pa.int32()), *[batch[c].field(f) for f in ("first", "weight") for c in ("a", "b")]]
            yield pa.RecordBatch.from_arrays(out, ["g", "i", "j", "how", "first_a", "first_b", "weight_a", "weight_b"])

    rows = pairs.join(a, ["g", "i"]).join(b, ["g", "j"]).select("g", "i", "j", "a", "b")
    schema = "g long, i long, j long, how int, first_a long, first_b long, weight_a long, weight_b long"
    return rows.mapInArrow(run, schema).filter("how >= 0")


def _products(open_pairs: DataFrame, blocks: DataFrame, basis, threshold: float) -> DataFrame:
    """at, n (weight linked), least (a class that it is connected with) for the classes of every open pair of blocks."""
    data = ["len", "ids", "weights", "u"]
    a = blocks.select("g", "i", F.struct(*data).alias("a"))
    b = blocks.select("g", F.col("i").alias("j"), F.struct(*data).alias("b"))

    def run(t: pa.Table) -> pa.Table:
        out = [[], [], []]
        for x, y, same in zip(t["a"].to_pylist(), t["b"].to_pylist(), (t["i"].to_numpy() == t["j"].to_numpy()).tolist()):
            ids, weights = ([np.frombuffer(s[c], "<i8") for s in (x, y)] for c in ("ids", "weights"))
            u = [np.frombuffer(s["u"], "<f8").reshape(-1, s["len"]) for s in (x, y)]
            r = [_rotated(m, basis.value) for m in u]
            na, nb, roots = _join(*u, *r, *weights, threshold, same)
            every = ids[0] if same else np.concatenate(ids)
            out[0].append(every)
            out[1].append(na + nb if same else np.concatenate([na, nb]))
            out[2].append(every[roots])
        rows = [np.concatenate(c) for c in out]
        used = (rows[1] > 0) | (rows[2] != rows[0])
        return pa.table({c: pa.array(v[used], pa.int64()) for c, v in zip(("at", "n", "least"), rows)})

    # a group is one pair of blocks: two blocks of bounded bytes
    rows = open_pairs.join(a, ["g", "i"]).join(b, ["g", "j"]).select("g", "i", "j", "a", "b")
    return rows.groupBy("g", "i", "j").applyInArrow(run, "at long, n long, least long")


def linked(rows: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Of keyed rows: label, k1, k2, at and n_linked (the rows it links to, itself included) of every class, and connections (a, b) between classes."""
    spark, eps = rows.sparkSession, math.sqrt(2 - 2 * threshold)
    classes = rows.filter("label is not null").groupBy("label", "k1", "k2").agg(F.first("v").alias("v"), F.count("*").alias("weight"))
    classes = materialize(classes.withColumn("len", F.size("v")), "classes")
    groups = ranked(classes.select("label", "len").distinct(), [], ["label", "len"], "groups")
    groups = materialize(groups.select("label", "len", F.col("rank").alias("g")), "groups-ranked")
    basis = spark.sparkContext.broadcast(principal(classes))
    placed = ranked(_placed(classes.join(groups, ["label", "len"]), basis, threshold), ["g"], ["len", "cells", "k1", "k2"], "grid-order")
    placed = placed.withColumn("i", F.expr(_BLOCK))
    blocks = materialize(_blocked(placed, basis), "blocks")
    levels = [materialize(blocks.select("g", "i", "first", "n", "weight", "lo", "hi", "mid", "radius"), "intervals-0")]
    while (levels[-1].agg(F.max("i")).first()[0] or 0) > 0:
        up = levels[-1].withColumn("up", F.expr(f"i div {PARTS}")).groupBy("g", "up").applyInArrow(_merged, _NODE)
        levels.append(materialize(up, f"intervals-{len(levels)}"))
    pairs, settled = levels[-1].select("g", "i", F.col("i").alias("j")), None
    for level in range(len(levels) - 1, -1, -1):
        judged = materialize(_judged(pairs, levels[level], eps), f"judged-{level}")
        whole = judged.filter("how = 1").withColumn("level", F.lit(level))
        settled = whole if settled is None else settled.unionByName(whole)
        pairs = judged.filter("how = 0").select("g", "i", "j")
        if level:
            part = lambda c: F.sequence(F.col(c) * PARTS, F.col(c) * PARTS + PARTS - 1)
            pairs = pairs.select("g", F.explode(part("i")).alias("i"), "j").select("g", "i", F.explode(part("j")).alias("j")).filter("i <= j")
    found = materialize(_products(pairs, blocks, basis, threshold), "products")
    # what the settled intervals give to all blocks below them
    one = settled.select("g", "level", "i", F.col("weight_b").alias("n"), F.col("first_a").alias("first"))
    two = settled.filter("i <> j").select("g", "level", F.col("j").alias("i"), F.col("weight_a").alias("n"), F.col("first_b").alias("first"))
    gains = one.union(two).groupBy("g", "level", "i").agg(F.sum("n").alias("gain"), F.min("first").alias("least"))
    above = F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(levels) - 1)), lambda k: F.struct(k.alias("level"), F.floor(F.col("i") / F.pow(F.lit(float(PARTS)), k)).cast("long").alias("up"))))
    spread = blocks.select("g", "i", above.alias("x")).select("g", F.col("i").alias("block"), "x.level", F.col("x.up").alias("i"))
    spread = spread.join(gains, ["g", "level", "i"]).groupBy("g", "block").agg(F.sum("gain").alias("gain"), F.collect_set("least").alias("leasts"))  # a set of one per level
    spread = materialize(spread.withColumnRenamed("block", "i"), "settled")
    sums = found.groupBy("at").agg(F.sum("n").alias("n"))
    out = placed.join(groups.select("g", "label"), "g").join(spread, ["g", "i"], "left").join(sums, "at", "left")
    total = F.coalesce("gain", F.lit(0)) + F.coalesce("n", F.lit(0))
    out = materialize(out.select("label", "k1", "k2", "at", total.alias("n_linked"), "leasts"), "linked")
    edges = out.select("at", F.explode("leasts").alias("least")).union(found.select("at", "least")).union(settled.select("first_a", "first_b"))
    return out.drop("leasts"), edges.toDF("a", "b").filter("a <> b")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label)."""
    rows = keyed(vectors)
    classes, edges = linked(rows, threshold)
    roots = components(edges).select(F.col("node").alias("at"), "root")
    classes = classes.join(roots, "at", "left").select("label", "k1", "k2", "n_linked", F.coalesce("root", "at").alias("root"))
    rows = materialize(rows.select("vec_id", "label", "k1", "k2").join(classes, ["label", "k1", "k2"], "left").select("vec_id", "root", "n_linked"), "vectors")
    least = rows.filter("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id")
    out = rows.join(least, "root", "left").select("vec_id", F.coalesce(F.col("n_linked") - 1, F.lit(0)).alias("n_links"), component)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
