"""Merkle manifest with persistent versions by path copying (operator 13).

Each document is a leaf; per language, leaves in the order of their ids form a
tree of eight children a node, and the languages' subroots form the tree above.
The leaves are ranked by a distributed sort and cut into aligned blocks of
``8 ** LEVELS``, so a block's nodes are the same whether they are built alone
or within the whole tree.

A tampered leaf makes a new version of its tree: in its block only its
ancestors are copied, every other node is shared with the first version.  What
is left of a version is its new block root, which goes on through the upper
tree: each block carries the steps from its root to the root of all (the
siblings at each level), found level by level by DataFrame operations.

A tree never gathers a language: blocks hold at most 512 leaves, upper groups
at most eight nodes.

Nulls: a null field counts as ``-``; null ids come first, and their crc32 is
that of the empty text; null lang is a language of its own, before all others.
Equal ids are ordered by their leaf, then by their tampered leaf; repeated rows
are leaves of their own.  An empty text is a value of no bytes.  Texts of any
length pass through one hash in the JVM.  An empty table gives no rows.  Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evalspark.functions.frames import attach, ranked
from evalspark.llm.frames import held_out, materialize

FANOUT, LEVELS = 8, 3
BLOCK = FANOUT**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEPS = "array<struct<before:string,after:string>>"


def digest(fields: list[Column]) -> Column:
    """Hash of the fields, each with its length in front, so that no two rows read alike."""
    parts = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def lowered(text: str = "text") -> Column:
    """What tampering does: A-Z to lower case."""
    return F.translate(text, _UPPER, _LOWER)


def tampered() -> Column:
    return held_out(3, 0)


def depth(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(leaves: list[str], levels: int) -> list[list[str]]:
    tree = [leaves]
    for _ in range(levels):
        below = tree[-1]
        tree.append([_h("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return tree


def _block_root(t: pa.Table) -> pa.Table:
    t = t.sort_by("rank")
    levels = min(LEVELS, depth(t["n"][0].as_py()))
    root = _levels(t["leaf"].to_pylist(), levels)[-1][0]
    return pa.table({"g": t["g"][:1], "i": pa.array([t["rank"][0].as_py() // BLOCK], pa.int64()), "h": pa.array([root])})


def _climb(nodes: DataFrame, by: list[str], label: str) -> DataFrame:
    """``nodes`` (by, i, h) with steps (siblings before and after, level by level) and top, the hash that remains of by."""
    most = nodes.agg(F.max("i")).first()[0]
    nodes = materialize(nodes.select(*by, "i", "h", F.col("i").alias("up"), F.lit(None).cast(_STEPS).alias("steps")), label)
    level = nodes.select(*by, "i", "h")
    for k in range(depth((most or 0) + 1)):
        level = attach(level, level.groupBy(*by).agg(F.max("i").alias("last")), by)
        run = Window.partitionBy(*by, F.expr(f"i div {FANOUT}")).orderBy("i")
        own = [F.array_join(F.collect_list("h").over(w), "") for w in (run.rowsBetween(Window.unboundedPreceding, -1), run.rowsBetween(1, Window.unboundedFollowing))]
        alone = F.col("last") == 0
        level = materialize(level.select(*by, "i", "h", alone.alias("alone"), own[0].alias("before"), own[1].alias("after")), f"{label}-level{k}")
        step = F.when(F.col("alone"), F.array().cast(_STEPS)).otherwise(F.array(F.struct("before", "after")).cast(_STEPS))
        step = level.select(*by, F.col("i").alias("up"), step.alias("step"))
        added = nodes.join(step, [*by, "up"]).select(*by, "i", "h", F.expr(f"up div {FANOUT}").alias("up"), F.concat(F.coalesce("steps", F.array().cast(_STEPS)), "step").alias("steps"))
        nodes = materialize(added, f"{label}-steps{k}")
        parent = F.when(F.col("alone"), F.col("h")).otherwise(F.sha2(F.concat("before", "h", "after").cast("binary"), 256))
        level = level.filter(f"i % {FANOUT} = 0").select(*by, F.expr(f"i div {FANOUT}").alias("i"), parent.alias("h"))
        level = materialize(level, f"{label}-up{k}")
    top = level.select(*by, F.col("h").alias("top"))
    steps = F.coalesce("steps", F.array().cast(_STEPS)).alias("steps")
    return attach(nodes, top, by).select(*by, "i", steps, "top")


def _versions(rows: pa.Table, path: pa.Table) -> pa.Table:
    """A block's leaves with their proof and, where tampered, the nodes that their version copies, up to the root."""
    rows = rows.sort_by("rank")
    leaves, changed = rows["leaf"].to_pylist(), rows["version"].to_pylist()
    tree = _levels(leaves, min(LEVELS, depth(rows["n"][0].as_py()) if len(leaves) else 0))
    steps = [(s["before"], s["after"]) for s in path["steps"][0].as_py()]
    upper = "".join(a + b for a, b in steps)
    proofs, copies, folded = [], [], []
    for i, version in enumerate(changed):
        proof, path_nodes, node = [], [], leaves[i] if version is None else version
        for below in tree[:-1]:
            first = i // FANOUT * FANOUT
            before, after = "".join(below[first:i]), "".join(below[i + 1 : first + FANOUT])
            proof += [before, after]
            path_nodes.append(node := _h(before + node + after))
            i //= FANOUT
        for before, after in steps:
            path_nodes.append(node := _h(before + node + after))
        proofs.append(_h("".join(proof) + upper))
        copies.append([] if version is None else path_nodes)
        folded.append(node)
    one = lambda c: pa.array([path[c][0].as_py()] * len(leaves), pa.string())
    return pa.table({
        "doc_id": rows["doc_id"], "lang": rows["lang"], "rank": rows["rank"], "leaf": rows["leaf"], "version": rows["version"], "subroot": one("subroot"), "root": one("root"),
        "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "copied": pa.array(copies, pa.list_(pa.string())),
    })


def manifest(docs: DataFrame, change: Column | None = None, when: Column | None = None) -> DataFrame:
    """doc_id, lang, rank in its language, leaf, version (the tampered leaf, else null), subroot, root, proof_sha256, folded_root, copied.

    ``change`` is the tampered text and ``when`` says which rows have it.
    ``folded_root`` is recomputed from the version, else from the leaf, and the
    siblings.  ``copied`` holds the nodes of a version that are not shared,
    from its leaf's parent to its root.
    """
    fields = [F.col(c) for c in FIELDS]
    other = digest([*fields[:-1], lowered() if change is None else change])
    kind = docs.schema["doc_id"].dataType.simpleString()
    leaves = docs.select("doc_id", "lang", digest(fields).alias("leaf"), F.when(tampered() if when is None else when, other).alias("version"))
    leaves = materialize(leaves, "leaves")
    langs = ranked(leaves.groupBy("lang").agg(F.count("*").alias("n")), [], ["lang"], "langs")
    langs = materialize(langs.select(F.col("lang").alias("_lang"), "n", F.col("rank").alias("g")), "langs-ranked")
    rows = leaves.join(langs, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
    rows = ranked(rows, ["g"], ["doc_id", "leaf", "version"], "leaves-sorted").withColumn("i", F.expr(f"rank div {BLOCK}")).drop("at")
    roots = rows.select("g", "i", "rank", "n", "leaf").groupBy("g", "i").applyInArrow(_block_root, "g long, i long, h string")
    blocks = _climb(roots, ["g"], "blocks")
    subroots = materialize(blocks.filter("i = 0").select(F.col("g").alias("i"), F.col("top").alias("h")), "subroots")
    above = _climb(subroots, [], "subroots-up").select(F.col("i").alias("g"), F.col("steps").alias("more"), F.col("top").alias("root"))
    paths = blocks.join(above, "g").select("g", "i", F.concat("steps", "more").alias("steps"), F.col("top").alias("subroot"), "root")
    schema = f"doc_id {kind}, lang string, rank long, leaf string, version string, subroot string, root string, proof_sha256 string, folded_root string, copied array<string>"
    return rows.groupBy("g", "i").cogroup(paths.groupBy("g", "i")).applyInArrow(_versions, schema)

