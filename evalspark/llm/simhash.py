"""SimHash near-duplicates by anchor-point covering (operator 7).

A 64-bit fingerprint has two halves.  Of two fingerprints that differ in at
most three bits, one half differs in at most one.  The anchors of a half are
the words of the perfect Hamming code over its low 31 bits: every value lies
within the covering radius 1 of exactly one anchor, its home, and a value one
bit further lies within radius + threshold share = 2 of that home.  So each
distinct fingerprint is replicated to the (at most 16) anchors within 2 of each
half, and compared per anchor with the fingerprints at home there.  The
remaining bit of the half costs nothing: it is not part of the key.

Anchors that own more than ``HOT`` rows (a family of near copies) are covered a
second time: by the same argument one quarter of the *other* half differs in at
most one bit, and its low 15 bits have the perfect code of length 15.

Nulls are empty texts and have fingerprint zero; a text of one or two words is
one shingle.  Rows with a null id take part and count last.  Repeated rows are
ordinary members of their group.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from evalspark.llm.components import components
from evalspark.llm.frames import bare, free_name, map_rows, materialize

#: Rows of one anchor from which it is covered a second time.
HOT = 2048
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16
#: Pairs of an anchor up to which they are compared at once with those of other anchors.
SMALL = 4096


def fingerprint(text: str, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the text's word shingles."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(at, min(n, at + BLOCK))]
        ones += np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, rid (the row's number in this reading) and fp."""

    def rows(x):
        return {"rid": x["rid"], "doc_id": x["doc_id"], "fp": [fingerprint(t, shingle) for t in x["text"]]}

    kind = dict(docs.dtypes)["doc_id"]
    return map_rows(bare(docs).withColumn("rid", F.monotonically_increasing_id()), rows, f"rid long, doc_id {kind}, fp long")


def _syndrome(v: Column, bits: int) -> Column:
    """The position (from 1) of the bit that separates ``v`` from its code word, or 0."""
    out = F.lit(0)
    for k in range(bits.bit_length()):
        mask = sum(1 << (i - 1) for i in range(1, bits + 1) if i >> k & 1)
        out = out + (F.bit_count(v.bitwiseAND(F.lit(mask).cast("long"))) % 2) * (1 << k)
    return out


def _cover(df: DataFrame, value: Column, bits: int) -> DataFrame:
    """Each row once per anchor within 2 of ``value``; ``home`` marks the nearest one."""
    one = F.lit(1).cast("long")

    def bit(i: Column) -> Column:
        return F.call_function("shiftleft", one, (i - 1).cast("int"))

    df = df.withColumn("_v", value.bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
    df = df.withColumn("_s", _syndrome(F.col("_v"), bits).cast("int"))
    pairs = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(bits)), lambda i: (F.col("_s") > 0) & (i < i.bitwiseXOR(F.col("_s")))),
        lambda i: F.col("_v").bitwiseXOR(bit(i)).bitwiseXOR(bit(i.bitwiseXOR(F.col("_s")))),
    )
    near = F.when(F.col("_s") > 0, F.col("_v").bitwiseXOR(bit(F.greatest(F.col("_s"), F.lit(1))))).otherwise(F.col("_v"))
    return df.select("*", F.posexplode(F.concat(F.array(near), pairs)).alias("_at", "_anchor")).drop("_v", "_s")


def _forest(fps: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is reachable within one large anchor, without listing all its pairs."""
    left, links = np.unique(fps), []
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            x, frontier = frontier[0], frontier[1:]
            hit = np.bitwise_count(left ^ x) <= most
            if hit.any():
                links.append((np.full(int(hit.sum()), x), left[hit]))
                frontier = np.concatenate([frontier, left[hit]])
                left = left[~hit]
    return links


def _compare(cell: np.ndarray, fps: np.ndarray, home: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within the anchors of a sorted run of rows; ``cell`` numbers the anchors from 0."""
    n_all = np.bincount(cell)
    n_home = np.bincount(cell, weights=home).astype(np.int64)
    size, links = n_all * n_home, []
    for c in np.flatnonzero((size > SMALL)):
        lo, hi = np.searchsorted(cell, [c, c + 1])
        links += _forest(fps[lo:hi], most)
    small = (size <= SMALL) & (n_all > 1) & (n_home > 0)
    at = np.flatnonzero(home & small[cell])
    starts = np.concatenate([[0], np.cumsum(n_all)])
    for lo in range(0, len(at), 4096):
        own = at[lo : lo + 4096]
        reps = n_all[cell[own]]
        x = np.repeat(own, reps)
        y = np.repeat(starts[cell[own]], reps) + np.arange(len(x)) - np.repeat(np.cumsum(reps) - reps, reps)
        d = np.bitwise_count(fps[x] ^ fps[y])
        keep = (d <= most) & (d > 0)
        links.append((fps[x[keep]], fps[y[keep]]))
    return links


def _links(cells: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Distinct links (a < b) between rows of the same anchor."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = np.column_stack([np.asarray(batch.column(i), dtype=np.int64) for i in range(batch.num_columns)])
            t = t if rest is None else np.concatenate([rest, t])
            if not len(t):
                continue
            key = t[:, : len(keys)]
            new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
            last = np.flatnonzero(new)[-1]
            rest = t[last:]
            yield from emit(t[:last], new[:last])
        if rest is not None and len(rest):
            yield from emit(rest, np.arange(len(rest)) == 0)

    def emit(t: np.ndarray, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(t):
            return
        found = _compare(np.cumsum(new) - 1, t[:, -2].astype(np.uint64), t[:, -1] == 1, most)
        if found:
            x, y = (np.concatenate([f[i] for f in found]).astype(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=out)

    rows = cells.select(*keys, "fp", F.col("home").cast("long").alias("home"))
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, "a long, b long").distinct()


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """Links between distinct fingerprints (column fp) at ``most`` (3 at most) differing bits.

    Every connected pair stays connected; within a crowded anchor only a
    spanning forest of the links is listed.
    """
    if most > 3:
        raise ValueError("two halves with a Hamming code prove thresholds up to 3 only")
    low = F.lit(0xFFFFFFFF).cast("long")
    halves = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    own = F.when(F.col("half") == 0, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32)).bitwiseAND(low)
    other = F.when(F.col("half") == 1, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32)).bitwiseAND(low)
    cells = _cover(halves, own, 31).select("fp", "half", F.col("_anchor").alias("anchor"), (F.col("_at") == 0).alias("home"))
    cells = materialize(cells, "simhash-cells")
    crowded = cells.groupBy("half", "anchor").count().filter(F.col("count") > HOT).select("half", "anchor", F.lit(True).alias("hot"))
    marked = cells.join(crowded, ["half", "anchor"], "left")
    plain = _links(marked.filter(F.col("hot").isNull()), ["half", "anchor"], most)
    again = marked.filter("hot").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("quarter"))
    part = F.when(F.col("quarter") == 0, other).otherwise(F.shiftrightunsigned(other, 16)).bitwiseAND(F.lit(0xFFFF).cast("long"))
    # at home only where the first cover and the second one agree on it
    again = _cover(again, part, 15).withColumn("home", F.col("home") & (F.col("_at") == 0))
    return plain.union(_links(again.withColumnRenamed("_anchor", "finer"), ["half", "anchor", "quarter", "finer"], most)).distinct()


def near_groups(docs: DataFrame, most: int = 3, shingle: int = 3) -> DataFrame:
    """rid, doc_id, fp and component_id (the smallest id of the group) of every row."""
    rows = materialize(fingerprints(docs, shingle), "simhash-fp")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), most))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rows.join(named.select("fp", "root").join(least, "root"), "fp").select("rid", "doc_id", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, most: int = 3, shingle: int = 3) -> DataFrame:
    """The rows that stay: of each group the one with the smallest id, of equal ids the first row; null ids last."""
    groups = near_groups(docs, most, shingle)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("_first"))
    rid = free_name(docs, "_rid")
    stay = first.select(F.col("_first.rid").alias(rid))
    return docs.withColumn(rid, F.monotonically_increasing_id()).join(stay, rid, "left_semi").drop(rid)
