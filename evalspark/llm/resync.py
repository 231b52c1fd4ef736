"""Token counts with overlap resynchronisation for huge documents (operator 6).

Documents of up to ``CHUNK`` characters are counted in their task.  Longer ones
are cut into chunks that overlap by ``OVERLAP`` characters, spread over the
cluster and encoded with offsets.  Two neighbours are spliced at the first
white space of their overlap: no token, normalisation or pattern crosses it, so
both encodings have a token boundary there.  That is proven per pair: both
must name the same place and have the same ids from there to the last white
space of the overlap.  Where a pair fails (an overlap without white space, or
ids that differ) the document goes on with an overlap eight times as wide, up
to its whole length, where one chunk holds everything.

Null texts count as empty: 0 bytes, 0 tokens.  Repeated rows are rows of their
own.  Empty tables give no rows.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, functions as F

from evalspark.llm.frames import bare, map_rows, materialize
from evalspark.llm.tokens import BLANKS, counts_of, load, share

CHUNK = 32_768
OVERLAP = 512
#: Short texts whose unknown words are looked up at a time.
TEXTS = 64


def chunk_counts(text: str, k: int, whole: int, tok, chunk: int, overlap: int) -> tuple:
    """(left, right, tokens between, ids' check after left, after right) of chunk ``k``; places count from the document's start.

    ``text`` is the document from ``k * chunk`` to ``(k + 1) * chunk + overlap``,
    ``whole`` its length.  A place that cannot be proven is None.
    """
    start = k * chunk
    got = tok.encode(text, add_special_tokens=False)
    ids = np.array(got.ids, np.int64)
    first, last = (np.array([o[i] for o in got.offsets], np.int64) for i in (0, 1))

    def stable(lo: int) -> tuple[int | None, int | None]:
        """The first blank from ``lo`` in the overlap there, and a check of the ids to its last blank."""
        hi = min(len(text), lo + overlap)
        blanks = [i for i in range(lo, hi) if text[i] in BLANKS]
        end = start + hi == whole
        if not blanks and not end:
            return None, None
        at, to = (blanks[0] if blanks else hi), (hi if end else blanks[-1])
        if ((first < at) & (last > at)).any():
            return None, None
        inside = (first >= at) & (last <= to)
        return at, crc32(ids[inside].tobytes())

    left, left_ids = (0, 0) if k == 0 else stable(0)
    right, right_ids = (len(text), 0) if start + chunk >= whole else stable(chunk)
    if left is None or right is None:
        return (None if left is None else start + left), (None if right is None else start + right), 0, left_ids, right_ids
    n = int(((first >= left) & (last <= right)).sum())
    return start + left, start + right, n, left_ids, right_ids


def _spliced(huge: DataFrame, file, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(rid, n_tokens) of the documents whose pairs all agree, and the rids of the others."""

    def cut(x):
        out = {"rid": [], "k": [], "whole": [], "text": []}
        for rid, t in zip(x["rid"], x["text"]):
            for k in range(-(-len(t) // chunk)):
                for name, v in zip(out, (rid, k, len(t), t[k * chunk : (k + 1) * chunk + overlap])):
                    out[name].append(v)
        return out

    def count(x):
        tok = load(file.value)
        got = [chunk_counts(t, k, n, tok, chunk, overlap) for t, k, n in zip(x["text"], x["k"], x["whole"])]
        columns = list(zip(*got)) or [()] * 5
        return {"rid": x["rid"], "k": x["k"], **{name: list(c) for name, c in zip(("lo", "hi", "n", "lo_ids", "hi_ids"), columns)}}

    pieces = map_rows(huge, cut, "rid long, k int, whole long, text string", 1).repartition("rid", "k")
    counts = materialize(map_rows(pieces, count, "rid long, k int, lo long, hi long, n long, lo_ids long, hi_ids long", 8), "chunks")
    a = counts.select("rid", (F.col("k") + 1).alias("k"), F.col("hi").alias("a_hi"), F.col("hi_ids").alias("a_ids"))
    pairs = counts.filter("k > 0").join(a, ["rid", "k"])
    ok = F.coalesce((F.col("lo") == F.col("a_hi")) & (F.col("lo_ids") == F.col("a_ids")), F.lit(False))
    bad = pairs.filter(~ok).select("rid").distinct()
    sums = counts.join(bad, "rid", "left_anti").groupBy("rid").agg(F.sum("n").alias("n_tokens"))
    return sums, bad


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    file = share(docs.sparkSession, path)
    sized = bare(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = dict(docs.dtypes)["doc_id"]

    def count(x):
        table, n = counts_of(file.value), []
        for at in range(0, len(x["text"]), TEXTS):
            n += table.of([t.encode("utf-8", "replace").split() for t in x["text"][at : at + TEXTS]])
        return {"doc_id": x["doc_id"], "n_bytes": x["n_bytes"], "n_tokens": n}

    out = map_rows(sized.filter(F.length("text") <= chunk), count, f"doc_id {kind}, n_bytes long, n_tokens long", 4096)
    huge = materialize(sized.filter(F.length("text") > chunk).withColumn("rid", F.monotonically_increasing_id()), "huge")
    left = huge.select("rid", "text")
    while not left.isEmpty():
        sums, bad = _spliced(left, file, chunk, overlap)
        out = out.unionByName(huge.join(sums, "rid").select("doc_id", "n_bytes", "n_tokens"))
        left = left.join(bad, "rid", "left_semi")
        overlap *= 8
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
