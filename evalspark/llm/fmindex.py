"""Benchmark decontamination with an FM-index per training shard (operator 9).

Test phrases are the distinct windows of ten consecutive words of an item (an
item of fewer words is one window).  The symbols of an index are the words of
the phrase set; every other word can lie in no occurrence, so it only separates
runs, and runs shorter than the shortest phrase are left out of the index, not
out of the counts.  Per shard (the documents of one Arrow batch, whole) the
runs are put behind each other, sorted by suffix with prefix doubling, and
turned into a wavelet matrix over the Burrows-Wheeler transform.  All phrases
are searched backwards at once by ranks in that matrix; occurrences are located
by walking to the nearest sampled suffix position; their spans are merged.

The phrases are a stated query set.  They are cut into blocks of about
``BLOCK`` (phrase, item) pairs, known from a count; each block is broadcast and
answered by one pass of the same stage, which adds to the spans found so far.

Null or wordless texts have no words and no hits; null or wordless items have
no phrases.  A null item id counts as the empty text.  Repeated rows are
answered each for itself, repeated items once.  An empty benchmark hits
nothing, an empty table of documents gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from evalspark.llm.frames import add_columns, map_rows, materialize

#: (phrase, item) pairs of one broadcast block.
BLOCK = 200_000
#: Every so many text positions the suffix array is kept.
SAMPLE = 8
#: Documents of one shard at most.
SHARD_ROWS = 4096

# What is no part of a word.
_NO_WORD = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
_PLAIN = bytes(c + 32 if c in _UPPER else 32 if c in _NO_WORD else c for c in range(256))
_WORD_CHAR = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_PLAIN).split()


def phrases(benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Distinct (item, phrase) pairs; a phrase is its words joined by blanks."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = F.regexp_extract_all(lower, F.lit(f"({_WORD_CHAR}+)"), F.lit(1))
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return (
        benchmark.select(item, w.alias("w"))
        .filter(F.size("w") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, window), " "))).alias("phrase"))
        .distinct()
    )


class Queries:
    """A block of phrases as symbols: 0 separates, words count from 1."""

    def __init__(self, pairs: list[tuple[str, str]]):
        items = defaultdict(list)
        for item, phrase in pairs:
            items[phrase.encode("utf-8", "replace")].append(item)
        split = [p.split(b" ") for p in items]
        self.items = list(items.values())
        self.symbol = {w: i + 1 for i, w in enumerate(sorted({w for p in split for w in p}))}
        self.length = np.array([len(p) for p in split], np.int64)
        self.shortest, self.longest = int(self.length.min()), int(self.length.max())
        self.words = np.zeros((len(split), self.longest), np.int64)
        for i, p in enumerate(split):
            self.words[i, : len(p)] = [self.symbol[w] for w in p]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling; of equal runs the earlier separator is smaller.

    The last symbol must be a separator (0).  As no two separators are equal,
    the rounds grow with the logarithm of the longest run only.
    """
    n, k = len(text), 1
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum()))
    order = np.argsort(rank, kind="stable")
    while True:
        sorted_rank = rank[order]
        named = np.empty(n, np.int64)
        named[order] = np.concatenate([[0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])])
        if named[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[:-k] = named[k:] + 1
        rank = named * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        k *= 2


class WaveletMatrix:
    """Ranks and symbols of a sequence, one bit vector with running counts per level."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels, self.zeros, self.bits = [], [], range(max(1, int(symbols).bit_length()) - 1, -1, -1)
        for b in self.bits:
            one = (seq >> b & 1).astype(bool)
            self.levels.append(np.concatenate([[0], np.cumsum(one)]))
            self.zeros.append(int(len(seq) - self.levels[-1][-1]))
            seq = np.concatenate([seq[~one], seq[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position ``at``."""
        lo, hi = np.zeros_like(at), at.copy()
        for b, ones, zeros in zip(self.bits, self.levels, self.zeros):
            one = (symbol >> b & 1).astype(bool)
            lo, hi = (np.where(one, zeros + ones[p], p - ones[p]) for p in (lo, hi))
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out, p = np.zeros_like(at), at.copy()
        for b, ones, zeros in zip(self.bits, self.levels, self.zeros):
            one = ones[p + 1] - ones[p] == 1
            out |= one.astype(np.int64) << b
            p = np.where(one, zeros + ones[p], p - ones[p])
        return out


class FMIndex:
    """Over runs of words (symbols from 1) that each end with a separator (0).

    Besides every ``SAMPLE``-th suffix position that of each run's start is
    kept, so that no walk crosses a separator.
    """

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_order(text)
        self.bwt = WaveletMatrix(text[order - 1], symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        kept = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.sampled = np.concatenate([[0], np.cumsum(kept)])
        self.samples = order[kept]

    def find(self, q: Queries) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, text position) of every occurrence."""
        lo, hi = np.zeros(len(q.length), np.int64), np.full(len(q.length), self.before[-1], np.int64)
        for i in range(q.longest - 1, -1, -1):
            on = np.flatnonzero((i < q.length) & (lo < hi))
            c = q.words[on, i]
            lo[on], hi[on] = (self.before[c] + self.bwt.rank(c, p[on]) for p in (lo, hi))
        n = np.maximum(hi - lo, 0)
        phrase = np.repeat(np.arange(len(n)), n)
        row = np.repeat(lo, n) + np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
        steps, at = np.zeros_like(row), np.full_like(row, -1)
        todo = np.arange(len(row))
        while len(todo):
            r = row[todo]
            done = self.sampled[r + 1] > self.sampled[r]
            at[todo[done]] = self.samples[self.sampled[r[done]]] + steps[todo[done]]
            todo, r = todo[~done], r[~done]
            c = self.bwt.access(r)
            row[todo] = self.before[c] + self.bwt.rank(c, r)
            steps[todo] += 1
        return phrase, at


def _runs(marks: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of true marks."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)])


def search(texts: list[str | None], q: Queries) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Per text: its words, the merged word spans of phrases, the items with occurring phrases."""
    out, doc_of, word_of, parts = [], [], [], []
    for d, text in enumerate(texts):
        ids = np.array([q.symbol.get(w, 0) for w in words(text)], np.int64)
        out.append((len(ids), [], set()))
        for lo, hi in _runs(ids > 0):
            if hi - lo >= q.shortest:
                parts += [ids[lo:hi], [0]]
                doc_of.append(np.full(hi - lo + 1, d))
                word_of.append(np.arange(lo, hi + 1))
    if not parts:
        return out
    index = FMIndex(np.concatenate(parts).astype(np.int64), len(q.symbol))
    doc_of, word_of = np.concatenate(doc_of), np.concatenate(word_of)
    phrase, at = index.find(q)
    if not len(at):
        return out
    marks = np.zeros(len(doc_of) + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + q.length[phrase], -1)
    for lo, hi in _runs(np.cumsum(marks)[:-1] > 0):
        out[doc_of[lo]][1].append((int(word_of[lo]), int(word_of[lo] + hi - lo)))
    for d, p in np.unique(np.column_stack([doc_of[at], phrase]), axis=0):
        out[d][2].update(q.items[p])
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` with n_words, spans (word numbers, end exclusive, merged, ascending) and items (ascending).

    Columns of these names are replaced.
    """
    pairs = phrases(benchmark, window)
    blocks = -(-pairs.count() // BLOCK)
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "spans", "items")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    schema += ", n_words long, spans array<struct<lo:int,hi:int>>, items array<string>"
    df = docs.select(*kept, F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() AS array<struct<lo:int,hi:int>>)").alias("spans"), F.expr("cast(array() AS array<string>)").alias("items"))

    def count(x):
        return x | {"n_words": [len(words(t)) for t in x["text"]]}

    def block(held):
        def rows(x):
            spans, items, n = [], [], []
            for (k, s, i), s0, i0 in zip(search(x["text"], held.value), x["spans"], x["items"]):
                n.append(k)
                spans.append([{"lo": a, "hi": b} for a, b in merged(s + [(y["lo"], y["hi"]) for y in s0])])
                items.append(sorted(i | set(i0)))
            return x | {"n_words": n, "spans": spans, "items": items}

        return rows

    if not blocks:
        return map_rows(df, count, schema, SHARD_ROWS)
    for b in range(blocks):
        part = pairs.filter(F.pmod(F.xxhash64("item", "phrase"), F.lit(blocks)) == b)
        if got := [(r["item"], r["phrase"]) for r in part.collect()]:  # about BLOCK pairs
            held = docs.sparkSession.sparkContext.broadcast(Queries(got))
            df = map_rows(df, block(held), schema, SHARD_ROWS)
            if blocks > 1:  # one block's phrases are alive at a time, one block's search is a job
                df = materialize(df, "spans")
                held.unpersist()
    return df


@cache
def _word_pattern() -> re.Pattern:
    return re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def without(text: str, spans: list[dict]) -> str:
    """``text`` without the characters from the first to the last word of each span."""
    if not spans:
        return text
    at = [m.span() for m in _word_pattern().finditer(text)]
    out, end = [], 0
    for s in spans:
        out.append(text[end : at[s["lo"]][0]])
        end = at[s["hi"] - 1][1]
    return "".join(out) + text[end:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` with the removal spans cut out of the texts, in the same columns.

    Phrases of one block are searched and cut out in one pass over the texts.
    """
    text = next(c for c in docs.columns if c.lower() == "text")
    order = [F.col(f"`{c}`") for c in docs.columns]
    pairs = phrases(benchmark, window)
    count = pairs.count()
    if not count:
        return docs
    if count > BLOCK:
        rows = docs.select(F.struct(*order).alias("row"), "text")
        found = occurrences(rows, benchmark, window).select("row.*", F.col("spans").alias("spans to cut"))
        cut = add_columns(found, [text, "spans to cut"], lambda x: {text: [t and without(t, s) for t, s in zip(x[text], x["spans to cut"])]}, f"`{text}` string")
        return cut.select(*order)
    held = docs.sparkSession.sparkContext.broadcast(Queries([(r["item"], r["phrase"]) for r in pairs.collect()]))  # BLOCK pairs at most

    def cut_out(x):
        found = search(x[text], held.value)
        return {text: [t and without(t, [{"lo": lo, "hi": hi} for lo, hi in merged(spans)]) for t, (_, spans, _) in zip(x[text], found)]}

    return add_columns(docs, [text], cut_out, f"`{text}` string", SHARD_ROWS).select(*order)
