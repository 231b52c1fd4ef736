"""Phrase collocations from count streams in prefix and suffix order (operator 11).

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and
pieces into words at blanks and tabs; a phrase lies within one piece.  All
counts are per language.

Counting goes order by order, as in external estimation of language models.
Workers count slices of bounded size with word numbers of their own and hand
on (phrase, count), Spark adds them up.  A phrase can only occur
``MIN_COUNT`` times if both phrases that it is made of do, so the next order is
counted where bit tables of fixed size do not rule that out; what the tables
let through by chance is counted like anything else and then dropped.

The counts of all orders are sorted twice over the cluster.  In prefix order a
phrase follows its first words, in suffix order (words backwards) its last
words, so one scan of a stream meets each phrase right after the counts it
needs: no lookup, the last one-word and two-word rows are all it remembers.
A run that goes on in the next partition is completed from at most two rows a
partition.  The same scans give the greatest count of the phrases that extend
one by a word on the right (prefix order) or on the left (suffix order).  The
two results are merged in the order of their keys.

Exact: scores are whole-number divisions of decimals of 38 digits, for counts
below 10**14.  Ranks come from a distributed sort; no language is gathered.

Null texts are empty; null lang is ``und``.  Repeated rows count again.  A text
of any length is counted in slices, whole: they overlap by the words that a
phrase may cross.  Empty tables give no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from evalspark.functions.frames import ranked
from evalspark.llm.frames import materialize

LONGEST, MIN_COUNT, TOP = 3, 10, 2000
#: A candidate goes if a longer one around it has this share of its count, in percent.
COVERED = 50
#: Bytes of text that a worker counts at a time; rows of a batch it returns.
SLICE, ROWS = 6_000_000, 100_000
#: Places of a bit table (8 MB), whatever the corpus.
PLACES = 1 << 26
_BITMAP = 32_768
_STOP = b"\xff"
_MAP = bytes(ord(" ") if b == 9 else b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def _next(text: bytes, at: int) -> int:
    return min([x for x in (text.find(b" ", at), text.find(b"\n", at)) if x >= 0], default=len(text))


def _back(text: bytes, at: int, cut: int, words: int) -> int:
    """Where the last ``words`` words before the cut begin, ``at`` at least."""
    for _ in range(words):
        while cut > at and text[cut - 1] == 32:
            cut -= 1
        cut = max(at, text.rfind(b" ", at, cut) + 1)
    return cut


def _slices(text: bytes, overlap: int) -> Iterator[bytes]:
    """``text`` in parts of bounded size, cut between pieces or else between words, then with ``overlap`` words again."""
    at = 0
    while len(text) - at > SLICE:
        cut = text.rfind(b"\n", at + 1, at + SLICE)
        if cut < 0:
            cut = text.rfind(b" ", at + 1, at + SLICE)
            cut = cut if cut > 0 else _next(text, at + SLICE)
        while cut < len(text) and text[cut] == 32 and (back := _back(text, at, cut, overlap)) <= at:
            cut = _next(text, cut + 1)  # a word longer than a part
        yield text[at:cut]
        at = back if cut < len(text) and text[cut] == 32 else cut
    yield text[at:]


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _table(bits: bytes | None, places: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(places), bool)
    return (np.frombuffer(bits, np.uint8)[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def _pair(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (((h1 << np.uint64(21)) | (h1 >> np.uint64(43))) ^ h2) & np.uint64(PLACES - 1)


def _phrases(lang: str, texts: list[bytes], order: int, bits: bytes | None):
    """(phrases, counts) of ``order`` words in the texts whose parts the table does not rule out, and how many words there are."""
    numbers = _Numbers({_STOP: 0, b"": 1})
    seq = np.fromiter(map(numbers.__getitem__, b" \xff ".join(t.replace(b"\n", b" \xff ") for t in texts).split(b" ")), np.int64)
    seq = seq[seq != 1]
    words = pa.array(list(numbers), pa.binary())
    starts = max(0, len(seq) - order + 1)
    fits = np.ones(starts, bool)
    for k in range(order):
        fits &= seq[k : starts + k] > 0
    if order > 1:
        seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in numbers), np.uint64, len(numbers))
        if order == 2:
            good = _table(bits, hashes & np.uint64(PLACES - 1))
            fits &= good[seq[:starts]] & good[seq[1 : starts + 1]]
        else:
            good = _table(bits, _pair(hashes[seq[:-1]], hashes[seq[1:]])) if len(seq) > 1 else np.zeros(0, bool)
            fits &= good[:starts] & good[1 : starts + 1]
    at = np.flatnonzero(fits)
    if not len(at):
        return None
    if order == 1:
        f = np.bincount(seq[at], minlength=len(numbers))
        ids = [np.flatnonzero(f)]
        counts = f[ids[0]]
    else:
        pairs, names = np.unique(seq[at] * len(numbers) + seq[at + 1], return_inverse=True)
        if order == 3:
            keys, counts = np.unique(names * len(numbers) + seq[at + 2], return_counts=True)
            pairs, last = pairs[keys // len(numbers)], [keys % len(numbers)]
        else:
            counts, last = np.bincount(names), []
        ids = [pairs // len(numbers), pairs % len(numbers), *last]
    parts = [words.take(pa.array(i)) for i in ids]
    return (pc.binary_join_element_wise(*parts, b" ") if order > 1 else parts[0]), counts, len(at)


def counted(docs: DataFrame, order: int, bits=None) -> DataFrame:
    """lang, phrase, f of the phrases of ``order`` words that occur often enough; of one word also each language's sum as a null phrase."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(list), 0
        table = bits.value if bits is not None else None

        def count() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                if got := _phrases(lang, texts, order, table):
                    phrases, counts, total = got
                    for at in range(0, len(counts), ROWS):
                        part = phrases[at : at + ROWS].cast(pa.string(), safe=False)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), part, pa.array(counts[at : at + ROWS], pa.int64())], ["lang", "phrase", "f"])
                    if order == 1:
                        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.string()), pa.array([total], pa.int64())], ["lang", "phrase", "f"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                raw = text.as_py().encode("utf-8", "replace").translate(_MAP)
                for part in _slices(raw, order - 1):
                    if size + len(part) > SLICE and size:
                        yield from count()
                        size = 0
                    held[lang].append(part)
                    size += len(part)
        yield from count()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text is not null and text <> ''")
    sums = rows.mapInArrow(each, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return materialize(sums.filter(F.col("phrase").isNull() | (F.col("f") >= MIN_COUNT)), f"phrases-{order}")


def _bits(spark, counts: DataFrame, order: int):
    """A broadcast bit table of fixed size of the phrases counted; built in the cluster, 4 KB at a time."""
    part = lambda k: F.xxhash64("lang", F.element_at(F.split("phrase", " "), k))  # noqa: E731  # a word has no blank
    h = part(1)
    if order == 2:
        h = F.shiftleft(h, 21).bitwiseOR(F.shiftrightunsigned(h, 43)).bitwiseXOR(part(2))
    place = h.bitwiseAND(F.lit(PLACES - 1)) + 1
    rows = counts.filter("phrase is not null").select(place.alias("place"))
    rows = rows.groupBy(F.bitmap_bucket_number("place").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    table = bytearray(PLACES // 8)
    for r in rows.collect():  # at most 2,048 rows of 4 KB
        at = (r["k"] - 1) * _BITMAP // 8
        table[at : at + len(r["bits"])] = r["bits"]
    return spark.sparkContext.broadcast(bytes(table))


_SCANNED = "lang string, words array<string>, f long, one long, two long, ext long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted partition: phrases with the counts of their first one and two words; then, without f, how often the phrases of a run extend theirs at most."""
    one = two = 0

    def carried(n, f, order, last):
        at = np.maximum.accumulate(np.where(n == order, np.arange(len(n)), -1))
        return np.where(at >= 0, f[at], last)

    for b in batches:
        if not b.num_rows:
            continue
        n, f = b["n"].to_numpy(), b["f"].to_numpy()
        ones, twos = carried(n, f, 1, one), carried(n, f, 2, two)
        one, two = int(ones[-1]), int(twos[-1])
        keep = np.flatnonzero(n > 1)
        left = lambda x, use=slice(None): pa.array(x[keep][use], pa.int64(), mask=x[keep][use] == 0)
        twos = np.where(n == 3, twos, 0)
        rows = [b["lang"].take(pa.array(keep)), b["words"].take(pa.array(keep)), pa.array(f[keep], pa.int64()), left(ones), left(twos), pa.nulls(len(keep), pa.int64())]
        yield pa.RecordBatch.from_arrays(rows, ["lang", "words", "f", "one", "two", "ext"])
        first = np.flatnonzero((n == 3) & np.r_[True, n[:-1] != 3])
        if len(first):
            most = np.maximum.reduceat(np.where(n == 3, f, 0), first)
            at = pa.array(first)
            head = pa.array([w[:2] for w in b["words"].take(at).to_pylist()], b["words"].type)
            none = pa.nulls(len(first), pa.int64())
            yield pa.RecordBatch.from_arrays([b["lang"].take(at), head, none, none, none, pa.array(most, pa.int64())], ["lang", "words", "f", "one", "two", "ext"])


def _stream(counts: DataFrame, backwards: bool) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f, one, two) and (lang, phrase, ext) from the counts in prefix or suffix order."""
    turned = (lambda c: F.reverse(c)) if backwards else (lambda c: c)
    words = F.split("phrase", " ")
    rows = counts.select("lang", turned(words).alias("words"), F.size(words).alias("n"), "f").orderBy("lang", "words")
    scanned = materialize(rows.mapInArrow(_scan, _SCANNED), "suffix-order" if backwards else "prefix-order")
    named = lambda c: F.array_join(turned(c), " ")
    ext = scanned.filter("ext is not null").groupBy("lang", named("words").alias("phrase")).agg(F.max("ext").alias("ext"))
    done = scanned.filter("f is not null").select("lang", named("words").alias("phrase"), "f", "one", "two", *[named(F.slice("words", 1, k)).alias(f"head{k}") for k in (1, 2)])
    known = "one is not null and (two is not null or phrase = head2)"
    # what a partition's first rows lack: their one and their two words, the same for all of them
    open_rows, known_rows = done.filter(f"not ({known})"), done.filter(known)
    for k, name in ((1, "one"), (2, "two")):
        lacks = F.col(name).isNull() & (F.col("phrase") != F.col(f"head{k}"))
        heads = open_rows.filter(lacks).select("lang", F.col(f"head{k}").alias("phrase")).distinct()
        heads = heads.join(counts.select("lang", "phrase", F.col("f").alias("_f")), ["lang", "phrase"]).withColumnRenamed("phrase", f"head{k}")
        open_rows = open_rows.join(heads, ["lang", f"head{k}"], "left").withColumn(name, F.when(lacks, F.col("_f")).otherwise(F.col(name))).drop("_f")
    columns = ["lang", "phrase", "f", "one", "two"]
    return known_rows.select(*columns).union(open_rows.select(*columns)), ext


def _score(left: str, right: str) -> Column:
    return F.expr(f"(1000000bd * cast(a as decimal(14,0)) * cast(a as decimal(14,0))) div (cast({left} as decimal(14,0)) * cast({right} as decimal(14,0)))")


def phrase_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase, f of all phrases of up to three words that occur ``MIN_COUNT`` times; phrase null: all words of the language."""
    spark = docs.sparkSession
    out, bits = counted(docs, 1), None
    found = out
    for order in range(2, LONGEST + 1):
        bits = _bits(spark, found, order - 1)
        found = counted(docs, order, bits)
        bits.unpersist()
        out = out.unionByName(found)
    return out


def mine(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best candidates that no longer one covers."""
    counts = phrase_counts(docs)
    total = counts.filter("phrase is null").select("lang", F.col("f").alias("n"))
    counts = counts.filter("phrase is not null")
    ahead, right = _stream(counts, backwards=False)
    behind, left = _stream(counts, backwards=True)
    behind = behind.select("lang", "phrase", F.col("one").alias("last1"), F.col("two").alias("last2"))
    rows = ahead.withColumnRenamed("f", "a").hint("merge").join(behind, ["lang", "phrase"])
    ext = right.union(left).groupBy("lang", "phrase").agg(F.max("ext").alias("ext"))
    rows = rows.hint("merge").join(ext, ["lang", "phrase"], "left").filter(f"ext is null or 100 * ext < {COVERED} * a")
    # one cut for two words; for three the lower score counts, the earlier cut on ties
    first, second = _score("one", "coalesce(last2, last1)"), F.when(F.col("two").isNotNull(), _score("two", "last1"))
    rows = rows.withColumn("s1", first).withColumn("s2", second).withColumn("early", F.expr("s2 is null or s1 <= s2"))
    rows = rows.select(
        "lang", "phrase", "a", F.expr("if(early, one, two)").alias("l"), F.expr("if(early, coalesce(last2, last1), last1)").alias("r"), F.expr("if(early, s1, s2)").alias("score")
    )
    best = ranked(rows, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], "collocations").filter(F.col("rank") < top)
    return best.join(total, "lang").select("lang", (F.col("rank") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
