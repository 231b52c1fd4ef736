"""Line dedup by a suffix array over line sequences (operator 4), in DataFrame operations only.

A document is the sequence of its lines that have a word, compared without the
white space around them.  A run is some consecutive lines of one document; a
line is deleted if it lies in a run of at least ``MIN_WORDS`` words that
occurs at an earlier place too (documents in the order of their ids, null last,
equal ids in reading order; then by line).  Blank lines within a deleted run go
with it.

Prefix doubling ranks the suffixes by their first 1, 2, 4, ... lines: each
round sorts the distinct pairs of ranks half a length apart over the cluster
and hands the new ranks back by a join.  A suffix whose rank is its own leaves
the array, for no longer run can repeat there.  The longest common prefix that
matters for a suffix is the least run from it with ``MIN_WORDS`` words, at
most that many lines; its two overlapping ranks name the interval of the suffix
array that shares this prefix.  The first suffix of an interval stays, the run
is deleted at all others.  Runs are taken forwards from each line and backwards
to each line, so that together they cover every longer repeated run; joined,
they are the maximal ones.

Null texts stay null and have no lines.  Repeated rows: the later one loses
whatever it shares.  Lines of any length are compared by 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from evalspark.llm.frames import free_name, materialize

MIN_WORDS = 50
_TRIM = " \t\r\x0b\x0c"
_BLANKS = "[\\x20\\x09-\\x0D]+"


def _lines(docs: DataFrame) -> DataFrame:
    """rid, doc_id, ln (line number), i (number among lines with words), words and key of each line with words."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("text").alias("_text"))
    trimmed = F.transform(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(_TRIM)))
    full = F.filter(F.transform(trimmed, lambda x, n: F.struct(n.alias("ln"), x.alias("line"))), lambda x: x["line"] != "")
    rows = rows.select("rid", "doc_id", F.posexplode(full).alias("i", "x"))
    words = F.size(F.split("x.line", _BLANKS))
    return rows.select("rid", "doc_id", "i", "x.ln", words.alias("words"), F.xxhash64("x.line").alias("k1"), F.xxhash64(F.lit(1), F.reverse("x.line")).alias("k2"))


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose keys repeat, with their rank in the order of the keys instead of them."""
    often = rows.groupBy(*keys).count().filter("count > 1").orderBy(*keys)
    ranks = materialize(often.select(*keys, F.monotonically_increasing_id().alias("rank")), "ranks")
    return rows.join(ranks, keys).drop(*keys)


def _doubled(ranks: DataFrame, k: int) -> DataFrame:
    """Ranks by the first 2k lines from the ranks by the first k lines."""
    after = ranks.select("rid", (F.col("i") - k).alias("i"), F.col("rank").alias("r2"))
    return materialize(_ranked(ranks.withColumnRenamed("rank", "r1").join(after, ["rid", "i"]), ["r1", "r2"]), f"suffix-{2 * k}")


def _least_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(rid, s, m): the least runs with enough words from each line and to each line."""
    islands = Window.partitionBy("rid").orderBy("i")
    lines = lines.withColumn("island", F.col("i") - F.row_number().over(islands))
    near = Window.partitionBy("rid", "island").orderBy("i")

    def least(words):
        """How many of the words' first entries reach the sum, or null."""
        zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"))
        step = lambda a, x: F.when(a["sum"] >= min_words, a).otherwise(F.struct((a["sum"] + x).alias("sum"), (a["n"] + 1).alias("n")))
        return F.aggregate(words, zero, step, lambda a: F.when(a["sum"] >= min_words, a["n"]))

    ahead = F.collect_list("words").over(near.rowsBetween(0, min_words - 1))
    behind = F.reverse(F.collect_list("words").over(near.rowsBetween(1 - min_words, 0)))
    both = lines.select("rid", "i", ahead.alias("ahead"), behind.alias("behind")).select("rid", "i", least("ahead").alias("f"), least("behind").alias("b"))
    runs = both.select("rid", F.explode(F.array(F.struct(F.col("i").alias("s"), F.col("f").alias("m")), F.struct((F.col("i") - F.col("b") + 1).alias("s"), F.col("b").alias("m")))).alias("x"))
    return runs.select("rid", "x.s", "x.m").filter("m IS NOT NULL").distinct()


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """rid, lo, hi, n_lines: the maximal runs of lines (numbers, both inclusive) to delete, and how many of them have words."""
    lines = materialize(_ranked(_lines(docs), ["k1", "k2"]), "suffix-1")
    runs = materialize(_least_runs(lines, min_words), "runs")
    levels, k = {1: lines.select("rid", "i", "rank")}, 1
    most = runs.agg(F.max("m")).first()[0] or 0
    while 2 * k <= most:
        levels[2 * k] = _doubled(levels[k], k)
        k *= 2
    named = None
    for k, ranks in levels.items():
        own = runs.filter((F.col("m") >= k) & (F.col("m") < 2 * k))
        head = ranks.select("rid", F.col("i").alias("s"), F.col("rank").alias("r1"))
        tail = ranks.select("rid", (F.col("i") + k).alias("e"), F.col("rank").alias("r2"))
        part = own.join(head, ["rid", "s"]).withColumn("e", F.col("s") + F.col("m")).join(tail, ["rid", "e"])
        named = part.select("rid", "s", "m", "r1", "r2") if named is None else named.unionByName(part.select("rid", "s", "m", "r1", "r2"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "s")
    named = materialize(named.join(lines.select("rid", F.col("i").alias("s"), "doc_id"), ["rid", "s"]), "intervals")
    first = named.groupBy("m", "r1", "r2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = named.join(first, ["m", "r1", "r2"]).filter(place != F.col("first"))
    gone = later.select("rid", F.explode(F.sequence("s", F.col("s") + F.col("m") - 1)).alias("i")).distinct().join(lines.select("rid", "i", "ln"), ["rid", "i"])
    island = F.col("i") - F.row_number().over(Window.partitionBy("rid").orderBy("i"))
    runs = gone.withColumn("island", island).groupBy("rid", "island")
    return runs.agg(F.min("ln").alias("lo"), F.max("ln").alias("hi"), F.count("*").alias("n_lines")).drop("island")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, names: tuple[str, str] = ("removed", "n_removed")) -> DataFrame:
    """``docs`` with text as it remains, and two columns more: the runs removed (array of lo, hi), and their number of lines with words.

    Columns of these two names are replaced; all others stay, whatever their names.
    """
    rid = free_name(docs, "_rid")
    runs = later_copies(docs.select("doc_id", "text"), min_words).groupBy("rid")
    runs = runs.agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("removed"), F.sum("n_lines").alias("n_removed"))
    kept = [c for c in docs.columns if c.lower() not in [n.lower() for n in names]]
    given = docs.select(*[F.col(f"`{c}`") for c in kept], F.monotonically_increasing_id().alias(rid))
    removed, n = free_name(given, "removed"), free_name(given, "n_removed")
    rows = given.join(runs.toDF(rid, removed, n), rid, "left")
    lines = F.split("text", "\n")
    # the lines before each run, and those after the last one
    starts = F.concat(F.array(F.lit(0)), F.transform(removed, lambda r: r["hi"] + 1))
    ends = F.concat(F.transform(removed, lambda r: r["lo"]), F.array(F.size(lines)))
    left = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))
    text = F.when(F.col(removed).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    out = [text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in kept]
    nothing = F.expr("cast(array() AS array<struct<lo:int,hi:int>>)")
    return rows.select(*out, F.coalesce(removed, nothing).alias(names[0]), F.coalesce(n, F.lit(0)).cast("long").alias(names[1]))
