"""Personal data by candidate gradient boosting (operator 10), in DataFrame operations only.

Base spans are the pattern matches of each kind that pass its check.  Three
generators propose many more, overlapping candidates: runs of address or number
characters that hold a digit or ``@``, digit groups with the separators of
phone and card numbers, and short sequences of number parts.  A candidate is described by eleven small counts and
classes of its format and context; a candidate that overlaps a base span is an
example of personal data, any other one is not.  One aggregation counts the
examples per description (at most ``CELLS`` descriptions exist), boosted trees
are grown on these counts, and the threshold is calibrated on the half of the
rows that the trees did not see: the lowest score from which the lower
confidence bound of the precision is ``PRECISION``.  Candidates above it that
touch no base span are added: numbers that look like cards or phones in every
respect but the check, or the country code.

Matches are placed by the lengths of the pieces between them, so that no text
is cut out of a long document again and again, and no pattern backtracks over
more than one run.  Null texts are empty and have no spans.  Repeated rows are
found each for itself.  Ties in the order of spans go by kind, as listed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from evalspark.llm.frames import bare, materialize

KINDS = ("email", "ip", "card", "phone")
# What the kinds look like.  Possessive forms of the plain patterns; they match the same.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GENERATORS = {
    "run": r"(?<![A-Za-z0-9._%+@-])[A-Za-z._%+-]*+[0-9@][A-Za-z0-9._%+@-]*+",
    "groups": r"[+(]?[0-9][0-9 ().-]{5,40}[0-9]",
    "parts": r"[+(]?[0-9]{1,3}[ ().-]{0,2}[0-9]{2,4}(?:[ ().-]{1,2}[0-9]{2,4}){1,3}",
}
_PART = "^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"
#: Values of each feature, and so the number of descriptions.
SIZES = (7, 6, 5, 2, 2, 3, 3, 4, 4, 3, 3)
CELLS = math.prod(SIZES)
TREES, DEPTH, RATE = 30, 3, 0.3
PRECISION = 0.9


def _digits(c) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.ascii(F.substring(F.reverse(digits), i, F.lit(1))) - 48
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _valid() -> Column:
    n = F.length("digits")
    ip = F.forall(F.split("match", "\\."), lambda p: p.rlike(_PART))
    card = F.when(n.between(12, 19), _luhn(F.col("digits"))).otherwise(False)
    return F.when(F.col("kind") == "ip", ip).when(F.col("kind") == "card", card).when(F.col("kind") == "phone", n.between(9, 15)).otherwise(True)


def _matches(rows: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """rid, kind, match, lo, hi (code points, end exclusive), before and after (up to 24 and 1 characters)."""
    some = rows.filter(F.col("text").rlike("[0-9@]"))
    found = [F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("match"), F.split("text", p, -1).alias("gap")) for k, p in patterns.items()]
    each = some.select("rid", F.explode(F.array(*found)).alias("f")).filter(F.size("f.match") > 0)
    each = each.select("rid", "f.kind", "f.match", "f.gap").select("rid", "kind", "gap", F.posexplode("match").alias("k", "match"))
    gap, after = F.get("gap", F.col("k")), F.get("gap", F.col("k") + 1)
    each = each.select("rid", "kind", "k", "match", F.length(gap).alias("skipped"), F.right(gap, F.lit(24)).alias("before"), F.left(after, F.lit(1)).alias("after"))
    each = materialize(each, "matches")
    upto = Window.partitionBy("rid", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("hi", F.sum(F.col("skipped") + F.length("match")).over(upto))
    return each.select("rid", "kind", "match", (F.col("hi") - F.length("match")).alias("lo"), "hi", "before", "after")


def base_spans(rows: DataFrame) -> DataFrame:
    """rid, kind, lo, hi of the matches that pass their check."""
    found = _matches(rows, PATTERNS).withColumn("digits", F.when(F.col("kind").isin("card", "phone"), _digits("match")).otherwise(""))
    return found.filter(_valid()).select("rid", "kind", "lo", "hi")


def _level(c: Column, *edges: int) -> Column:
    return sum((c >= e).cast("int") for e in edges)


def _side(c: Column) -> Column:
    return F.when((c == "") | c.rlike("^\\s$"), 0).when(c.rlike("^[\\p{L}0-9]$"), 1).when(c.rlike("^[\"'=:]$"), 2).otherwise(3)


def _described(found: DataFrame) -> DataFrame:
    """Candidates with features x0, x1, ..."""
    m = F.col("match")
    count = lambda chars: F.length(m) - F.length(F.translate(m, chars, ""))
    digits = F.length(_digits(m))
    word = F.lower(F.col("before"))
    features = [
        _level(digits, 1, 4, 7, 9, 12, 20),
        _level(F.length(m), 6, 10, 15, 20, 30),
        F.least(count("."), F.lit(4)),
        (count("@") > 0).cast("int"),
        m.rlike("^[+(]").cast("int"),
        _level(F.length(F.regexp_replace(m, "[^A-Za-z]", "")), 1, 4),
        _level(count(" ()-"), 1, 3),
        _side(F.right(F.col("before"), F.lit(1))),
        _side(F.col("after")),
        F.when(word.rlike("(phone|tel|call|fax|mobile|mail|contact|card|visa|iban|host|server|addr)[^a-z]*$"), 1)
        .when(word.rlike("(token|password|passwd|key|secret|hash|id|version)[^a-z]*$"), 2).otherwise(0),
        F.when(F.col("kind") == "run", 0).when(F.col("kind") == "groups", 1).otherwise(2),
    ]
    return found.select("*", *[f.cast("int").alias(f"x{i}") for i, f in enumerate(features)])


def _touching(found: DataFrame, spans: DataFrame) -> DataFrame:
    """``found`` with ``hit``: whether a span of the same row overlaps; by two sorted passes, not by pairs."""
    extra = [c for c in found.columns if c not in ("rid", "lo", "hi")]
    both = found.withColumn("_span", F.lit(0)).unionByName(spans.select("rid", "lo", "hi", F.lit(1).alias("_span")), allowMissingColumns=True)
    ends = F.when(F.col("_span") == 1, F.col("hi"))
    starts = F.when(F.col("_span") == 1, F.col("lo"))
    forth = Window.partitionBy("rid").orderBy("lo", F.desc("_span")).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("rid").orderBy(F.desc("lo"), F.desc("_span")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_end", F.max(ends).over(forth)).withColumn("_start", F.min(starts).over(back))
    hit = F.coalesce(F.col("_end") > F.col("lo"), F.lit(False)) | F.coalesce(F.col("_start") < F.col("hi"), F.lit(False))
    return both.filter("_span = 0").select("rid", "lo", "hi", *extra, hit.alias("hit"))


def _apart(chosen: DataFrame) -> DataFrame:
    """rid, kind, lo and hi of the candidates (rid, as_kind, lo, hi, by) that overlap no kept one, the first and longest first."""
    order = Window.partitionBy("rid").orderBy("lo", F.desc("hi"), "by", "as_kind")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # islands of overlapping candidates are settled one by one: a candidate is kept if it begins where the last kept one has ended
    marked = chosen.withColumn("_new", (F.coalesce(reach, F.col("lo")) <= F.col("lo")).cast("int"))
    marked = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct("lo", (-F.col("hi")).alias("end"), "by", "as_kind")
    islands = marked.groupBy("rid", "_island").agg(F.array_sort(F.collect_list(span)).alias("all"))
    start = F.struct(F.col("all")[0]["lo"].alias("end"), F.slice("all", 1, 0).alias("kept"))
    keep = lambda s, x: F.when(x["lo"] >= s["end"], F.struct((-x["end"]).alias("end"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s)
    kept = islands.select("rid", F.explode(F.aggregate("all", start, keep)["kept"]).alias("x"))
    return kept.select("rid", F.col("x.as_kind").alias("kind"), F.col("x.lo").alias("lo"), (-F.col("x.end")).alias("hi"))


class Trees:
    """Boosted trees for the log-odds of counted examples."""

    def __init__(self, x: np.ndarray, bad: np.ndarray, good: np.ndarray):
        n = bad + good
        self.start = math.log((bad.sum() + 1) / (good.sum() + 1))
        self.trees, f = [], np.full(len(x), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, bad - n * p, n * p * (1 - p), np.arange(len(x)), DEPTH)
            self.trees.append(tree)
            f += self._values(tree, x)

    def _grow(self, x, g, h, rows, depth):
        leaf = RATE * float(g[rows].sum() / (h[rows].sum() + 1))
        best = (1e-6, None, None)
        for j in range(x.shape[1]) if depth else ():
            for c in np.unique(x[rows, j])[:-1]:
                lo, hi = rows[x[rows, j] <= c], rows[x[rows, j] > c]
                gain = sum(g[r].sum() ** 2 / (h[r].sum() + 1) for r in (lo, hi)) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                if gain > best[0]:
                    best = (gain, j, int(c))
        if best[1] is None:
            return leaf
        at = x[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, g, h, rows[at], depth - 1), self._grow(x, g, h, rows[~at], depth - 1)

    def _values(self, tree, x):
        if isinstance(tree, float):
            return np.full(len(x), tree)
        j, c, lo, hi = tree
        return np.where(x[:, j] <= c, self._values(lo, x), self._values(hi, x))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(self._values(t, x) for t in self.trees)

    def _column(self, tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        j, c, lo, hi = tree
        return F.when(F.col(f"x{j}") <= c, self._column(lo)).otherwise(self._column(hi))

    def score(self) -> Column:
        return sum((self._column(t) for t in self.trees), F.lit(self.start))


def _lower_bound(good: float, n: float) -> float:
    """Wilson's lower bound at 95 %."""
    if not n:
        return 0.0
    p, z = good / n, 1.96
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def train(examples: DataFrame) -> tuple[Trees | None, float]:
    """Trees from the even rows' examples and the threshold from the odd rows' ones."""
    names = [f"x{i}" for i in range(len(SIZES))]
    fold = F.pmod(F.xxhash64("rid"), F.lit(2)).cast("int")
    counted = examples.withColumn("fold", fold).groupBy("fold", *names).agg(F.sum(F.col("hit").cast("int")).alias("bad"), F.count("*").alias("n"))
    cells = counted.collect()  # 2 * CELLS rows at most, whatever the input
    own, other = ([c for c in cells if c["fold"] == f] for f in (0, 1))
    if not own or not other:
        return None, math.inf
    table = lambda rows: (np.array([[r[n] for n in names] for r in rows]), *(np.array([float(r[c]) for r in rows]) for c in ("bad", "n")))
    x, bad, n = table(own)
    trees = Trees(x, bad, n - bad)
    x, bad, n = table(other)
    scores, threshold, hits, total = trees.scores(x), math.inf, 0.0, 0.0
    for s in sorted(set(scores.tolist()), reverse=True):
        hits, total = hits + bad[scores == s].sum(), total + n[scores == s].sum()
        if _lower_bound(hits, total) >= PRECISION:
            threshold = s
    return trees, threshold - 1e-9


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, lo, hi, in order) of every row."""
    rows = bare(docs).withColumn("rid", F.monotonically_increasing_id())
    base = materialize(base_spans(rows), "base-spans")
    candidates = materialize(_touching(_described(_matches(rows, GENERATORS)).drop("match", "before", "after"), base), "candidates")
    trees, threshold = train(candidates)
    added = None
    # what can be a whole address or number of some kind: seven digits, or a name and a host
    whole = (F.col("x0") >= 3) | ((F.col("x3") == 1) & (F.col("x2") >= 1))
    if trees is not None and threshold < math.inf:
        chosen = candidates.filter(~F.col("hit") & whole).filter(trees.score() >= threshold)
        kind = F.when(F.col("x3") == 1, "email").when((F.col("x2") == 3) & (F.col("x5") == 0), "ip").when(F.col("x0") == 5, "card").otherwise("phone")
        added = _apart(chosen.select("rid", kind.alias("as_kind"), "lo", "hi", F.col("kind").alias("by"))).withColumn("is_base", F.lit(False))
    every = base.withColumn("is_base", F.lit(True))
    every = every if added is None else every.unionByName(added)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("lo", order.alias("order"), "hi", "kind", "is_base")
    lists = every.groupBy("rid").agg(F.array_sort(F.collect_list(span)).alias("all"))
    shown = lambda s: F.struct(s["kind"].alias("kind"), s["lo"].alias("lo"), s["hi"].alias("hi"))
    lists = lists.select("rid", F.transform("all", shown).alias("spans"), F.transform(F.filter("all", lambda s: s["is_base"]), shown).alias("base"))
    nothing = F.expr("cast(array() AS array<struct<kind:string,lo:bigint,hi:bigint>>)")
    out = rows.select("rid", "doc_id").join(lists, "rid", "left")
    return out.select("doc_id", F.coalesce("base", nothing).alias("base"), F.coalesce("spans", nothing).alias("spans"))


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["lo"].cast("string"), s["hi"].cast("string"))), ",")
