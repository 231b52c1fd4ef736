"""Quality rules with risk-controlled cutoffs (operator 3).

Every rule rejects a document whose ratio exceeds a cutoff.  Cutoffs come from
labelled documents, per stratum (language): from the loosest candidate to the
tightest, the number of good documents that a cutoff would reject is tested
against the allowed rate with the exact binomial distribution (the
Clopper-Pearson bound); the sequence stops at the first cutoff that is not
proven, so no correction is needed within a rule.  The level is divided by the
number of rules and strata, the allowed rate by the number of rules, so that
with probability 1 - ``delta`` all rules together wrongly reject at most
``alpha`` of the good documents in every stratum.  Of the proven cutoffs the
loosest is taken that catches (nearly) as many bad documents as the tightest.

All labelled rows count.  Strata are the ``STRATA`` languages with most labels;
all others form one.  A stratum without enough labels proves nothing and
rejects nothing.  A null text has no words and fails the base rule; a null
language is a stratum of its own; a document with several labels is good if all
say so, labels without quality are ignored; repeated rows are judged alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from evalspark.llm.frames import add_columns, free_name, map_rows, materialize
from evalspark.llm.measures import COUNTS, columns

ALPHA, DELTA = 0.02, 0.05
STRATA = 64
#: Part of the tightest proven cutoff's catch that a looser one must reach.
NEARLY = 0.95
#: ratio -> (numerator, denominator)
RATIOS = {
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "caps": ("n_caps", "n_words"),
    "exclaims": ("n_exclaims", "n_words"),
}
#: Candidates from loose to tight.
CUTOFFS = (0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04, 0.02)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of ``n`` trials, as the incomplete beta function I(1 - p; n - k, k + 1)."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 10_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + t / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def measured(docs: DataFrame, *also: str) -> DataFrame:
    """The named columns, lang and the counts of every text."""
    kept = list(dict.fromkeys([*also, "lang"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    schema += "".join(f", {c} long" for c in COUNTS)
    source = docs.select(*dict.fromkeys([*kept, "text"]))
    return map_rows(source, lambda x: {c: x[c] for c in kept} | columns(x["text"]), schema)


def _ratio(name: str) -> Column:
    above, below = RATIOS[name]
    return F.col(above) / F.greatest(F.col(below), F.lit(1))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def cutoffs(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """stratum -> rule -> cutoff, for what is proven (a stratum without any is empty; ``*`` holds all others).  ``rows`` are measured documents.

    The driver sees counts only: strata x rules x candidates.
    """
    quality = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_good"))
    ratios = F.array(*[F.struct(F.lit(r).alias("rule"), _ratio(r).alias("value")) for r in RATIOS])
    known = rows.filter(~base_failed()).select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), ratios.alias("ratios")).join(quality, "doc_id")
    often = [r["stratum"] for r in known.groupBy("stratum").count().orderBy(F.desc("count"), "stratum").limit(STRATA).collect()]
    over = sum((F.col("r.value") > c).cast("int") for c in CUTOFFS)
    stratum = F.when(F.col("stratum").isin(often), F.col("stratum")).otherwise("*") if often else F.lit("*")
    counts: dict[str, dict[str, dict[bool, list[int]]]] = {}
    table = known.select(stratum.alias("stratum"), "_good", F.explode("ratios").alias("r")).select("stratum", "r.rule", (F.col("_good") == 1).alias("good"), over.alias("over"))
    for r in table.groupBy("stratum", "rule", "good", "over").count().collect():
        n = counts.setdefault(r["stratum"], {}).setdefault(r["rule"], {True: [0] * (len(CUTOFFS) + 1), False: [0] * (len(CUTOFFS) + 1)})
        n[r["good"]][r["over"]] += r["count"]
    tests = len(RATIOS) * len(counts)
    out: dict[str, dict[str, float]] = {s: {} for s in often}
    for s, rules in counts.items():
        out.setdefault(s, {})
        for rule, n in rules.items():
            # a document is rejected by the tightest ``over`` candidates
            rejects = {g: [sum(n[g][len(CUTOFFS) - i :]) for i in range(len(CUTOFFS))] for g in n}
            proven = []
            for i in range(len(CUTOFFS)):
                if binomial_cdf(rejects[True][i], sum(n[True]), alpha / len(RATIOS)) > delta / tests:
                    break
                proven.append(i)
            if proven and rejects[False][proven[-1]]:
                i = next(i for i in proven if rejects[False][i] >= NEARLY * rejects[False][proven[-1]])
                out[s][rule] = CUTOFFS[i]
    return out


def kept(table: dict[str, dict[str, float]]) -> Column:
    """False for base failures and for what a proven cutoff rejects."""
    bad = base_failed()
    if table:
        own = F.coalesce(F.col("lang"), F.lit(""))
        stratum = F.when(own.isin(sorted(table)), own).otherwise("*")
        for rule in RATIOS:
            for s, cuts in sorted(table.items()):
                if rule in cuts:
                    bad = bad | ((stratum == s) & (_ratio(rule) > cuts[rule]))
    return ~bad


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, in the same columns, whatever their names.

    Every text is measured once; the rows are written with their measures, so
    that the cutoffs and the verdicts read the same ones.
    """
    name = free_name(docs, "measures")

    def count(x):
        got = columns(x["text"])
        return {name: [dict(zip(got, row)) for row in zip(*got.values())]}

    fields = ", ".join(f"{c}: long" for c in COUNTS)
    rows = materialize(add_columns(docs, ["text"], count, f"{name} struct<{fields}>"), "measured")
    table = cutoffs(rows.select("doc_id", "lang", f"{name}.*"), labels)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return rows.select(row, "lang", f"{name}.*").filter(kept(table)).select("row.*")
