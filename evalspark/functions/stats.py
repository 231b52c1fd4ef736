"""Interval arithmetic and exact quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import attach
from .text import col_of

Z95 = 1.96  # fixed value
MAX_SAMPLE = 100_000  # fixed value
BINS = 4096


def _num(x) -> Column:
    return x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(float(x)))


def wilson_half(p, n, z: float = Z95) -> Column:
    """Half-width of the Wilson interval of ``p`` over ``n`` trials; 0 without trials."""
    p, n = _num(p), _num(n).cast("double")
    spread = F.sqrt(p * (1.0 - p) / n + F.lit(z * z) / (4.0 * n * n))
    return F.when(n > 0, F.lit(z) * spread / (1.0 + F.lit(z * z) / n)).otherwise(F.lit(0.0))


def wilson_centre(p, n, z: float = Z95) -> Column:
    p, n = _num(p), _num(n).cast("double")
    return F.when(n > 0, (p + z * z / (2.0 * n)) / (1.0 + z * z / n)).otherwise(F.lit(0.0))


def wilson_bounds(p, n, z: float = Z95) -> tuple[Column, Column]:
    mid, half = wilson_centre(p, n, z), wilson_half(p, n, z)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def n_for_half(p, target, floor=2, z: float = Z95) -> Column:
    """Smallest n, not below ``floor``, whose half-width reaches ``target``.

    The half-width falls as n grows, so the bound is the root of a quadratic
    in n; its two neighbours are tested to settle rounding.
    """
    p, t = _num(p), _num(target)
    start = F.greatest((col_of(floor) if not isinstance(floor, int) else F.lit(floor)).cast("bigint"), F.lit(2).cast("bigint"))
    z2 = z * z
    a = t * t
    b = 2.0 * z2 * a - z2 * p * (1.0 - p)
    c = z2 * z2 * (a - 0.25)
    root = (F.sqrt(F.greatest(b * b - 4.0 * a * c, F.lit(0.0))) - b) / (2.0 * a)
    guess = F.ceil(F.least(F.greatest(root, F.lit(2.0)), F.lit(float(MAX_SAMPLE)))).cast("bigint")
    near = [F.greatest(guess + d, F.lit(2).cast("bigint")) for d in (-1, 0, 1)]
    best = F.coalesce(*[F.when(wilson_half(p, n, z) <= t, n) for n in near], guess + 1)
    return F.when(start >= MAX_SAMPLE, start).otherwise(
        F.greatest(start, F.least(best, F.lit(MAX_SAMPLE).cast("bigint")))
    )


def exact_quantiles(
    df: DataFrame, value: str, qs: dict[str, float], by: list[str] | None = None, accuracy: int = 10_000
) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per group, safe for huge groups; ``qs`` names them.

    Three passes over the values, however many quantiles are asked for.  A
    sketch brackets the order statistics that matter (its rank error is
    bounded by n / accuracy).  A histogram of each bracket, with a fixed number
    of bins, then finds the one or two bins that hold them, and only the
    distinct values of those bins are ranked.  No group is ever gathered
    whole.  NULLs are skipped.
    """
    by, names = list(by or []), list(qs)
    v = F.col(value)
    rows = df.where(v.isNotNull()).select(*by, v.cast("double").alias("_v"))
    margin = 4.0 / accuracy
    ends = [min(1.0, max(0.0, q + d)) for q in qs.values() for d in (-margin, margin)]
    sketch = rows.groupBy(*by).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", ends, accuracy).alias("_b")
    )
    small = F.col("_n") <= 4 * accuracy  # above that the margin spans 16 ranks or more

    def bracket(i: int, q: float) -> Column:
        at = F.lit(q) * (F.col("_n") - 1)
        # a group of few rows, or a margin past an end, is bounded by its own ends
        lo = F.col("_min") if q - margin <= 0 else F.when(small, F.col("_min")).otherwise(F.col("_b")[2 * i])
        hi = F.col("_max") if q + margin >= 1 else F.when(small, F.col("_max")).otherwise(F.col("_b")[2 * i + 1])
        return F.struct(
            F.lit(i).alias("_q"), F.floor(at).cast("bigint").alias("_r0"), F.ceil(at).cast("bigint").alias("_r1"),
            (at - F.floor(at)).alias("_w"), lo.alias("_lo"), hi.alias("_hi"),
        )

    brackets = sketch.select(*by, F.array(*[bracket(i, q) for i, q in enumerate(qs.values())]).alias("_brackets"))
    near = attach(rows, brackets, by).select(*by, "_v", F.explode("_brackets").alias("_x")).select(*by, "_v", "_x.*")
    part = [*by, "_q"]
    keys = [*part, "_r0", "_r1", "_w"]
    width = F.col("_hi") - F.col("_lo")
    inside = F.least(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), width) * BINS), F.lit(BINS - 1))
    # bin -1 counts all values below the bracket
    bin_ = F.when(F.col("_v") < F.col("_lo"), F.lit(-1)).otherwise(F.coalesce(inside, F.lit(0))).cast("int")
    near = near.where(F.col("_v") <= F.col("_hi")).withColumn("_bin", bin_)

    def running(df: DataFrame, part: list[str], order: str) -> DataFrame:
        upto = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        end = F.sum("_c").over(upto)
        return df.withColumn("_end", end).withColumn("_begin", F.col("_end") - F.col("_c"))

    def holds(rank: str) -> Column:
        return (F.col("_begin") <= F.col(rank)) & (F.col(rank) < F.col("_end"))

    bins = running(near.groupBy(*keys, "_bin").agg(F.count("*").alias("_c")), keys, "_bin")
    bins = bins.where(holds("_r0") | holds("_r1")).select(*part, "_bin", F.col("_begin").alias("_base"))
    # at most two bins per group and quantile
    values = near.join(bins if by else F.broadcast(bins), [*part, "_bin"])
    counted = values.groupBy(*keys, "_bin", "_base", "_v").agg(F.count("*").alias("_c"))
    ranked = running(counted, [*keys, "_bin", "_base"], "_v")
    ranked = ranked.withColumn("_begin", F.col("_begin") + F.col("_base")).withColumn("_end", F.col("_end") + F.col("_base"))

    def pick(rank: str) -> Column:
        return F.max(F.when(holds(rank), F.col("_v")))

    x0, x1 = pick("_r0"), pick("_r1")
    picked = ranked.groupBy(*keys).agg(x0.alias("_x0"), x1.alias("_x1"))
    answer = F.when(
        F.col("_x0").isNull() | F.col("_x1").isNull(),
        F.raise_error(F.lit("quantile bracket missed its rank; raise accuracy")).cast("double"),
    ).otherwise(F.col("_x0") + (F.col("_x1") - F.col("_x0")) * F.col("_w"))
    each = picked.select(*part, answer.alias("_a"))
    return each.groupBy(*by).agg(*[F.max(F.when(F.col("_q") == i, F.col("_a"))).alias(n) for i, n in enumerate(names)])


def exact_quantile(
    df: DataFrame, value: str, q: float, by: list[str] | None = None, name: str = "quantile", accuracy: int = 10_000
) -> DataFrame:
    """One of :func:`exact_quantiles`."""
    return exact_quantiles(df, value, {name: q}, by, accuracy)
