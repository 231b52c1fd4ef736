"""Agreement and interval statistics over repeated runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.stats import n_for_half, wilson_bounds, wilson_half

# --- fixed values -----------------------------------------------------------
AGREEMENT_FLOOR = 0.90
HALF_WIDTH_PP = 10.0
POOLED_MIN, POOLED_MAX = 0.10, 0.90
# ----------------------------------------------------------------------------


def pass_matrix(answers: DataFrame, error="answer_error", verdict="verdict") -> DataFrame:
    """Adds ``passed``: 1, 0, or NULL for an errored or undetermined run (never NaN)."""
    e = F.coalesce(F.col(error), F.lit("")) != ""
    return answers.withColumn("passed", F.when(~e, F.col(verdict).cast("int")))


def pass_matrix_wide(reruns: DataFrame, by: list[str], n_runs: int) -> DataFrame:
    """One row per question with a column per run; one aggregation, no pivot scan."""
    return reruns.groupBy(*by).agg(
        *[F.max(F.when(F.col("run_idx") == i, F.col("passed"))).alias(f"pass_run_{i}") for i in range(n_runs)]
    )


def per_question(reruns: DataFrame, by: list[str], n_runs: int) -> DataFrame:
    """Per question: each run's outcome and the mean over its valid runs."""
    return reruns.groupBy(*by).agg(
        *[F.max(F.when(F.col("run_idx") == i, F.col("passed"))).alias(f"pass_run_{i}") for i in range(n_runs)],
        F.avg("passed").alias("mean_pass"),
    )


def question_units(reruns: DataFrame, by: list[str]) -> DataFrame:
    """Per question: valid runs, least and greatest outcome, mean outcome."""
    return reruns.groupBy(*by).agg(
        F.count("passed").alias("n_valid"),
        F.min("passed").alias("lo"),
        F.max("passed").alias("hi"),
        F.avg("passed").alias("mean_pass"),
    )


def rerun_agreement(reruns: DataFrame, question: list[str], by: list[str] | None = None) -> DataFrame:
    """Share of questions with two or more valid runs whose runs all agree; NULL if there are none."""
    u = question_units(reruns, [*(by or []), *question])
    judgeable = F.col("n_valid") >= 2
    out = u.groupBy(*(by or [])).agg(
        F.count_if(judgeable & (F.col("lo") == F.col("hi"))).alias("n_unanimous"),
        F.count_if(judgeable).alias("n_judgeable"),
    )
    return out.withColumn("rerun_agreement", F.try_divide("n_unanimous", "n_judgeable"))


def question_concordance(reruns: DataFrame, question: list[str], by: list[str] | None = None) -> DataFrame:
    """Share of measured questions that pass in more than half of their valid runs; a tie fails."""
    u = question_units(reruns, [*(by or []), *question])
    out = u.groupBy(*(by or [])).agg(
        F.count_if(F.col("mean_pass") > 0.5).alias("n_pass"),
        F.count_if(F.col("n_valid") >= 1).alias("n_units"),
    )
    return out.withColumn("concordance", F.coalesce(F.try_divide("n_pass", "n_units"), F.lit(0.0)))


def reliability(
    reruns: DataFrame,
    question: list[str],
    by: list[str] | None = None,
    half_width_pp: float = HALF_WIDTH_PP,
    pooled_min: float = POOLED_MIN,
    pooled_max: float = POOLED_MAX,
) -> DataFrame:
    """Agreement, concordance, Wilson interval, needed sample size and the gate decision.

    Runs collapse to one row per question and those to one row per group; both
    steps aggregate before they shuffle.
    """
    by = list(by or [])
    u = question_units(reruns, [*by, *question])
    judgeable = F.col("n_valid") >= 2
    s = u.groupBy(*by).agg(
        F.count_if(judgeable & (F.col("lo") == F.col("hi"))).alias("n_unanimous"),
        F.count_if(judgeable).alias("n_judgeable"),
        F.count_if(F.col("mean_pass") > 0.5).alias("n_pass"),
        F.count_if(F.col("n_valid") >= 1).alias("n_units"),
    )
    s = s.withColumn("rerun_agreement", F.try_divide("n_unanimous", "n_judgeable")).withColumn(
        "pooled", F.coalesce(F.try_divide("n_pass", "n_units"), F.lit(0.0))
    )
    low, high = wilson_bounds("pooled", F.col("n_units"))
    target = half_width_pp / 100.0
    # no unit measured: the interval is [0, 0], as are its parts
    measured = F.col("n_units") > 0
    s = (
        s.withColumn("half_width", wilson_half("pooled", F.col("n_units")))
        .withColumn("ci_low", F.when(measured, low).otherwise(0.0))
        .withColumn("ci_high", F.when(measured, high).otherwise(0.0))
        .withColumn("half_width_pp", F.col("half_width") * 100)
        .withColumn("n_needed", n_for_half("pooled", F.lit(target), "n_units"))
    )
    ok = (
        F.coalesce(F.col("rerun_agreement") >= AGREEMENT_FLOOR, F.lit(False))
        & (F.col("half_width") <= target)
        & F.col("pooled").between(pooled_min, pooled_max)
    )
    return s.withColumn("gateable", ok)
