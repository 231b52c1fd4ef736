"""Grading an assistant's answers against the expected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import parse_rows
from .gate import TRUSTED
from .match import rows_match

# --- fixed values -----------------------------------------------------------
MIN_BUCKET = 5
DIFFICULTY_ORDER = ("easy", "medium", "hard")
MONOTONE_EPS = 1e-9
SAME_ENGINE, FALLBACK = "warehouse", "spark_fallback"
# ----------------------------------------------------------------------------


def eligible(items: DataFrame) -> DataFrame:
    """Items of a trusted or absent tier that are not known to be nondeterministic."""
    out = items
    if "verify_tier" in items.columns:
        out = out.where(F.col("verify_tier").isNull() | F.col("verify_tier").isin(*TRUSTED))
    if "sql_deterministic" in items.columns:
        out = out.where(F.coalesce(F.col("sql_deterministic"), F.lit(True)))
    return out


def attach_answers(items: DataFrame, answers: DataFrame, on: list[str]) -> DataFrame:
    """Each item with its answer of run 0, the canonical run."""
    return items.join(answers.where(F.col("run_idx") == 0).drop("run_idx"), on)


def expected_source(items: DataFrame, same_engine="engine_rows_json", captured="expected_rows_json") -> DataFrame:
    """Rows to grade against: the same engine's where it answered, else the captured ones."""
    engine = parse_rows(same_engine)
    return items.withColumn("expected_rows", F.coalesce(engine, parse_rows(captured))).withColumn(
        "expected_engine", F.when(engine.isNotNull(), SAME_ENGINE).otherwise(FALLBACK)
    )


def flags(graded: DataFrame, verdict="verdict", error="answer_error") -> DataFrame:
    """``result_match`` and ``match_indeterminate``; an errored answer is indeterminate."""
    errored = F.coalesce(F.col(error), F.lit("")) != ""
    v = F.when(~errored, F.col(verdict))
    return graded.withColumn("result_match", v.eqNullSafe(True)).withColumn("match_indeterminate", v.isNull())


def grade(items: DataFrame, expected="expected_rows", actual="answer_rows", error="answer_error") -> DataFrame:
    """Row comparison and match flags of items with answers attached."""
    return flags(rows_match(items, expected, actual, "verdict"), "verdict", error)


def concordance(graded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Match rate over determinate answers (0 if there are none) and the counts behind it."""
    det = ~F.col("match_indeterminate")
    return graded.groupBy(*(by or [])).agg(
        F.count("*").alias("n_questions"),
        F.count_if(det).alias("n_determinate"),
        F.count_if(~det).alias("n_indeterminate"),
        F.count_if(F.coalesce(F.col("answer_error"), F.lit("")) != "").alias("n_errors"),
        *([F.count_if(F.col("expected_engine") == SAME_ENGINE).alias("n_same_engine_expected")] if "expected_engine" in graded.columns else []),
        F.coalesce(F.avg(F.when(det, F.col("result_match").cast("int"))), F.lit(0.0)).alias("pass_rate"),
    )


def profile(graded: DataFrame, bucket: Column | str, name: str, by: list[str] | None = None) -> DataFrame:
    """Match rate and count per bucket over determinate answers; small buckets are flagged."""
    b = F.col(bucket) if isinstance(bucket, str) else bucket
    return (
        graded.where(~F.col("match_indeterminate"))
        .groupBy(*(by or []), b.alias(name))
        .agg(F.avg(F.col("result_match").cast("int")).alias("pass_rate"), F.count("*").alias("n"))
        .withColumn("noisy", F.col("n") < MIN_BUCKET)
    )


def difficulty_profile(graded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Profile on structural difficulty, or on the self label where that column is absent."""
    source = "difficulty_structural" if "difficulty_structural" in graded.columns else "difficulty"
    return profile(graded, source, "difficulty", by)


def monotonicity(buckets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adjacent rises of the match rate from easy to hard, over buckets of five or more.

    At most three rates per group remain after one aggregation, so the
    comparison is array arithmetic and needs no window.
    """
    rates = [
        F.max(F.when((F.col("difficulty") == d) & (F.col("n") >= MIN_BUCKET), F.col("pass_rate")))
        for d in DIFFICULTY_ORDER
    ]
    s = buckets.groupBy(*(by or [])).agg(F.filter(F.array(*rates), lambda r: r.isNotNull()).alias("_r"))
    r = F.col("_r")
    rises = F.size(
        F.filter(
            F.arrays_zip(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))).alias("a"), F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))).alias("b")),
            lambda z: z["a"] + MONOTONE_EPS < z["b"],
        )
    )
    return s.select(
        *(by or []),
        F.size(r).cast("bigint").alias("n_buckets"),
        F.when(F.size(r) >= 2, rises.cast("bigint")).alias("violations"),
    ).withColumn("monotonic", F.col("violations") == 0)


def label_match_rate(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    return items.groupBy(*(by or [])).agg(
        F.avg(F.col("difficulty_label_matches").cast("int")).alias("difficulty_label_match_rate")
    )


def judge_inputs(graded: DataFrame) -> DataFrame:
    """What a judge sees of every answer that did not error; missing texts are empty."""
    blank = F.lit("")
    return graded.where(F.coalesce(F.col("answer_error"), blank) == "").select(
        "question_id", "question",
        F.coalesce("answer", blank).alias("answer"),
        F.coalesce("expected_sql", blank).alias("expected_sql"),
    )


def run_delta(before: DataFrame, after: DataFrame, on: list[str], value: str) -> DataFrame:
    """Change of one metric between two regression runs; a bucket of one run only has no delta."""
    b = before.select(*on, F.col(value).alias("before"))
    a = after.select(*on, F.col(value).alias("after"))
    return b.join(a, on, "full_outer").withColumn("delta", F.col("after") - F.col("before"))
