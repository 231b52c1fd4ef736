"""Scorecards from logged metrics, run lists and check reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .profile import first_rows
from .regress import DIFFICULTY_ORDER

# --- fixed values -----------------------------------------------------------
REALISM, STABILITY = "eval_set_realism", "eval_set_stability"
REGRESSION = "assistant_regression"
QUALITY, VERIFICATION = "eval_set_quality", "eval_set_verification"
SECTIONS = (REALISM, STABILITY, REGRESSION, QUALITY, VERIFICATION)
NEWEST = 12
DETAIL_CUT = 400

# report column -> (section, metric or parameter, keys in order of preference)
LAYOUT = {
    "diversity_mean_nn_cosine": (REALISM, "metric", ("mean_nn_cosine", "p_at_h")),
    "diversity_nn_cosine_p10": (REALISM, "metric", ("nn_cosine_p10", "p_at_h_p10")),
    "diversity_gen_self_similarity": (REALISM, "metric", ("gen_self_similarity", "self_sim")),
    "diversity_ref_self_similarity": (REALISM, "metric", ("ref_self_similarity", "historical_self_sim")),
    "diversity_leakage_risk": (REALISM, "param", ("leakage_risk",)),
    "diversity_n_history": (REALISM, "param", ("n_history",)),
    "diversity_n_curated": (REALISM, "param", ("n_curated",)),
    "diversity_n_reference": (REALISM, "param", ("n_reference",)),
    "reliability_rerun_agreement": (STABILITY, "metric", ("rerun_agreement",)),
    "reliability_half_pp": (STABILITY, "metric", ("ci95_half_width_pp",)),
    "reliability_pooled": (STABILITY, "metric", ("pooled_pass_rate",)),
    "reliability_gateable": (STABILITY, "param", ("gateable",)),
    "reliability_m_reruns": (STABILITY, "param", ("M_reruns",)),
    "reliability_n_questions": (STABILITY, "param", ("N_questions",)),
    "reliability_n_units": (STABILITY, "metric", ("n_units",)),
    "reliability_n_needed": (STABILITY, "metric", ("n_needed_for_target",)),
    "reliability_max_half_pp": (STABILITY, "metric", ("gate_max_half_width_pp",)),
    "verification_verified_fraction": (VERIFICATION, "metric", ("verified_fraction",)),
    "verification_gold_count": (VERIFICATION, "metric", ("gold_count",)),
    "verification_verified_count": (VERIFICATION, "metric", ("verified_count",)),
    "verification_quarantine_count": (VERIFICATION, "metric", ("quarantine_count",)),
    "verification_repaired_count": (VERIFICATION, "metric", ("repaired_count",)),
    "verification_mean_panel_agreement": (VERIFICATION, "metric", ("mean_panel_agreement",)),
    "verification_n_gated": (VERIFICATION, "metric", ("n_gated",)),
    "quality_sql_executes": (QUALITY, "metric", ("fraction_sql_executes",)),
    "quality_nonempty": (QUALITY, "metric", ("fraction_nonempty",)),
    "quality_clarity": (QUALITY, "metric", ("question_clarity/mean",)),
    "quality_sql_answers": (QUALITY, "metric", ("sql_answers_question/mean",)),
    "quality_grounded": (QUALITY, "metric", ("grounded_literals/mean",)),
    "regression_pass_rate": (REGRESSION, "metric", ("pass_rate_deterministic",)),
    "regression_n_questions": (REGRESSION, "metric", ("n_questions",)),
    "regression_n_indeterminate": (REGRESSION, "metric", ("n_indeterminate",)),
    "regression_n_same_engine": (REGRESSION, "metric", ("n_same_engine_expected",)),
    "regression_difficulty_monotonic": (REGRESSION, "param", ("difficulty_monotonic",)),
    "regression_label_match_rate": (REGRESSION, "metric", ("difficulty_label_match_rate",)),
}
COMPUTED = {"diversity_computed": REALISM, "reliability_computed": STABILITY, "verification_computed": VERIFICATION}
# ----------------------------------------------------------------------------


def latest_sections(runs: DataFrame, jobs: DataFrame, newest: int = NEWEST) -> DataFrame:
    """Per job the newest run of each section, with how it was attributed.

    ``runs`` is ``(experiment, job_run_id, run_id, run_name, start_time)``,
    ``jobs`` is ``(job_run_id, experiment)``.  A job's own tagged runs count
    ("exact"); only a job without any takes the newest of its experiment
    ("latest").  The cut to the newest runs comes before the choice per
    section, so an old section may be absent; each task limits its rows to the
    cut before the shuffle.
    """
    order = [F.desc("start_time"), F.desc("run_id")]
    cols = ["run_id", "run_name", "start_time"]
    own = runs.where(F.col("job_run_id").isNotNull())
    tagged = first_rows(own.select("job_run_id", "experiment", *cols), ["experiment", "job_run_id"], order, newest)
    exact = jobs.join(tagged, ["experiment", "job_run_id"]).select("job_run_id", "experiment", *cols, F.lit("exact").alias("attribution"))
    untagged = jobs.join(own.select("experiment", "job_run_id").distinct(), ["experiment", "job_run_id"], "left_anti")
    recent = first_rows(runs.select("experiment", *cols), ["experiment"], order, newest)
    latest = untagged.join(recent, "experiment").select("job_run_id", "experiment", *cols, F.lit("latest").alias("attribution"))
    return (
        exact.unionByName(latest)
        .where(F.col("run_name").isin(*SECTIONS))
        .groupBy("job_run_id", "experiment", "run_name", "attribution")
        .agg(F.max_by(F.struct("run_id", "start_time"), F.struct("start_time", "run_id")).alias("_r"))
        .select("job_run_id", "experiment", "run_name", "attribution", "_r.run_id", "_r.start_time")
    )


def bucket_split(facts: DataFrame) -> DataFrame:
    """Bucket metrics of the grading section: which bucket, rate or count, by difficulty or category."""
    key = F.col("key")
    rate = key.startswith("pass_rate_")
    bucket = F.when(rate, F.replace(key, F.lit("pass_rate_"), F.lit(""))).otherwise(F.replace(key, F.lit("count_"), F.lit("")))
    return (
        facts.where(rate | key.startswith("count_"))
        .withColumn("bucket", bucket)
        .where(~(rate & (F.col("bucket") == "deterministic")))
        .withColumn("measure", F.when(rate, "pass_rate").otherwise("n"))
        .withColumn("grouping", F.when(F.col("bucket").isin(*DIFFICULTY_ORDER), "by_difficulty").otherwise("by_category"))
    )


def bucket_maps(facts: DataFrame, by: list[str]) -> DataFrame:
    """The same as one row per group with four maps; keys are few, one per bucket."""
    split = bucket_split(facts).groupBy(*by, "grouping", "measure", "bucket").agg(F.max("value").alias("value"))

    def bag(grouping: str, measure: str) -> Column:
        entry = F.when((F.col("grouping") == grouping) & (F.col("measure") == measure), F.struct("bucket", "value"))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    return split.groupBy(*by).agg(
        bag("by_difficulty", "pass_rate").alias("by_difficulty"),
        bag("by_category", "pass_rate").alias("by_category"),
        bag("by_difficulty", "n").alias("by_difficulty_n"),
        bag("by_category", "n").alias("by_category_n"),
    )


def scorecard(facts: DataFrame, by: list[str]) -> DataFrame:
    """One report row per job from ``(by…, run_name, kind, key, value string)``.

    All report columns come from one conditional aggregation; older key names
    serve where the current one is absent.
    """

    def value(section: str, kind: str, keys: tuple[str, ...]) -> Column:
        def hit(k: str) -> Column:
            here = (F.col("run_name") == section) & (F.col("kind") == kind) & (F.col("key") == k)
            return F.max(F.when(here, F.col("value").try_cast("double") if kind == "metric" else F.col("value")))

        return F.coalesce(*[hit(k) for k in keys])

    return facts.groupBy(*by).agg(
        *[value(*spec).alias(name) for name, spec in LAYOUT.items()],
        *[F.bool_or(F.col("run_name") == section).alias(name) for name, section in COMPUTED.items()],
    )


def readiness(jobs: DataFrame, sections: DataFrame) -> DataFrame:
    """Per job: ready or why not, and the sorted list of sections found (five at most)."""
    found = sections.groupBy("job_run_id", "experiment").agg(
        F.array_join(F.array_sort(F.collect_set("run_name")), ",").alias("_s"), F.min("attribution").alias("attribution")
    )
    j = jobs.join(found, ["job_run_id", "experiment"], "left")
    reason = F.when(F.coalesce("experiment", F.lit("")) == "", "no experiment").when(F.col("_s").isNull(), "no scorecard runs found yet")
    return j.select(
        "job_run_id", "experiment", reason.isNull().alias("ready"), F.coalesce(reason, F.lit("")).alias("reason"),
        F.coalesce("_s", F.lit("")).alias("available_sections"), "attribution",
    )


def merge_runs(index: DataFrame, session: DataFrame, order: bool = True) -> DataFrame:
    """Indexed runs, plus session runs whose id the index lacks, newest first."""
    cols = ["run_id", "run_name", "experiment_path", "submitted_at", "submitted_by"]
    extra = session.join(index.select("run_id"), "run_id", "left_anti")
    merged = index.select(*cols).unionByName(extra.select(*cols))
    return merged.orderBy(F.desc("submitted_at"), "run_id") if order else merged


def check_rows(checks: DataFrame) -> DataFrame:
    """Check results with the detail text cut to its length limit."""
    return checks.withColumn("detail", F.substring(F.coalesce("detail", F.lit("")), 1, DETAIL_CUT))


def check_report(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    return checks.groupBy(*(by or []), "status").agg(F.count("*").alias("n"))


def failed_checks(checks: DataFrame) -> DataFrame:
    return check_rows(checks.where(F.col("status") == "FAIL"))


def metric_rows(summary: DataFrame, by: list[str], run_name: str, metrics: dict[str, str], params: dict[str, str] | None = None) -> DataFrame:
    """A wide summary row as log rows ``(by…, run_name, kind, key, value)``; NULL metrics are not logged."""
    cells = [F.struct(F.lit("metric").alias("kind"), F.lit(k).alias("key"), F.col(c).cast("double").cast("string").alias("value")) for k, c in metrics.items()]
    cells += [F.struct(F.lit("param").alias("kind"), F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in (params or {}).items()]
    return (
        summary.select(*by, F.lit(run_name).alias("run_name"), F.inline(F.array(*cells))).where(F.col("value").isNotNull())
    )
