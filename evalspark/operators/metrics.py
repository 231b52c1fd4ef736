"""From the results of a run to its metric log: what the gate, the searches, the reruns, the grades and the captures report.

Each section is one or two aggregations to a row per group, turned into log
rows ``(by…, run_name, kind, key, value)`` under the keys that a scorecard
reads (``scorecard.LAYOUT``).  A value that was not measured is not logged, so
a scorecard never shows a rate that nobody measured.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from . import diversity, gate, regress, reliability as rel, scorecard as sc, validate as va

_KEYS = ("run_name", "kind", "key", "value")


def verification_section(gated: DataFrame, by: list[str]) -> DataFrame:
    """Tiers of gated items.  A group without a gated item has no section."""
    names = ("n_gated", "verified_fraction", "gold_count", "verified_count", "quarantine_count", "repaired_count", "mean_panel_agreement")
    found = gate.gate_metrics(gated, by).where("n_gated > 0")
    return sc.metric_rows(found, by, sc.VERIFICATION, {n: n for n in names})


def quality_section(items: DataFrame, verdicts: DataFrame, by: list[str], coverage: DataFrame | None = None) -> DataFrame:
    """Health of executed items, and each judge's mean from ``verdicts`` (by…, judge, verdict boolean); ``coverage`` is (by…, column_coverage)."""
    health = va.health(items, by)
    rows = sc.metric_rows(health, by, sc.QUALITY, {n: n for n in ("fraction_sql_executes", "fraction_nonempty")}, {"n_eval_items": "n"})
    means = verdicts.groupBy(*by, "judge").agg(F.avg(F.col("verdict").cast("int")).alias("value")).where("value is not null")
    means = means.select(*by, F.lit(sc.QUALITY).alias("run_name"), F.lit("metric").alias("kind"), F.concat("judge", F.lit("/mean")).alias("key"), F.col("value").cast("string").alias("value"))
    parts = [rows, means]
    if coverage is not None:
        parts.append(sc.metric_rows(coverage, by, sc.QUALITY, {"column_coverage": "column_coverage"}))
    return reduce(DataFrame.unionByName, parts)


def realism_section(generated: DataFrame, reference: DataFrame, by: list[str], minimum: int = diversity.MIN_REFERENCE) -> DataFrame:
    """Distances of generated to reference vectors, both (by…, id, v); ``reference`` also has ``source`` (history or curated).

    Groups with too small a reference are left out.
    """
    counts = reference.groupBy(*by).agg(
        F.count("*").alias("n_reference"), F.count_if(F.col("source") == "history").alias("n_history"), F.count_if(F.col("source") == "curated").alias("n_curated")
    )
    enough = counts.where(F.col("n_reference") >= minimum)
    mine = generated.join(enough.select(*by), by, "left_semi")
    theirs = reference.select(*by, "id", "v").join(enough.select(*by), by, "left_semi")
    nn = diversity.nearest_reference(mine, theirs, by)
    summary = (
        diversity.nn_summary(nn, by)
        .join(diversity.leakage(nn, by).select(*by, "leakage_fraction", "leakage_risk"), by)
        .join(diversity.self_similarity(mine, by, "gen_self_similarity").drop("n"), by, "left")
        .join(diversity.self_similarity(theirs, by, "ref_self_similarity").drop("n"), by, "left")
        .join(enough, by)
        # a flag is written the way it is read everywhere: True or False
        .withColumn("leakage_risk", F.initcap(F.col("leakage_risk").cast("string")))
    )
    metrics = ("mean_nn_cosine", "nn_cosine_p10", "gen_self_similarity", "ref_self_similarity", "leakage_fraction")
    params = {"leakage_risk": "leakage_risk", "n_generated": "n_generated", "n_reference": "n_reference", "n_history": "n_history", "n_curated": "n_curated"}
    return sc.metric_rows(summary, by, sc.REALISM, {n: n for n in metrics}, params)


def stability_section(reruns: DataFrame, question: list[str], by: list[str], half_width_pp: float = rel.HALF_WIDTH_PP) -> DataFrame:
    """Agreement and concordance of reruns (by…, question…, run_idx, passed)."""
    found = rel.reliability(reruns, question, by, half_width_pp)
    size = reruns.groupBy(*by).agg(F.count_distinct(*question).alias("n_questions"), (F.max("run_idx") + 1).alias("m_reruns"))
    found = found.join(size, by).withColumn("max_half_pp", F.lit(float(half_width_pp))).withColumn("gateable", F.initcap(F.col("gateable").cast("string")))
    # no unit measured: no rate
    found = found.withColumn("pooled", F.when(F.col("n_units") > 0, F.col("pooled")))
    metrics = {
        "n_units": "n_units", "pooled_pass_rate": "pooled", "rerun_agreement": "rerun_agreement", "ci95_low": "ci_low", "ci95_high": "ci_high",
        "ci95_half_width_pp": "half_width_pp", "gate_max_half_width_pp": "max_half_pp", "n_needed_for_target": "n_needed",
    }
    return sc.metric_rows(found, by, sc.STABILITY, metrics, {"M_reruns": "m_reruns", "N_questions": "n_questions", "gateable": "gateable"})


def _buckets(profile: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rate and count of every bucket under keys that carry its name."""
    cells = F.array(
        F.struct(F.concat(F.lit("pass_rate_"), F.col(name)).alias("key"), F.col("pass_rate").cast("string").alias("value")),
        F.struct(F.concat(F.lit("count_"), F.col(name)).alias("key"), F.col("n").cast("double").cast("string").alias("value")),
    )
    rows = profile.where(F.col(name).isNotNull()).select(*by, F.lit(sc.REGRESSION).alias("run_name"), F.lit("metric").alias("kind"), F.inline(cells))
    return rows.where("value is not null")


def regression_section(graded: DataFrame, by: list[str]) -> DataFrame:
    """Concordance of graded answers, per difficulty and category too."""
    summary = regress.concordance(graded, by)
    metrics = {"pass_rate_deterministic": "pass_rate", "n_questions": "n_questions", "n_indeterminate": "n_indeterminate", "n_assistant_errors": "n_errors"}
    if "n_same_engine_expected" in summary.columns:
        metrics["n_same_engine_expected"] = "n_same_engine_expected"
    if "difficulty_label_matches" in graded.columns:
        summary = summary.join(regress.label_match_rate(graded, by), by)
        metrics["difficulty_label_match_rate"] = "difficulty_label_match_rate"
    levels = regress.difficulty_profile(graded, by)
    steps = regress.monotonicity(levels, by).withColumn("monotonic", F.initcap(F.col("monotonic").cast("string")))
    parts = [
        sc.metric_rows(summary, by, sc.REGRESSION, metrics),
        _buckets(regress.profile(graded, "category", "category", by), by, "category"),
        _buckets(levels, by, "difficulty"),
        sc.metric_rows(steps, by, sc.REGRESSION, {"difficulty_monotonicity_violations": "violations"}, {"difficulty_monotonic": "monotonic"}),
    ]
    return reduce(DataFrame.unionByName, parts)


def metric_log(*sections: DataFrame) -> DataFrame:
    """All sections as one log."""
    return reduce(DataFrame.unionByName, sections)
