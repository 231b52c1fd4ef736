"""Trust gate, reliability, calibration and regression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cells import parse_rows
from ..functions.frames import spread
from ..functions.stats import n_for_half, wilson_bounds, wilson_half
from ..functions.text import norm_question
from ..operators import calibrate as cal
from ..operators import gate, regress, reliability as rel
from ..operators.match import rows_match_json
from .common import view, with_views
from .registry import big, query, r6

_TIER_SQL = """
    SELECT question_id, COUNT(*) FILTER (WHERE verdict) AS n_match, COUNT(verdict) AS n_votes,
           COUNT(DISTINCT CASE WHEN verdict THEN family END) AS fams
    FROM votes GROUP BY question_id"""
_TIER_CASE = """CASE WHEN n_votes = 0 THEN 'not_evaluable' WHEN n_match = n_votes AND fams >= 2 THEN 'gold'
    WHEN n_match * 2 > n_votes AND fams >= 2 THEN 'verified' ELSE 'quarantine' END"""
_DIFF_CASE = """CASE WHEN n_votes = 0 THEN 'unknown' WHEN n_match = 0 THEN 'suspect'
    WHEN n_match / n_votes >= 0.8 THEN 'easy' WHEN n_match / n_votes >= 0.4 THEN 'medium' ELSE 'hard' END"""
_TIERS = f"""tiers AS (SELECT question_id, n_match, n_votes, {_TIER_CASE} AS verify_tier,
    CASE WHEN n_votes > 0 THEN ROUND(n_match / n_votes, 2) END AS verify_agreement, {_DIFF_CASE} AS difficulty_empirical FROM ({_TIER_SQL}) c)"""
_GATED = f"""{_TIERS}, gated AS (
    SELECT i.*, COALESCE(ok, FALSE) AS ok,
           CASE WHEN ok THEN verify_tier ELSE 'not_evaluable' END AS verify_tier,
           CASE WHEN ok THEN verify_agreement END AS verify_agreement,
           CASE WHEN ok THEN difficulty_empirical ELSE 'unknown' END AS difficulty_empirical
    FROM (SELECT g.*, t.verify_tier IS NOT NULL AND sql_executes AND nonempty_result AND COALESCE(sql_deterministic, TRUE) AS ok,
                 t.verify_tier, t.verify_agreement, t.difficulty_empirical
          FROM gate_items g LEFT JOIN tiers t USING (question_id)) j
    JOIN gate_items i USING (question_id))"""
_GATED = f"""{_TIERS}, gated AS (
    SELECT question_id, question, category,
           CASE WHEN ok THEN verify_tier ELSE 'not_evaluable' END AS verify_tier,
           CASE WHEN ok THEN verify_agreement END AS verify_agreement,
           CASE WHEN ok THEN difficulty_empirical ELSE 'unknown' END AS difficulty_empirical
    FROM (SELECT g.*, t.verify_tier IS NOT NULL AND sql_executes AND nonempty_result AND COALESCE(sql_deterministic, TRUE) AS ok,
                 t.verify_tier, t.verify_agreement, t.difficulty_empirical
          FROM gate_items g LEFT JOIN tiers t USING (question_id)) j)"""
_REPAIRED = f"""{_GATED}, second AS (
    SELECT question_id, {_TIER_CASE} AS t2, CASE WHEN n_votes > 0 THEN ROUND(n_match / n_votes, 2) END AS a2, {_DIFF_CASE} AS d2
    FROM (SELECT question_id, COUNT(*) FILTER (WHERE verdict) AS n_match, COUNT(verdict) AS n_votes,
                 COUNT(DISTINCT CASE WHEN verdict THEN family END) AS fams
          FROM revotes WHERE solver_idx < 3 GROUP BY question_id) c),
repaired AS (
    SELECT question_id, category, CASE WHEN won THEN new_question ELSE question END AS question,
           CASE WHEN won THEN t2 ELSE verify_tier END AS verify_tier,
           CASE WHEN won THEN a2 ELSE verify_agreement END AS verify_agreement,
           CASE WHEN won THEN d2 ELSE difficulty_empirical END AS difficulty_empirical,
           CASE WHEN won THEN question ELSE '' END AS question_orig, won AS verify_repaired
    FROM (SELECT g.*, new_question, t2, a2, d2,
                 COALESCE(verify_tier = 'quarantine' AND new_question <> question AND t2 IN ('gold', 'verified'), FALSE) AS won
          FROM gated g LEFT JOIN rewrites USING (question_id) LEFT JOIN second USING (question_id)) w)"""
_VIEWS = ("votes", "gate_items", "revotes", "rewrites")


def gated_items(spark, d):
    return gate.gate_items(view(spark, d, "gate_items"), gate.verify_tier(view(spark, d, "votes")), ["question_id"])


def repaired_items(spark, d):
    return gate.repair_merge(gated_items(spark, d), view(spark, d, "rewrites"), view(spark, d, "revotes"), ["question_id"])


@query("t1_panel_plan", with_views("gate_items") + """
    SELECT question_id, CAST(solver_idx AS INTEGER) AS solver_idx, family, temperature
    FROM gate_items, (VALUES (0, 'gen', 0.0::DOUBLE), (1, 'judge', 0.0), (2, 'gen', 0.4), (3, 'judge', 0.5), (4, 'gen', 0.8)) p(solver_idx, family, temperature)
    WHERE solver_idx < CASE category WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 9 ELSE 5 END
      AND category <> '1-URGENT'""")
def panel_plan(spark, d):
    k = F.expr("CASE category WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 9 ELSE 5 END")
    return gate.panel_plan(view(spark, d, "gate_items"), k).select("question_id", "solver_idx", "family", "temperature")


@query("t2_gate_eligibility", with_views("gate_items") + """
    SELECT question_id, sql_executes AND nonempty_result AND COALESCE(sql_deterministic, TRUE) AS eligible FROM gate_items""")
def gate_eligibility(spark, d):
    return view(spark, d, "gate_items").select("question_id", gate.gate_eligible().alias("eligible"))


@query("t3_vote_derivation", """
    SELECT l_orderkey AS question_id, CAST(l_linenumber - 1 AS INTEGER) AS solver_idx,
           CASE l_linenumber WHEN 1 THEN TRUE WHEN 2 THEN TRUE WHEN 3 THEN o_orderstatus = 'F' WHEN 4 THEN NULL WHEN 5 THEN FALSE WHEN 6 THEN TRUE ELSE FALSE END AS verdict
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def vote_derivation(spark, d):
    items = spark.sql(
        """SELECT o_orderkey AS question_id, concat('[["', o_orderstatus, '", ', CAST(o_totalprice AS DECIMAL(18,2)), '], ["n", ', o_custkey, ']]') AS j
           FROM {orders}""", orders=_table(spark, d, "orders"))
    solved = spark.sql(
        """SELECT l_orderkey AS question_id, l_linenumber - 1 AS solver_idx,
                  CASE l_linenumber
                      WHEN 1 THEN concat('[["n", "', o_custkey, '.0"], ["', o_orderstatus, '", ', CAST(o_totalprice AS DECIMAL(18,2)), ']]')
                      WHEN 2 THEN concat('[[', CAST(o_totalprice AS DECIMAL(18,2)), ', "', o_orderstatus, '"], [', o_custkey, ', "n"]]')
                      WHEN 3 THEN concat('[["F", ', CAST(o_totalprice AS DECIMAL(18,2)), '], ["n", ', o_custkey, ']]')
                      WHEN 4 THEN NULL
                      WHEN 5 THEN '[["n", 1]]'
                      WHEN 6 THEN concat('[["', o_orderstatus, '", ', CAST(o_totalprice AS DECIMAL(18,1)), '], ["n", ', o_custkey, ']]')
                      ELSE concat('[["', o_orderstatus, '", ', CAST(o_totalprice AS DECIMAL(18,2)), '], ["n", ', o_custkey + 1, ']]') END AS j
           FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""", lineitem=_table(spark, d, "lineitem"), orders=_table(spark, d, "orders"))
    votes = gate.derive_votes(
        spread(items, "question_id").select("question_id", parse_rows("j").alias("expected_rows")),
        spread(solved, "question_id").select("question_id", "solver_idx", parse_rows("j").alias("solver_rows")),
        ["question_id"],
    )
    return votes.select("question_id", "solver_idx", "verdict")


def _table(spark, d, name):
    from .common import table

    return table(spark, d, name)


@query("t4_verify_tier", with_views("votes") + f", {_TIERS} SELECT question_id, n_match, n_votes, verify_tier FROM tiers")
def verify_tier(spark, d):
    return gate.verify_tier(view(spark, d, "votes")).select("question_id", "n_match", "n_votes", "verify_tier")


@query("t5_panel_agreement", with_views("votes") + f", {_TIERS} SELECT question_id, verify_agreement FROM tiers")
def panel_agreement(spark, d):
    return gate.verify_tier(view(spark, d, "votes")).select("question_id", "verify_agreement")


@query("t6_empirical_difficulty", with_views("votes") + f", {_TIERS} SELECT question_id, difficulty_empirical FROM tiers")
def empirical_difficulty(spark, d):
    return gate.verify_tier(view(spark, d, "votes")).select("question_id", "difficulty_empirical")


@query("t7_repair_merge", with_views(*_VIEWS) + f", {_REPAIRED} SELECT * FROM repaired")
def repair_merge(spark, d):
    return repaired_items(spark, d).select(
        "question_id", "category", "question", "verify_tier", "verify_agreement", "difficulty_empirical", "question_orig", "verify_repaired"
    )


@query("t8_gate_metrics", with_views(*_VIEWS) + f""", {_REPAIRED}
    SELECT category, COUNT(*) FILTER (WHERE verify_tier <> 'not_evaluable') AS n_gated,
           COUNT(*) FILTER (WHERE verify_tier = 'gold') AS gold_count, COUNT(*) FILTER (WHERE verify_tier = 'verified') AS verified_count,
           COUNT(*) FILTER (WHERE verify_tier = 'quarantine') AS quarantine_count, COUNT(*) FILTER (WHERE verify_repaired) AS repaired_count,
           ROUND(AVG(CASE WHEN verify_tier <> 'not_evaluable' THEN verify_agreement END), 6) AS mean_panel_agreement,
           ROUND(COALESCE(COUNT(*) FILTER (WHERE verify_tier IN ('gold', 'verified')) / NULLIF(COUNT(*) FILTER (WHERE verify_tier <> 'not_evaluable'), 0), 0), 6) AS verified_fraction
    FROM repaired GROUP BY category""")
def gate_metrics(spark, d):
    m = gate.gate_metrics(repaired_items(spark, d), ["category"])
    return m.withColumn("mean_panel_agreement", F.round("mean_panel_agreement", 6)).withColumn("verified_fraction", F.round("verified_fraction", 6))


@query("t9_review_queue", with_views(*_VIEWS) + f""", {_REPAIRED}
    SELECT ROW_NUMBER() OVER (ORDER BY difficulty_empirical = 'suspect' DESC, verify_agreement NULLS FIRST, question_id) AS place, question_id, difficulty_empirical, verify_agreement,
           difficulty_empirical = 'suspect' AS first_in_line FROM repaired WHERE verify_tier = 'quarantine'""")
def review_queue(spark, d):
    return gate.review_queue(repaired_items(spark, d)).select(
        "place", "question_id", "difficulty_empirical", "verify_agreement", (F.col("difficulty_empirical") == "suspect").alias("first_in_line")
    )


# --- reliability -------------------------------------------------------------

_UNITS = """units AS (SELECT space_id, question_id, COUNT(passed) AS n_valid, MIN(passed) AS lo, MAX(passed) AS hi, AVG(passed) AS mean_pass
    FROM reruns GROUP BY space_id, question_id)"""
_Z2 = "(1.96::DOUBLE * 1.96::DOUBLE)"


def _half(p: str, n: str) -> str:
    return f"(CASE WHEN {n} > 0 THEN 1.96::DOUBLE * SQRT({p} * (1 - {p}) / {n} + {_Z2} / (4.0::DOUBLE * {n} * {n})) / (1 + {_Z2} / {n}) ELSE 0::DOUBLE END)"


_SPACE = f"""{_UNITS}, spaces AS (
    SELECT space_id, COUNT(*) FILTER (WHERE n_valid >= 2 AND lo = hi) AS n_unanimous, COUNT(*) FILTER (WHERE n_valid >= 2) AS n_judgeable,
           COUNT(*) FILTER (WHERE mean_pass > 0.5) AS n_pass, COUNT(*) FILTER (WHERE n_valid >= 1) AS n_units
    FROM units GROUP BY space_id), rates AS (
    SELECT *, n_unanimous::DOUBLE / NULLIF(n_judgeable, 0) AS rerun_agreement, COALESCE(n_pass::DOUBLE / NULLIF(n_units, 0), 0) AS pooled FROM spaces),
    wide AS (SELECT *, {_half('pooled', 'n_units')} AS half,
                    (pooled + {_Z2} / (2.0::DOUBLE * n_units)) / (1 + {_Z2} / n_units) AS centre FROM rates)"""


@query("l1_pass_matrix", with_views("answers") + """
    SELECT question_id, CAST(CASE WHEN answer_error = '' THEN CAST(verdict AS INTEGER) END AS INTEGER) AS passed FROM answers""")
def pass_matrix(spark, d):
    return rel.pass_matrix(view(spark, d, "answers")).select("question_id", "passed")


@query("l1_pass_matrix_wide", with_views("reruns") + """
    SELECT space_id, question_id, MAX(passed) FILTER (WHERE run_idx = 0) AS pass_run_0, MAX(passed) FILTER (WHERE run_idx = 1) AS pass_run_1,
           MAX(passed) FILTER (WHERE run_idx = 2) AS pass_run_2 FROM reruns GROUP BY space_id, question_id""")
def pass_matrix_wide(spark, d):
    return rel.pass_matrix_wide(view(spark, d, "reruns"), ["space_id", "question_id"], 3)


@query("l2_rerun_agreement", with_views("reruns") + f""", {_SPACE}
    SELECT space_id, n_unanimous, n_judgeable, ROUND(rerun_agreement, 6) AS rerun_agreement FROM rates""")
def rerun_agreement(spark, d):
    return rel.rerun_agreement(view(spark, d, "reruns"), ["question_id"], ["space_id"]).withColumn("rerun_agreement", F.round("rerun_agreement", 6))


@query("l3_question_concordance", with_views("reruns") + f", {_SPACE} SELECT space_id, n_pass, n_units, ROUND(pooled, 6) AS concordance FROM rates")
def question_concordance(spark, d):
    return rel.question_concordance(view(spark, d, "reruns"), ["question_id"], ["space_id"]).withColumn("concordance", F.round("concordance", 6))


@query("l4_wilson", with_views("reruns") + f""", {_SPACE}
    SELECT space_id, ROUND(half, 6) AS half_width, ROUND(CASE WHEN n_units > 0 THEN GREATEST(0, centre - half) ELSE 0 END, 6) AS ci_low,
           ROUND(CASE WHEN n_units > 0 THEN LEAST(1, centre + half) ELSE 0 END, 6) AS ci_high FROM wide""")
def wilson(spark, d):
    c = rel.question_concordance(view(spark, d, "reruns"), ["question_id"], ["space_id"])
    low, high = wilson_bounds("concordance", F.col("n_units"))
    some = F.col("n_units") > 0
    return c.select(
        "space_id", r6(wilson_half("concordance", F.col("n_units")), "half_width"),
        r6(F.when(some, low).otherwise(0.0), "ci_low"), r6(F.when(some, high).otherwise(0.0), "ci_high"),
    )


@query("l5_sample_size", with_views("reruns") + f""", {_SPACE}, targets AS (SELECT UNNEST([0.05::DOUBLE, 0.10::DOUBLE]) AS target),
    ns AS (SELECT UNNEST(RANGE(2, 2000)) AS n), ps AS (SELECT DISTINCT pooled, target FROM rates, targets),
    best AS (SELECT pooled, target, MIN(n) AS n FROM ps, ns WHERE {_half('pooled', 'n')} <= target GROUP BY pooled, target)
    SELECT space_id, target, CAST(GREATEST(n, n_units, 2) AS BIGINT) AS n_needed FROM rates JOIN best USING (pooled)""")
def sample_size(spark, d):
    c = rel.question_concordance(view(spark, d, "reruns"), ["question_id"], ["space_id"])
    t = c.withColumn("target", F.explode(F.array(F.lit(0.05), F.lit(0.10))))
    return t.select("space_id", "target", n_for_half("concordance", F.col("target"), F.col("n_units")).alias("n_needed"))


@query("l6_gate_decision", with_views("reruns") + f""", {_SPACE}
    SELECT space_id, n_units, ROUND(pooled, 6) AS pooled, ROUND(half * 100, 6) AS half_width_pp,
           COALESCE(rerun_agreement >= 0.9, FALSE) AND half <= 0.10 AND pooled BETWEEN 0.10 AND 0.90 AS gateable FROM wide""")
def gate_decision(spark, d):
    r = rel.reliability(view(spark, d, "reruns"), ["question_id"], ["space_id"])
    return r.select("space_id", "n_units", r6("pooled"), r6("half_width_pp"), "gateable")


@query("l7_per_question", with_views("reruns") + """
    SELECT space_id, question_id, MAX(passed) FILTER (WHERE run_idx = 0) AS pass_run_0, MAX(passed) FILTER (WHERE run_idx = 1) AS pass_run_1,
           MAX(passed) FILTER (WHERE run_idx = 2) AS pass_run_2, ROUND(AVG(passed), 6) AS mean_pass FROM reruns GROUP BY space_id, question_id""")
def per_question(spark, d):
    return rel.per_question(view(spark, d, "reruns"), ["space_id", "question_id"], 3).withColumn("mean_pass", F.round("mean_pass", 6))


# --- calibration -------------------------------------------------------------

_BITS = """bits AS (SELECT judge, CASE WHEN LOWER(TRIM(judge_label)) IN ('1','true','pass','yes','y','t') THEN 1 ELSE 0 END AS j,
    CASE WHEN LOWER(TRIM(human_label)) IN ('1','true','pass','yes','y','t') THEN 1 ELSE 0 END AS h FROM judge_labels),
    stats AS (SELECT judge, COUNT(*) AS n, AVG(CASE WHEN j = h THEN 1 ELSE 0 END) AS raw_agreement, AVG(j) AS judge_pos_rate, AVG(h) AS human_pos_rate FROM bits GROUP BY judge),
    kappas AS (SELECT *, CASE WHEN judge_pos_rate * human_pos_rate + (1 - judge_pos_rate) * (1 - human_pos_rate) >= 1 THEN 1.0
        ELSE (raw_agreement - (judge_pos_rate * human_pos_rate + (1 - judge_pos_rate) * (1 - human_pos_rate)))
             / (1 - (judge_pos_rate * human_pos_rate + (1 - judge_pos_rate) * (1 - human_pos_rate))) END::DOUBLE AS kappa FROM stats)"""


@query("k1_label_coding", with_views("judge_labels") + """
    SELECT item_id, judge, CASE WHEN LOWER(TRIM(judge_label)) IN ('1','true','pass','yes','y','t') THEN 1 ELSE 0 END AS judge_bit,
           CASE WHEN LOWER(TRIM(human_label)) IN ('1','true','pass','yes','y','t') THEN 1 ELSE 0 END AS human_bit FROM judge_labels""")
def label_coding(spark, d):
    return cal.code_labels(view(spark, d, "judge_labels"))[0].select("item_id", "judge", "judge_bit", "human_bit")


@query("k2_kappa", with_views("judge_labels") + f", {_BITS} SELECT judge, ROUND(kappa, 6) AS kappa FROM kappas")
def kappa(spark, d):
    return cal.calibrate(view(spark, d, "judge_labels")).select("judge", r6("kappa"))


@query("k3_agreement", with_views("judge_labels") + f""", {_BITS}
    SELECT judge, n, ROUND(raw_agreement, 6) AS raw_agreement, ROUND(judge_pos_rate, 6) AS judge_pos_rate, ROUND(human_pos_rate, 6) AS human_pos_rate FROM kappas""")
def agreement(spark, d):
    return cal.calibrate(view(spark, d, "judge_labels")).select("judge", "n", r6("raw_agreement"), r6("judge_pos_rate"), r6("human_pos_rate"))


@query("k4_verdict", with_views("judge_labels") + f""", {_BITS}
    SELECT judge, n >= 10 AND human_pos_rate NOT IN (0, 1) AS gated,
           CASE WHEN n >= 10 AND human_pos_rate IN (0, 1) THEN 'not calibratable (single-class human labels)' WHEN n < 10 THEN '—'
                WHEN kappa >= 0.6 THEN 'OK' ELSE 'BELOW κ 0.6' END AS verdict FROM kappas""")
def verdict(spark, d):
    return cal.calibrate(view(spark, d, "judge_labels")).select("judge", "gated", "verdict")


@query("k4_overall", with_views("judge_labels") + f""", {_BITS}
    SELECT COUNT(*) AS n_judges, COUNT(*) FILTER (WHERE n >= 10 AND human_pos_rate NOT IN (0, 1) AND kappa < 0.6) AS n_below,
           COUNT(*) FILTER (WHERE n >= 10 AND human_pos_rate NOT IN (0, 1) AND kappa < 0.6) = 0 AS passed FROM kappas""")
def overall(spark, d):
    return cal.calibration_passes(cal.calibrate(view(spark, d, "judge_labels")))


# --- regression --------------------------------------------------------------


@query("r1_eligible", with_views("runs") + """
    SELECT question_id FROM runs WHERE (verify_tier IS NULL OR verify_tier IN ('gold', 'verified')) AND COALESCE(sql_deterministic, TRUE)""")
def eligible(spark, d):
    return regress.eligible(view(spark, d, "runs")).select("question_id")


@query("r2_attach_answers", with_views("runs", "run_answers") + """
    SELECT question_id, category, answer_rows_id FROM runs JOIN run_answers USING (question_id) WHERE run_idx = 0""")
def attach_answers(spark, d):
    items = view(spark, d, "runs").select("question_id", "category")
    return regress.attach_answers(items, view(spark, d, "run_answers"), ["question_id"]).select("question_id", "category", "answer_rows_id")


@query("r3_expected_source", with_views("pairs") + """
    SELECT question_id, CASE WHEN kind IN ('3-MEDIUM/O', '5-LOW/O') THEN 'spark_fallback' ELSE 'warehouse' END AS expected_engine,
           CAST(CASE WHEN kind IN ('3-MEDIUM/F') THEN 1 WHEN kind = '4-NOT SPECIFIED/F' THEN 0 WHEN kind = '5-LOW/P' THEN 2 ELSE 2 END AS INTEGER) AS n_rows FROM pairs""")
def expected_source(spark, d):
    p = view(spark, d, "pairs").select(
        "question_id", F.col("answer_json").alias("engine_rows_json"), F.col("expected_json").alias("expected_rows_json")
    )
    return regress.expected_source(p).select("question_id", "expected_engine", F.size("expected_rows").alias("n_rows"))


_VERDICT = """CASE WHEN kind IN ('1-URGENT/F', '1-URGENT/O', '1-URGENT/P', '2-HIGH/O', '5-LOW/F') THEN TRUE
    WHEN kind IN ('3-MEDIUM/P', '4-NOT SPECIFIED/F', '5-LOW/P') THEN NULL ELSE FALSE END"""


@query("r4_match_flags", with_views("pairs") + f"""
    SELECT question_id, COALESCE(v, FALSE) AS result_match, v IS NULL AS match_indeterminate
    FROM (SELECT question_id, CASE WHEN o_totalprice > 400000 THEN NULL ELSE {_VERDICT} END AS v FROM pairs JOIN orders ON o_orderkey = question_id) x""")
def match_flags(spark, d):
    errors = _table(spark, d, "orders").select(
        F.col("o_orderkey").alias("question_id"), F.when(F.col("o_totalprice") > 400000, "timeout").otherwise("").alias("answer_error")
    )
    p = view(spark, d, "pairs").join(errors, "question_id")
    p = p.select("question_id", "answer_error", parse_rows("expected_json").alias("expected_rows"), parse_rows("answer_json").alias("answer_rows"))
    return regress.grade(p).select("question_id", "result_match", "match_indeterminate")


@query("r5_concordance", with_views("graded") + """
    SELECT space_id, COUNT(*) AS n_questions, COUNT(*) FILTER (WHERE NOT match_indeterminate) AS n_determinate,
           COUNT(*) FILTER (WHERE match_indeterminate) AS n_indeterminate, COUNT(*) FILTER (WHERE answer_error <> '') AS n_errors,
           ROUND(COALESCE(AVG(CASE WHEN NOT match_indeterminate THEN CAST(result_match AS INTEGER) END), 0), 6) AS pass_rate
    FROM graded GROUP BY space_id""")
def concordance(spark, d):
    return regress.concordance(view(spark, d, "graded"), ["space_id"]).withColumn("pass_rate", F.round("pass_rate", 6))


@query("r5_same_engine", with_views("pairs") + f"""
    SELECT COUNT(*) AS n_questions, COUNT(v) AS n_determinate, COUNT(*) - COUNT(v) AS n_indeterminate, CAST(0 AS BIGINT) AS n_errors,
           COUNT(*) FILTER (WHERE kind NOT IN ('3-MEDIUM/O', '5-LOW/O')) AS n_same_engine_expected, ROUND(AVG(CAST(v AS INTEGER)), 6) AS pass_rate
    FROM (SELECT kind, CASE WHEN kind IN ('4-NOT SPECIFIED/F') THEN NULL ELSE TRUE END AS v FROM pairs) x""")
def same_engine(spark, d):
    """Answers that repeat the rows they are graded against."""
    p = view(spark, d, "pairs").select("question_id", F.col("answer_json").alias("engine_rows_json"), F.col("expected_json").alias("expected_rows_json"))
    graded = regress.grade(regress.expected_source(p).withColumn("answer_rows", F.col("expected_rows")).withColumn("answer_error", F.lit("")))
    return regress.concordance(graded).withColumn("pass_rate", F.round("pass_rate", 6))


_PROFILE = """SELECT {0}, ROUND(AVG(CAST(result_match AS INTEGER)), 6) AS pass_rate, COUNT(*) AS n, COUNT(*) < 5 AS noisy
    FROM graded WHERE NOT match_indeterminate GROUP BY ALL"""


@query("r6_category_profile", with_views("graded") + _PROFILE.format("space_id, category"))
def category_profile(spark, d):
    return regress.profile(view(spark, d, "graded"), "category", "category", ["space_id"]).withColumn("pass_rate", F.round("pass_rate", 6))


@query("r7_difficulty_profile", with_views("graded") + _PROFILE.format("space_id, difficulty_structural AS difficulty"))
def difficulty_profile(spark, d):
    return regress.difficulty_profile(view(spark, d, "graded"), ["space_id"]).withColumn("pass_rate", F.round("pass_rate", 6))


@query("r7_difficulty_fallback", with_views("graded") + _PROFILE.format("category, difficulty"))
def difficulty_fallback(spark, d):
    g = view(spark, d, "graded").drop("difficulty_structural")
    return regress.difficulty_profile(g, ["category"]).withColumn("pass_rate", F.round("pass_rate", 6))


@query("r8_monotonicity", with_views("graded") + """, prof AS (
    SELECT space_id, difficulty_structural AS difficulty, AVG(CAST(result_match AS INTEGER)) AS r, COUNT(*) AS n,
           CASE difficulty_structural WHEN 'easy' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS k
    FROM graded WHERE NOT match_indeterminate GROUP BY ALL),
    steps AS (SELECT *, LAG(r) OVER (PARTITION BY space_id ORDER BY k) AS before FROM prof WHERE n >= 5)
    SELECT s.space_id, COUNT(t.k) AS n_buckets, CASE WHEN COUNT(t.k) >= 2 THEN CAST(COUNT(*) FILTER (WHERE before + 1e-9 < r) AS BIGINT) END AS violations,
           CASE WHEN COUNT(t.k) >= 2 THEN COUNT(*) FILTER (WHERE before + 1e-9 < r) = 0 END AS monotonic
    FROM (SELECT DISTINCT space_id FROM prof) s LEFT JOIN steps t USING (space_id) GROUP BY s.space_id""")
def monotonicity(spark, d):
    return regress.monotonicity(regress.difficulty_profile(view(spark, d, "graded"), ["space_id"]), ["space_id"])


@query("r9_label_match_rate", with_views("graded") + """
    SELECT space_id, ROUND(AVG(CAST(difficulty_label_matches AS INTEGER)), 6) AS difficulty_label_match_rate FROM graded GROUP BY space_id""")
def label_match_rate(spark, d):
    return regress.label_match_rate(view(spark, d, "graded"), ["space_id"]).withColumn(
        "difficulty_label_match_rate", F.round("difficulty_label_match_rate", 6)
    )


@query("r10_judge_inputs", with_views("graded") + """
    SELECT question_id, question, COALESCE(answer, '') AS answer, COALESCE(expected_sql, '') AS expected_sql FROM graded WHERE answer_error = ''""")
def judge_inputs(spark, d):
    return regress.judge_inputs(view(spark, d, "graded"))


@query("r11_run_delta", with_views("graded") + """, b AS (SELECT space_id, category, AVG(CAST(result_match AS INTEGER)) AS r FROM graded
        WHERE NOT match_indeterminate AND difficulty = 'easy' GROUP BY ALL),
    a AS (SELECT space_id, category, AVG(CAST(result_match AS INTEGER)) AS r FROM graded WHERE NOT match_indeterminate AND difficulty <> 'easy' GROUP BY ALL)
    SELECT space_id, category, ROUND(b.r, 6) AS before, ROUND(a.r, 6) AS after, ROUND(a.r - b.r, 6) AS delta FROM b FULL JOIN a USING (space_id, category)""")
def run_delta(spark, d):
    g = view(spark, d, "graded")
    b = regress.profile(g.where("difficulty = 'easy'"), "category", "category", ["space_id"])
    a = regress.profile(g.where("difficulty <> 'easy'"), "category", "category", ["space_id"])
    return regress.run_delta(b, a, ["space_id", "category"], "pass_rate").select("space_id", "category", r6("before"), r6("after"), r6("delta"))
