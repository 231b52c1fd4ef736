"""Queries over whole chains: from results to a scorecard, and from raw items to clean ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import flow
from ..operators import items as it
from ..operators import metrics as mt
from ..operators import scorecard as sc
from ..operators import validate as va
from ..session import scratch_path
from ..sources import spaces as sp
from .analytics import _EMB, _NN, split
from .common import VIEWS, table, view, with_views
from .quality import _REPLY, replies, star_catalog
from .registry import ORACLES, query
from .trust import _REPAIRED, _SPACE, _VIEWS, repaired_items

# A space is a label of the embeddings; questions, items and customers belong to the one of their last digit.
VIEWS["space_reruns"] = "SELECT CAST(question_id % 10 AS INT) AS space_id, question_id, run_idx, passed FROM {reruns}"
VIEWS["space_captures"] = "SELECT CAST(pos % 10 AS INT) AS space_id, sql_executes, nonempty_result FROM {captures}"
VIEWS["space_graded"] = """
    SELECT CAST(question_id % 10 AS INT) AS space_id, category, difficulty_structural, answer_error, result_match, match_indeterminate, difficulty_label_matches FROM {graded}"""
VIEWS["space_verdicts"] = """
    SELECT CAST(question_id % 10 AS INT) AS space_id, CASE family WHEN 'gen' THEN 'question_clarity' ELSE 'sql_answers_question' END AS judge, verdict FROM {votes}"""

_ROUNDED = {c: 4 if c.startswith("diversity") else 6 for c, (_, kind, _) in sc.LAYOUT.items() if kind == "metric"}
_FLAG = "CASE WHEN {0} THEN 'True' WHEN NOT {0} THEN 'False' END"


def _double(name: str, value: str) -> str:
    return f"ROUND(CAST({value} AS DOUBLE), {_ROUNDED[name]}) AS {name}"


_GROUNDED = ORACLES["v4_grounded_literals"].rpartition("SELECT pos, ")[2]
_SCORECARD = with_views(*_VIEWS, "space_reruns", "space_captures", "space_graded", "space_verdicts", "raw_items") + f""", {_REPAIRED}, {_SPACE.replace("FROM reruns", "FROM space_reruns")}, {_NN},
    nns AS (SELECT space_id, AVG(nn_sim) AS mean, quantile_cont(nn_sim, 0.1) AS p10, AVG(CASE WHEN nn_sim >= 0.97 THEN 1.0 ELSE 0.0 END) >= 0.10 AS risk FROM nn GROUP BY space_id),
    refs AS (SELECT space_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE id % 2 = 0) AS h FROM u WHERE NOT gen GROUP BY space_id HAVING COUNT(*) >= 10),
    own AS (SELECT a.space_id, a.gen, a.id, MAX(CASE WHEN a.id = b.id THEN list_dot_product(a.v, b.v) - 1 ELSE list_dot_product(a.v, b.v) END) AS m
        FROM u a JOIN u b ON a.space_id = b.space_id AND a.gen = b.gen GROUP BY ALL),
    selfs AS (SELECT space_id, AVG(m) FILTER (WHERE gen) AS g, AVG(m) FILTER (WHERE NOT gen) AS r FROM own GROUP BY space_id),
    diversity AS (SELECT space_id, {_double("diversity_mean_nn_cosine", "mean")}, {_double("diversity_nn_cosine_p10", "p10")},
            {_double("diversity_gen_self_similarity", "g")}, {_double("diversity_ref_self_similarity", "selfs.r")}, {_FLAG.format("risk")} AS diversity_leakage_risk,
            CAST(h AS VARCHAR) AS diversity_n_history, CAST(n - h AS VARCHAR) AS diversity_n_curated, CAST(n AS VARCHAR) AS diversity_n_reference, TRUE AS diversity_computed
        FROM nns JOIN refs USING (space_id) JOIN selfs USING (space_id)),
    ns AS (SELECT UNNEST(RANGE(2, 2000)) AS n), ps AS (SELECT DISTINCT pooled FROM rates),
    best AS (SELECT pooled, MIN(n) AS n FROM ps, ns WHERE 1.96::DOUBLE * SQRT(pooled * (1 - pooled) / n + 3.8416::DOUBLE / (4.0::DOUBLE * n * n)) / (1 + 3.8416::DOUBLE / n) <= 0.10 GROUP BY pooled),
    sizes AS (SELECT space_id, COUNT(DISTINCT question_id) AS q, MAX(run_idx) + 1 AS m FROM space_reruns GROUP BY space_id),
    stability AS (SELECT w.space_id, {_double("reliability_rerun_agreement", "rerun_agreement")}, {_double("reliability_half_pp", "half * 100")}, {_double("reliability_pooled", "CASE WHEN n_units > 0 THEN w.pooled END")},
            {_FLAG.format("(COALESCE(rerun_agreement >= 0.9, FALSE) AND half <= 0.10 AND w.pooled BETWEEN 0.10 AND 0.90)")} AS reliability_gateable, CAST(m AS VARCHAR) AS reliability_m_reruns, CAST(q AS VARCHAR) AS reliability_n_questions,
            {_double("reliability_n_units", "n_units")}, {_double("reliability_n_needed", "GREATEST(b.n, n_units, 2)")}, {_double("reliability_max_half_pp", "10")}, TRUE AS reliability_computed
        FROM wide w JOIN best b ON b.pooled = w.pooled JOIN sizes USING (space_id)),
    gates AS (SELECT CAST(question_id % 10 AS INTEGER) AS space_id, COUNT(*) FILTER (WHERE verify_tier <> 'not_evaluable') AS n, COUNT(*) FILTER (WHERE verify_tier = 'gold') AS gold,
            COUNT(*) FILTER (WHERE verify_tier = 'verified') AS ver, COUNT(*) FILTER (WHERE verify_tier = 'quarantine') AS quar, COUNT(*) FILTER (WHERE verify_repaired) AS rep,
            AVG(CASE WHEN verify_tier <> 'not_evaluable' THEN verify_agreement END) AS agree FROM repaired GROUP BY 1),
    verification AS (SELECT space_id, {_double("verification_verified_fraction", "(gold + ver) / n")}, {_double("verification_gold_count", "gold")}, {_double("verification_verified_count", "ver")},
            {_double("verification_quarantine_count", "quar")}, {_double("verification_repaired_count", "rep")}, {_double("verification_mean_panel_agreement", "agree")}, {_double("verification_n_gated", "n")}, TRUE AS verification_computed
        FROM gates WHERE n > 0),
    healths AS (SELECT space_id, {_double("quality_sql_executes", "AVG(CAST(sql_executes AS INTEGER))")}, {_double("quality_nonempty", "AVG(CAST(nonempty_result AS INTEGER))")} FROM space_captures GROUP BY space_id),
    judges AS (SELECT space_id, {_double("quality_clarity", "AVG(CASE WHEN judge = 'question_clarity' THEN CAST(verdict AS INTEGER) END)")},
            {_double("quality_sql_answers", "AVG(CASE WHEN judge = 'sql_answers_question' THEN CAST(verdict AS INTEGER) END)")} FROM space_verdicts GROUP BY space_id),
    grounds AS (SELECT CAST(pos % 10 AS INTEGER) AS space_id, {_double("quality_grounded", "AVG(CAST(grounded AS INTEGER))")} FROM (SELECT pos, {_GROUNDED}) x GROUP BY 1),
    grades AS (SELECT space_id, {_double("regression_pass_rate", "COALESCE(AVG(CASE WHEN NOT match_indeterminate THEN CAST(result_match AS INTEGER) END), 0)")}, {_double("regression_n_questions", "COUNT(*)")},
            {_double("regression_n_indeterminate", "COUNT(*) FILTER (WHERE match_indeterminate)")}, CAST(NULL AS DOUBLE) AS regression_n_same_engine,
            {_double("regression_label_match_rate", "AVG(CAST(difficulty_label_matches AS INTEGER))")} FROM space_graded GROUP BY space_id),
    levels AS (SELECT space_id, AVG(CAST(result_match AS INTEGER)) AS r, CASE difficulty_structural WHEN 'easy' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS k
        FROM space_graded WHERE NOT match_indeterminate GROUP BY ALL HAVING COUNT(*) >= 5),
    slopes AS (SELECT space_id, CASE WHEN COUNT(*) >= 2 THEN CASE WHEN COUNT(*) FILTER (WHERE before + 1e-9 < r) = 0 THEN 'True' ELSE 'False' END END AS regression_difficulty_monotonic
        FROM (SELECT *, LAG(r) OVER (PARTITION BY space_id ORDER BY k) AS before FROM levels) x GROUP BY space_id)
    SELECT * REPLACE (COALESCE(diversity_computed, FALSE) AS diversity_computed, COALESCE(reliability_computed, FALSE) AS reliability_computed, COALESCE(verification_computed, FALSE) AS verification_computed)
    FROM stability FULL JOIN verification USING (space_id) FULL JOIN diversity USING (space_id) FULL JOIN healths USING (space_id) FULL JOIN judges USING (space_id)
    FULL JOIN grounds USING (space_id) FULL JOIN grades USING (space_id) FULL JOIN slopes USING (space_id)"""


def result_log(spark, d):
    """The metric log of all sections: votes, reruns, captures, verdicts, grades and vectors of every space."""
    by = ["space_id"]
    space = lambda c: (F.col(c) % 10).cast("int").alias("space_id")
    gated = repaired_items(spark, d).withColumn("space_id", space("question_id"))
    grounded = va.grounded_literals(view(spark, d, "raw_items")).select(space("pos"), F.lit("grounded_literals").alias("judge"), F.col("grounded").alias("verdict"))
    verdicts = view(spark, d, "space_verdicts").unionByName(grounded)
    generated, reference = split(spark, d)
    reference = reference.withColumn("source", F.when(F.col("id") % 2 == 0, "history").otherwise("curated"))
    return mt.metric_log(
        mt.verification_section(gated, by),
        mt.quality_section(view(spark, d, "space_captures"), verdicts, by),
        mt.realism_section(generated, reference, by),
        mt.stability_section(view(spark, d, "space_reruns"), ["question_id"], by),
        mt.regression_section(view(spark, d, "space_graded"), by),
    )


@query("c3_scorecard_of_results", _SCORECARD)
def scorecard_of_results(spark, d):
    path = scratch_path(spark, "metrics")
    sp.append_metrics(result_log(spark, d), path)
    card = sc.scorecard(spark.read.parquet(path), ["space_id"])
    return card.select("space_id", *[F.round(c, _ROUNDED[c]).alias(c) if c in _ROUNDED else F.col(c) for c in card.columns if c != "space_id"])


# --- raw items to clean ones -------------------------------------------------

#: So low that it drops some of the test vectors, which are far apart.
_NEAR = 0.3
# reply by reply, item by item; a reply belongs to one of ten spaces
_CHAIN = f"""WITH RECURSIVE {with_views("reply_items").removeprefix("WITH ").rstrip()}, {_REPLY}, {_EMB.replace("AS MATERIALIZED", "AS")},
    placed AS (SELECT reply_id % 10 AS space_id, reply_id * 3 + ROW_NUMBER() OVER (PARTITION BY reply_id ORDER BY pos) - 1 AS gpos, kind, top, question FROM reply_items JOIN replies USING (reply_id)),
    s0 AS (SELECT * FROM placed WHERE top NOT IN (13, 14)),
    s1 AS (SELECT * FROM s0 WHERE kind NOT IN (0, 4)), s2 AS (SELECT * FROM s1 WHERE kind NOT IN (1, 2, 3, 5)), s3 AS (SELECT * FROM s2 WHERE kind NOT IN (6, 7)),
    s4 AS (SELECT * EXCLUDE (nth) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY space_id, kind ORDER BY gpos) AS nth FROM s3) x WHERE nth = 1),
    held AS (SELECT s4.*, u.v FROM s4 LEFT JOIN u ON u.id = gpos),
    near AS (SELECT b.gpos, list(a.gpos) FILTER (WHERE a.gpos IS NOT NULL) AS l, ROW_NUMBER() OVER (ORDER BY b.gpos) AS rn
        FROM held b LEFT JOIN held a ON a.space_id = b.space_id AND a.gpos < b.gpos AND list_dot_product(a.v, b.v) >= {_NEAR} WHERE b.v IS NOT NULL GROUP BY b.gpos),
    walk AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept UNION ALL
        SELECT w.rn + 1, CASE WHEN list_has_any(w.kept, COALESCE(n.l, [])) THEN w.kept ELSE list_append(w.kept, n.gpos) END FROM walk w JOIN near n ON n.rn = w.rn + 1),
    s5 AS (SELECT * FROM held WHERE v IS NULL OR gpos IN (SELECT UNNEST(kept) FROM walk WHERE rn = (SELECT MAX(rn) FROM walk)))"""
_SOME = {"malformed": (0, 1), "relative_time": (1, 2), "typed_aggregate": (2, 3), "same_skeleton": (3, 4), "near_question": (4, 5)}


def chain(spark, d):
    good, _ = it.parse_replies(replies(spark, d))
    raw = good.withColumn("space_id", F.col("reply_id") % 10).withColumn("pos", F.col("reply_id") * 3 + F.col("item_idx"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), "embedding")
    return flow.build_accounted(raw.join(vectors, "pos", "left"), star_catalog(spark, d), ["space_id"], "pos", "embedding", _NEAR)


@query("flow_clean_items", _CHAIN + """
    SELECT space_id, gpos AS pos, sha256(concat(CAST(space_id AS VARCHAR), chr(1), gpos, chr(1), TRIM(question))) AS question_id,
           CASE WHEN kind IN (12, 13, 14) THEN 'hard' WHEN kind IN (10, 11, 15) THEN 'medium' ELSE 'easy' END AS difficulty_structural FROM s5""")
def clean_items(spark, d):
    return chain(spark, d)[0].select("space_id", "pos", "question_id", "difficulty_structural")


@query("flow_account", _CHAIN + " UNION ALL ".join(
    f"""
    SELECT space_id, CAST({k} AS INTEGER) AS step, '{name}' AS stage, COUNT(*) AS n_in, COUNT(*) FILTER (WHERE gpos IN (SELECT gpos FROM s{b})) AS n_out FROM s{a} GROUP BY space_id"""
    for k, (name, (a, b)) in enumerate(_SOME.items())))
def account(spark, d):
    return chain(spark, d)[1]
