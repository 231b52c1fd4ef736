"""Workload, diversity and scorecard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import diversity as dv
from ..operators import scorecard as sc
from ..operators import workload as wl
from .common import LazyTables, table, view, with_views
from .registry import query, r6

# --- workload ----------------------------------------------------------------

_P = "CAST(o_totalprice AS DECIMAL(18,2))"
_X = "CAST(l_extendedprice AS DECIMAL(18,2))"
_WORKLOAD = {
    "e1_aggregation": (wl.aggregation, f"""SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, CAST(SUM({_X}) AS DOUBLE) AS sum_price,
        CAST(SUM({_X} * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS sum_revenue, COUNT(*) AS n FROM lineitem GROUP BY ALL"""),
    "e2_multi_condition": (wl.multi_condition, f"""SELECT COUNT(*) AS n, CAST(SUM({_X} * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS saved FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24"""),
    "e3_time_series": (wl.time_series, f"SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, COUNT(*) AS n_orders, CAST(SUM({_P}) AS DOUBLE) AS spend FROM orders GROUP BY 1"),
    "e4_ranking": (wl.ranking, f"""SELECT o_custkey, CAST(SUM({_P}) AS DOUBLE) AS spend, COUNT(*) AS n_orders FROM orders GROUP BY o_custkey
        HAVING COUNT(*) >= 5 ORDER BY SUM({_P}) DESC, o_custkey LIMIT 10"""),
    "e5_distinct_count": (wl.distinct_count, """SELECT event_type, COUNT(DISTINCT user_id) AS n_users, COUNT(DISTINCT CASE WHEN value >= 100 THEN user_id END) AS n_big_users
        FROM events GROUP BY event_type"""),
    "e5_distinct_count_approx": (wl.distinct_count_approx, None),
    "e6_ratio_or_delta": (wl.ratio_or_delta, f"""WITH m AS (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, SUM({_P}) AS s FROM orders GROUP BY ALL)
        SELECT o_orderpriority, month, CAST(s AS DOUBLE) AS spend, ROUND(100.0::DOUBLE * CAST(s AS DOUBLE) / (SELECT CAST(SUM({_P}) AS DOUBLE) FROM orders), 6) AS pct,
               CAST(s - LAG(s) OVER (PARTITION BY o_orderpriority ORDER BY month) AS DOUBLE) AS delta FROM m"""),
    "e7_windowed": (wl.windowed, f"""WITH s AS (SELECT c_mktsegment, c_nationkey, SUM({_P}) AS s FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
        SELECT c_mktsegment, c_nationkey, CAST(s AS DOUBLE) AS spend, ROW_NUMBER() OVER w AS rn, RANK() OVER w AS rk, DENSE_RANK() OVER w AS drk, NTILE(4) OVER w AS quarter,
               CAST(LAG(s) OVER w AS DOUBLE) AS prev_spend, CAST(LEAD(s) OVER w AS DOUBLE) AS next_spend FROM s WINDOW w AS (PARTITION BY c_mktsegment ORDER BY s DESC, c_nationkey)"""),
    "e8_percentile": (wl.percentile, """SELECT o_orderpriority, ROUND(quantile_cont(o_totalprice, 0.5), 4) AS p50, ROUND(quantile_cont(o_totalprice, 0.9), 4) AS p90
        FROM orders GROUP BY o_orderpriority"""),
    "e8_percentile_approx": (wl.percentile_approx, None),
    "e9_self_join": (wl.self_join, """WITH w AS (SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS DATE) AS week FROM events)
        SELECT a.week, COUNT(*) AS active, COUNT(b.user_id) AS retained FROM w a LEFT JOIN w b ON b.user_id = a.user_id AND b.week = a.week + 7 GROUP BY a.week"""),
    "e10_semi_anti": (wl.semi_anti, """SELECT c_mktsegment, COUNT(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
        AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_mktsegment"""),
    "e11_conditional": (wl.conditional, """SELECT event_type, CAST(SUM(CASE WHEN value < 5 THEN 1 WHEN value < 50 THEN 2 ELSE 3 END) AS BIGINT) AS weight,
        COUNT(*) FILTER (WHERE event_type = 'purchase' AND value >= 50) AS n_big_purchases, COUNT(*) FILTER (WHERE value < 5) AS n_small FROM events GROUP BY event_type"""),
    "e12_with_cte": (wl.with_cte, f"""WITH per AS (SELECT o_custkey, c_nationkey, SUM({_P}) AS s FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
        SELECT c_nationkey, ROUND(CAST(SUM(s) AS DOUBLE) / COUNT(*), 4) AS mean_spend, COUNT(*) AS n_customers FROM per GROUP BY c_nationkey
        HAVING CAST(SUM(s) AS DOUBLE) / COUNT(*) > (SELECT CAST(SUM(s) AS DOUBLE) / COUNT(*) FROM per)"""),
    "e13_pivot": (wl.pivot_table, """SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS n_o,
        COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS n_p FROM orders GROUP BY o_orderpriority"""),
    "e13_lateral_explode": (wl.lateral_explode, """SELECT lang, COUNT(*) AS n_lines, CAST(SUM(LENGTH(line)) AS BIGINT) AS n_chars, MAX(LENGTH(line)) AS longest
        FROM (SELECT lang, UNNEST(string_split(text, chr(10))) AS line FROM documents) x GROUP BY lang"""),
    "e14_funnel": (wl.funnel, """WITH u AS (SELECT user_id, MIN(ts) FILTER (WHERE event_type = 'view') AS v, MIN(ts) FILTER (WHERE event_type = 'click') AS c,
        MIN(ts) FILTER (WHERE event_type = 'purchase') AS p FROM events GROUP BY user_id)
        SELECT COUNT(v) AS n_view, COUNT(*) FILTER (WHERE c > v) AS n_click, COUNT(*) FILTER (WHERE c > v AND p > c) AS n_purchase FROM u"""),
}
for _name, (_fn, _sql) in _WORKLOAD.items():
    query(_name, _sql)(lambda spark, d, fn=_fn: fn(LazyTables(spark, d)))

# --- diversity ---------------------------------------------------------------

_EMB = """e AS (SELECT vec_id, label, embedding, SQRT(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS nrm FROM embeddings),
    u AS MATERIALIZED (SELECT vec_id AS id, label AS space_id, list_transform(embedding, lambda x: CAST(CAST(x / (nrm + 1e-9) AS FLOAT) AS DOUBLE)) AS v, embedding[1] >= 0 AS gen FROM e)"""
_NN = f"""{_EMB}, sims AS (SELECT g.space_id, g.id, r.id AS nn_id, list_dot_product(g.v, r.v) AS s FROM u g JOIN u r ON g.space_id = r.space_id WHERE g.gen AND NOT r.gen),
    nn AS (SELECT space_id, id, MAX(s) AS nn_sim, arg_min(nn_id, (-s, nn_id)) AS nn_id FROM sims GROUP BY space_id, id)"""


def unit_vectors(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("space_id", F.col("label"))
    return dv.unit(e, "vec_id", "embedding", ["space_id"])


def split(spark, d) -> tuple[DataFrame, DataFrame]:
    """Generated and reference vectors: the two sides of the first coordinate."""
    side = F.element_at("v", 1) >= 0
    u = unit_vectors(spark, d)
    return u.where(side), u.where(~side)


def neighbours(spark, d) -> DataFrame:
    return dv.nearest_reference(*split(spark, d), ["space_id"])


@query("d1_unit_vectors", f"""WITH {_EMB} SELECT id, space_id, CAST(len(v) AS INTEGER) AS dims, ROUND(list_sum(list_transform(v, lambda x: x * x)), 4) AS squares,
    ROUND(v[1], 4) AS first, ROUND(v[len(v)], 4) AS last FROM u""")
def d1(spark, d):
    u = unit_vectors(spark, d)
    sq = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    at = lambda i: F.round(F.element_at("v", i).cast("double"), 4)
    return u.select("id", "space_id", F.size("v").alias("dims"), F.round(sq, 4).alias("squares"), at(1).alias("first"), at(-1).alias("last"))


@query("d2_nearest_reference", f"WITH {_NN} SELECT space_id, id, ROUND(nn_sim, 4) AS nn_sim, nn_id FROM nn")
def d2(spark, d):
    return neighbours(spark, d).withColumn("nn_sim", F.round("nn_sim", 4))


@query("d2_nearest_reference_all", f"""WITH {_EMB}, sims AS (SELECT g.id, r.id AS nn_id, list_dot_product(g.v, r.v) AS s FROM u g JOIN u r ON g.gen AND NOT r.gen)
    SELECT id, ROUND(MAX(s), 4) AS nn_sim, arg_min(nn_id, (-s, nn_id)) AS nn_id FROM sims GROUP BY id""")
def d2_all(spark, d):
    g, r = split(spark, d)
    return dv.nearest_reference(g, r).withColumn("nn_sim", F.round("nn_sim", 4))


@query("d3_nn_summary", f"""WITH {_NN} SELECT space_id, COUNT(*) AS n_generated, ROUND(AVG(nn_sim), 4) AS mean_nn_cosine, ROUND(quantile_cont(nn_sim, 0.1), 4) AS nn_cosine_p10
    FROM nn GROUP BY space_id""")
def d3(spark, d):
    s = dv.nn_summary(neighbours(spark, d), ["space_id"])
    return s.withColumn("mean_nn_cosine", F.round("mean_nn_cosine", 4)).withColumn("nn_cosine_p10", F.round("nn_cosine_p10", 4))


@query("d4_self_similarity", f"""WITH {_EMB}, s AS (SELECT a.space_id, a.gen, a.id, MAX(CASE WHEN a.id = b.id THEN list_dot_product(a.v, b.v) - 1 ELSE list_dot_product(a.v, b.v) END) AS m
        FROM u a JOIN u b ON a.space_id = b.space_id AND a.gen = b.gen GROUP BY ALL)
    SELECT space_id, COUNT(*) FILTER (WHERE gen) AS n_gen, COUNT(*) FILTER (WHERE NOT gen) AS n_ref,
           ROUND(AVG(m) FILTER (WHERE gen), 4) AS gen_self_similarity, ROUND(AVG(m) FILTER (WHERE NOT gen), 4) AS ref_self_similarity FROM s GROUP BY space_id""")
def d4(spark, d):
    g, r = split(spark, d)
    gs = dv.self_similarity(g, ["space_id"], "gen_self_similarity").withColumnRenamed("n", "n_gen")
    rs = dv.self_similarity(r, ["space_id"], "ref_self_similarity").withColumnRenamed("n", "n_ref")
    return gs.join(rs, "space_id").select(
        "space_id", "n_gen", "n_ref", F.round("gen_self_similarity", 4).alias("gen_self_similarity"), F.round("ref_self_similarity", 4).alias("ref_self_similarity")
    )


@query("d5_leakage", f"""WITH {_NN} SELECT space_id, COUNT(*) AS n, ROUND(AVG(CASE WHEN nn_sim >= 0.35 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS leakage_fraction,
    AVG(CASE WHEN nn_sim >= 0.35 THEN 1.0 ELSE 0.0 END) >= 0.5 AS leakage_risk FROM nn GROUP BY space_id""")
def d5(spark, d):
    return dv.leakage(neighbours(spark, d), ["space_id"], 0.35, 0.5).withColumn("leakage_fraction", F.round("leakage_fraction", 6))


@query("d6_corpus_gate", with_views("history") + """
    SELECT space_id, COUNT(*) AS n_ref, COUNT(question) FILTER (WHERE status <> 'RUNNING') AS n_embedded, COUNT(*) FILTER (WHERE status <> 'RUNNING') > 0 AND COUNT(*) >= 3 AS computed,
           CASE WHEN COUNT(*) FILTER (WHERE status <> 'RUNNING') = 0 THEN 'no embeddings' WHEN COUNT(*) < 3 THEN concat('reference corpus too small: ', COUNT(*)) ELSE '' END AS skip_reason
    FROM history GROUP BY space_id""")
def d6(spark, d):
    ref = view(spark, d, "history").withColumn("v", F.when(F.col("status") != "RUNNING", F.col("question")))
    return dv.corpus_gate(ref, ["space_id"], "v", 3)


@query("d7_join_back", f"""WITH {_NN} SELECT vec_id AS id, label AS space_id, ROUND(nn_sim, 4) AS diversity_nn_sim FROM embeddings LEFT JOIN nn ON id = vec_id""")
def d7(spark, d):
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("space_id"))
    return dv.join_back(items, neighbours(spark, d), ["space_id", "id"]).withColumn("diversity_nn_sim", F.round("diversity_nn_sim", 4))


@query("q10_greedy_dedup", f"""WITH RECURSIVE {_EMB.replace('AS MATERIALIZED', 'AS')}, near AS (SELECT b.id, list(a.id) FILTER (WHERE a.id IS NOT NULL) AS l, ROW_NUMBER() OVER (ORDER BY b.id) AS rn
        FROM u b LEFT JOIN u a ON a.space_id = b.space_id AND a.id < b.id AND list_dot_product(a.v, b.v) >= 0.3 GROUP BY b.id),
    walk AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept UNION ALL
        SELECT w.rn + 1, CASE WHEN list_has_any(w.kept, COALESCE(n.l, [])) THEN w.kept ELSE list_append(w.kept, n.id) END FROM walk w JOIN near n ON n.rn = w.rn + 1)
    SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT UNNEST(kept) FROM walk WHERE rn = (SELECT MAX(rn) FROM near))""")
def q10(spark, d):
    e = table(spark, d, "embeddings")
    return dv.greedy_dedup(e, ["label"], "vec_id", "embedding", 0.3).select("vec_id", "label")


# --- scorecards --------------------------------------------------------------

_SECTIONS = ", ".join(f"'{s}'" for s in sc.SECTIONS)
_LATEST = f"""tagged AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY experiment, job_run_id ORDER BY start_time DESC, run_id DESC) AS k FROM metric_runs WHERE job_run_id IS NOT NULL) x WHERE k <= 12),
    recent AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY experiment ORDER BY start_time DESC, run_id DESC) AS k FROM metric_runs) x WHERE k <= 12),
    found AS (SELECT j.job_run_id, j.experiment, run_id, run_name, start_time, 'exact' AS attribution FROM jobs j JOIN tagged t ON t.experiment = j.experiment AND t.job_run_id = j.job_run_id
        UNION ALL SELECT j.job_run_id, j.experiment, run_id, run_name, start_time, 'latest' FROM jobs j JOIN recent r ON r.experiment = j.experiment
        WHERE NOT EXISTS (SELECT 1 FROM metric_runs m WHERE m.experiment = j.experiment AND m.job_run_id = j.job_run_id)),
    latest AS (SELECT * EXCLUDE (k) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY experiment, job_run_id, run_name ORDER BY start_time DESC, run_id DESC) AS k FROM found WHERE run_name IN ({_SECTIONS})) x WHERE k = 1)"""


def _latest(spark, d):
    return sc.latest_sections(view(spark, d, "metric_runs"), view(spark, d, "jobs"))


@query("c1_latest_sections", with_views("metric_runs", "jobs") + f", {_LATEST} SELECT job_run_id, experiment, run_name, attribution, run_id, start_time FROM latest")
def c1(spark, d):
    return _latest(spark, d)


_BUCKETS = """b AS (SELECT job_run_id, key, n, CASE WHEN key LIKE 'pass_rate_%' THEN 'pass_rate' ELSE 'n' END AS measure, replace(replace(key, 'pass_rate_', ''), 'count_', '') AS bucket
    FROM metric_facts WHERE run_name = 'assistant_regression' AND kind = 'metric' AND key <> 'pass_rate_deterministic')"""


def _grading(spark, d):
    f = view(spark, d, "metric_facts").where(F.col("run_name") == sc.REGRESSION)
    return f.select("job_run_id", "key", F.col("n").cast("double").alias("value"))


@query("c2_bucket_split", with_views("metric_facts") + f""", {_BUCKETS}
    SELECT job_run_id, key, measure, bucket, CASE WHEN bucket IN ('easy', 'medium', 'hard') THEN 'by_difficulty' ELSE 'by_category' END AS "grouping", CAST(n AS DOUBLE) AS value FROM b""")
def c2(spark, d):
    return sc.bucket_split(_grading(spark, d))


@query("c2_bucket_maps", with_views("metric_facts") + f""", {_BUCKETS}
    SELECT job_run_id, CAST(MAX(n) FILTER (WHERE measure = 'pass_rate' AND bucket = 'easy') AS DOUBLE) AS easy_rate, CAST(MAX(n) FILTER (WHERE measure = 'n' AND bucket = 'easy') AS DOUBLE) AS easy_n,
           CAST(MAX(n) FILTER (WHERE measure = 'pass_rate' AND bucket = 'ranking') AS DOUBLE) AS ranking_rate, CAST(MAX(n) FILTER (WHERE measure = 'n' AND bucket = 'ranking') AS DOUBLE) AS ranking_n FROM b GROUP BY job_run_id""")
def c2_maps(spark, d):
    m = sc.bucket_maps(_grading(spark, d), ["job_run_id"])
    get = lambda c, k: F.try_element_at(F.col(c), F.lit(k))
    return m.select("job_run_id", get("by_difficulty", "easy").alias("easy_rate"), get("by_difficulty_n", "easy").alias("easy_n"),
                    get("by_category", "ranking").alias("ranking_rate"), get("by_category_n", "ranking").alias("ranking_n"))


def _cell(section: str, kind: str, keys) -> str:
    hit = lambda k: f"MAX(n) FILTER (WHERE run_name = '{section}' AND kind = '{kind}' AND key = '{k}')"
    return f"CAST(COALESCE({', '.join(hit(k) for k in keys)}) AS {'DOUBLE' if kind == 'metric' else 'VARCHAR'})"


@query("c3_scorecard", with_views("metric_facts") + "SELECT job_run_id, " + ", ".join(
    [f"{_cell(*spec)} AS {name}" for name, spec in sc.LAYOUT.items()]
    + [f"BOOL_OR(run_name = '{s}') AS {name}" for name, s in sc.COMPUTED.items()]) + " FROM metric_facts GROUP BY job_run_id")
def c3(spark, d):
    f = view(spark, d, "metric_facts").withColumn("value", F.col("n").cast("string"))
    return sc.scorecard(f, ["job_run_id"])


@query("c4_readiness", with_views("metric_runs", "jobs") + f""", {_LATEST}, s AS (SELECT job_run_id, experiment, STRING_AGG(run_name, ',' ORDER BY run_name) AS names, MIN(attribution) AS attribution FROM latest GROUP BY ALL)
    SELECT j.job_run_id, j.experiment, names IS NOT NULL AS ready, CASE WHEN names IS NULL THEN 'no scorecard runs found yet' ELSE '' END AS reason, COALESCE(names, '') AS available_sections, attribution
    FROM jobs j LEFT JOIN s USING (job_run_id, experiment)""")
def c4(spark, d):
    return sc.readiness(view(spark, d, "jobs"), _latest(spark, d))


@query("c5_merge_runs", with_views("index_runs", "session_runs") + """
    SELECT run_id, run_name, experiment_path, submitted_at, submitted_by FROM index_runs
    UNION ALL SELECT run_id, run_name, experiment_path, submitted_at, submitted_by FROM session_runs WHERE run_id NOT IN (SELECT run_id FROM index_runs)""")
def c5(spark, d):
    return sc.merge_runs(view(spark, d, "index_runs"), view(spark, d, "session_runs"))


@query("c6_check_report", with_views("checks") + "SELECT space_id, status, COUNT(*) AS n FROM checks GROUP BY ALL")
def c6(spark, d):
    return sc.check_report(view(spark, d, "checks"), ["space_id"])


@query("c6_failed_checks", with_views("checks") + "SELECT space_id, area, assumption, status, substring(COALESCE(detail, ''), 1, 400) AS detail FROM checks WHERE status = 'FAIL'")
def c6_failed(spark, d):
    return sc.failed_checks(view(spark, d, "checks"))
