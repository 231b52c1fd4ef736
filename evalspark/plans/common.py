"""Input views over the shared test tables.

Each view is one SQL text valid in Spark and in DuckDB, so a query and its
oracle start from the same rows.  ``{name}`` stands for a table or another
view.  Every view covers its tables whole.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    # one vote per order line; the solver is the line number
    "votes": """
        SELECT l_orderkey AS question_id, l_linenumber - 1 AS solver_idx,
               CASE WHEN l_linenumber IN (1, 3, 5, 7) THEN 'gen' ELSE 'judge' END AS family,
               CASE l_returnflag WHEN 'A' THEN TRUE WHEN 'N' THEN FALSE END AS verdict
        FROM {lineitem}""",
    # the second panel's votes on rewritten questions
    "revotes": """
        SELECT l_orderkey AS question_id, l_linenumber - 1 AS solver_idx,
               CASE WHEN l_linenumber IN (1, 3, 5, 7) THEN 'gen' ELSE 'judge' END AS family,
               l_linestatus = 'F' AS verdict
        FROM {lineitem}""",
    "gate_items": """
        SELECT o_orderkey AS question_id, concat('How was order ', o_orderkey, '?') AS question,
               o_orderpriority AS category,
               o_orderstatus <> 'P' AS sql_executes, o_totalprice > 20000 AS nonempty_result,
               CASE WHEN o_totalprice > 480000 THEN FALSE WHEN o_totalprice > 400000 THEN NULL ELSE TRUE END AS sql_deterministic
        FROM {orders}""",
    "rewrites": """
        SELECT o_orderkey AS question_id,
               CASE WHEN o_orderpriority = '1-URGENT' THEN concat('How was order ', o_orderkey, '?')
                    ELSE concat('What was the status of order ', o_orderkey, '?') END AS new_question
        FROM {orders}""",
    # a user is a space, a minute a question, an event a run
    "reruns": """
        SELECT user_id AS space_id, CAST(FLOOR(event_id / 3) AS BIGINT) AS question_id,
               CAST(event_id - 3 * FLOOR(event_id / 3) AS INT) AS run_idx,
               CASE WHEN event_type = 'error' THEN NULL WHEN value >= 20 THEN 1 ELSE 0 END AS passed
        FROM {events}""",
    "answers": """
        SELECT event_id AS question_id, user_id AS space_id, event_type AS category,
               CASE WHEN event_type = 'error' THEN 'timeout' ELSE '' END AS answer_error,
               CASE WHEN value >= 20 THEN TRUE WHEN value >= 5 THEN FALSE END AS verdict
        FROM {events}""",
    "runs": """
        SELECT o_orderkey AS question_id, o_custkey AS space_id, concat('Question ', o_orderkey) AS question,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE concat('answer ', o_custkey) END AS answer,
               CASE WHEN o_totalprice > 490000 THEN NULL ELSE concat('SELECT ', o_orderkey) END AS expected_sql,
               o_orderpriority AS category,
               CASE WHEN o_totalprice < 150000 THEN 'easy' WHEN o_totalprice < 300000 THEN 'medium' ELSE 'hard' END AS difficulty_structural,
               CASE WHEN o_custkey < 500 THEN 'easy' WHEN o_custkey < 1000 THEN 'medium' ELSE 'hard' END AS difficulty,
               CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS verdict,
               CASE WHEN o_totalprice > 450000 THEN 'timeout' ELSE '' END AS answer_error,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'gold' WHEN '2-HIGH' THEN 'verified' WHEN '3-MEDIUM' THEN 'quarantine' WHEN '5-LOW' THEN 'not_evaluable' END AS verify_tier,
               CASE WHEN o_totalprice < 40000 THEN FALSE WHEN o_totalprice < 60000 THEN NULL ELSE TRUE END AS sql_deterministic
        FROM {orders}""",
    "graded": """
        SELECT question_id, space_id, question, answer, expected_sql, category, difficulty_structural, difficulty, answer_error,
               CASE WHEN answer_error = '' AND verdict THEN TRUE ELSE FALSE END AS result_match,
               CASE WHEN answer_error = '' AND verdict IS NOT NULL THEN FALSE ELSE TRUE END AS match_indeterminate,
               difficulty = difficulty_structural AS difficulty_label_matches
        FROM {runs}""",
    "run_answers": """
        SELECT l_orderkey AS question_id, l_linenumber - 1 AS run_idx, l_partkey AS answer_rows_id
        FROM {lineitem}""",
    # pairs of captured row sets; the class of an order decides how the answer differs
    "pairs": """
        SELECT question_id, kind, expected_json, answer_json FROM (
            SELECT o_orderkey AS question_id, concat(o_orderpriority, '/', o_orderstatus) AS kind,
                   CASE concat(o_orderpriority, '/', o_orderstatus)
                       WHEN '3-MEDIUM/P' THEN ''
                       WHEN '4-NOT SPECIFIED/F' THEN '[]'
                       WHEN '5-LOW/P' THEN concat('[', repeat('["x"], ', 50), '["x"]]')
                       ELSE concat('[["C', o_custkey, '", ', price, '], [', o_orderkey, ', "', o_orderpriority, '"]]') END AS expected_json,
                   CASE concat(o_orderpriority, '/', o_orderstatus)
                       WHEN '1-URGENT/O' THEN concat('[[', o_orderkey, ', "', o_orderpriority, '"], ["C', o_custkey, '", ', price, ']]')
                       WHEN '1-URGENT/P' THEN concat('[[', price, ', "C', o_custkey, '"], ["', o_orderpriority, '", ', o_orderkey, ']]')
                       WHEN '2-HIGH/F' THEN concat('[[', price, ', "C', o_custkey, '"], [', o_orderkey, ', "', o_orderpriority, '"]]')
                       WHEN '2-HIGH/O' THEN concat('[["C', o_custkey, '", ', price1, '], ["', o_orderkey, '.0", "', o_orderpriority, '"]]')
                       WHEN '2-HIGH/P' THEN concat('[["C', o_custkey, '", ', price2, '], [', o_orderkey, ', "', o_orderpriority, '"]]')
                       WHEN '3-MEDIUM/F' THEN concat('[["C', o_custkey, '", ', price, ']]')
                       WHEN '3-MEDIUM/O' THEN ''
                       WHEN '4-NOT SPECIFIED/F' THEN 'null'
                       WHEN '4-NOT SPECIFIED/O' THEN concat('[["C', o_custkey, '", ', price, '], ["C', o_custkey, '", ', price, ']]')
                       WHEN '4-NOT SPECIFIED/P' THEN concat('[["C', o_custkey, '", ', price, '], [', o_orderkey + 1, ', "', o_orderpriority, '"]]')
                       WHEN '5-LOW/F' THEN concat('[["C', o_custkey, '", "', price, '"], [', o_orderkey, 'e0, "', o_orderpriority, '"]]')
                       WHEN '5-LOW/O' THEN '[["C'
                       ELSE concat('[["C', o_custkey, '", ', price, '], [', o_orderkey, ', "', o_orderpriority, '"]]') END AS answer_json
            FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(o_totalprice AS DECIMAL(18,1)) AS price1,
                         CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 1.01 AS DECIMAL(18,2)) AS price2 FROM {orders}) o) p""",
    "judge_labels": """
        SELECT l.doc_id AS item_id, 'quality_judge' AS judge, CASE WHEN d.n_chars > 500 THEN 'pass' ELSE 'fail' END AS judge_label,
               CASE WHEN l.quality = 1 THEN ' Yes' ELSE 'no' END AS human_label
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
        UNION ALL
        SELECT doc_id, 'toxic_judge', CASE WHEN quality = 1 THEN '0' ELSE '1' END, CASE WHEN toxic = 1 THEN 'TRUE' ELSE 'false' END FROM {labels}
        UNION ALL
        SELECT doc_id, 'constant_judge', 'Y', 't' FROM {labels}""",
    "history": """
        SELECT conv_id AS space_id, conv_id * 100 + turn AS pos, text AS question,
               CASE turn WHEN 0 THEN 'COMPLETED' WHEN 2 THEN 'FAILED' WHEN 4 THEN 'QUERY_RESULT_EXPIRED' ELSE 'RUNNING' END AS status,
               concat('SELECT  ', turn, '  FROM t') AS answer_sql
        FROM {conversations} WHERE role = 'user'""",
    # opening questions were logged before, with other blanks and marks
    "prior": """
        SELECT conv_id AS space_id, concat('  ', text, ' ?!') AS question
        FROM {conversations} WHERE role = 'user' AND turn = 0""",
    "curated": """
        SELECT conv_id AS space_id, conv_id * 100 + turn AS pos,
               CASE WHEN turn = 1 THEN concat(' ', text) WHEN role = 'user' THEN text WHEN role = 'system' THEN '  ' ELSE 'the same answer' END AS text
        FROM {conversations}""",
    # one raw item per customer; kind says which rule it meets or breaks
    "raw_items": """
        SELECT pos, space_id, kind, segment, nation,
               CASE WHEN kind = 0 THEN '   '
                    WHEN kind = 1 THEN concat('How many customers of ', segment, ' joined This Month?')
                    WHEN kind = 2 THEN concat('Orders of ', nation, ' in the last 30 days')
                    WHEN kind = 3 THEN concat('Sales of ', nation, ' over the next 2 weeks')
                    ELSE concat('  How many customers of segment ', segment, ' are in ', nation, '? ') END AS question,
               CASE WHEN kind = 4 THEN NULL
                    WHEN kind = 5 THEN 'SELECT COUNT(*) FROM orders WHERE o_orderdate < CURRENT_DATE'
                    WHEN kind = 6 THEN concat('SELECT SUM(c_name) FROM customer WHERE c_custkey = ', pos)
                    WHEN kind = 7 THEN 'SELECT AVG(CASE WHEN (c_mktsegment = ''X'') THEN c_acctbal END) FROM customer'
                    WHEN kind = 8 THEN concat('DELETE FROM orders WHERE o_custkey = ', pos)
                    WHEN kind = 9 THEN concat('/* note */ SELECT COUNT(*) FROM orders WHERE o_custkey = ', pos)
                    WHEN kind = 10 THEN concat('SELECT c_mktsegment, COUNT(*) FROM customer WHERE c_nationkey = ', space_id, ' GROUP BY c_mktsegment')
                    WHEN kind = 11 THEN concat('SELECT o_orderkey FROM orders WHERE o_custkey > ', pos, ' ORDER BY o_totalprice DESC LIMIT 5')
                    WHEN kind = 12 THEN concat('WITH t AS (SELECT o_custkey FROM orders WHERE o_totalprice > ', pos, ') SELECT COUNT(*) FROM t')
                    WHEN kind = 13 THEN concat('SELECT n_name, RANK() OVER (ORDER BY n_nationkey) FROM nation WHERE n_name <> ''', nation, '''')
                    WHEN kind = 14 THEN concat('SELECT COUNT(CASE WHEN o_orderstatus = ''F'' THEN 1 END) FROM orders WHERE o_custkey = ', pos)
                    ELSE concat('SELECT COUNT(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = ''', segment, ''' AND n_name = ''', nation, '''') END AS expected_sql,
               CASE segment WHEN 'BUILDING' THEN 'hard' WHEN 'MACHINERY' THEN 'Medium' WHEN 'FURNITURE' THEN 'EASY' WHEN 'HOUSEHOLD' THEN '' END AS difficulty,
               CASE segment WHEN 'BUILDING' THEN 'filter' WHEN 'MACHINERY' THEN 'ranking' WHEN 'FURNITURE' THEN 'windowed' WHEN 'HOUSEHOLD' THEN '' END AS category,
               CASE segment WHEN 'AUTOMOBILE' THEN '' WHEN 'MACHINERY' THEN '  - c_mktsegment: [''BUILDING'', ''FURNITURE'']'
                    ELSE concat('  - c_mktsegment: [''', segment, ''']
  - n_name: ["', nation, '"]') END AS column_samples
        FROM (SELECT c_custkey AS pos, c_nationkey AS space_id, c_mktsegment AS segment, n_name AS nation,
                     CASE WHEN c_acctbal < -700 THEN 0 WHEN c_acctbal < -400 THEN 1 WHEN c_acctbal < -100 THEN 2 WHEN c_acctbal < 200 THEN 3
                          WHEN c_acctbal < 500 THEN 4 WHEN c_acctbal < 800 THEN 5 WHEN c_acctbal < 1100 THEN 6 WHEN c_acctbal < 1400 THEN 7
                          WHEN c_acctbal < 1700 THEN 8 WHEN c_acctbal < 2000 THEN 9 WHEN c_acctbal < 3000 THEN 10 WHEN c_acctbal < 4000 THEN 11
                          WHEN c_acctbal < 5000 THEN 12 WHEN c_acctbal < 6000 THEN 13 WHEN c_acctbal < 7000 THEN 14 ELSE 15 END AS kind
              FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey) c""",
    "captures": """
        SELECT pos, space_id, kind, coalesce(category, 'none') AS category, expected_sql,
               kind <> 8 AND kind <> 4 AS sql_executes,
               CASE WHEN kind = 8 THEN 'rejected' WHEN kind = 4 THEN 'missing' ELSE '' END AS sql_error,
               CASE WHEN kind IN (4, 8, 9) THEN 0 ELSE kind END AS n_result_rows,
               kind NOT IN (4, 8, 9) AS nonempty_result
        FROM {raw_items}""",
    # three customers of a nation and kind make a reply; some are broken or cut off
    "reply_items": """
        SELECT pos, CAST(FLOOR(pos / 3) AS BIGINT) AS reply_id, kind, segment, nation, question, expected_sql, category, difficulty, column_samples
        FROM {raw_items}""",
    "expected_rows": """
        SELECT o_custkey AS k, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS v
        FROM {orders} GROUP BY o_custkey""",
    # the same question answered without pending orders of high value
    "actual_rows": """
        SELECT o_custkey AS k, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS v
        FROM {orders} WHERE o_orderstatus <> 'P' OR o_totalprice < 490000 GROUP BY o_custkey""",
    "metric_runs": """
        SELECT concat('/exp/', event_type) AS experiment, CASE WHEN value < 10 THEN NULL ELSE user_id END AS job_run_id,
               event_id AS run_id, ts AS start_time,
               CASE WHEN value < 12 THEN 'eval_set_realism' WHEN value < 16 THEN 'eval_set_stability' WHEN value < 22 THEN 'assistant_regression'
                    WHEN value < 40 THEN 'eval_set_quality' WHEN value < 60 THEN 'eval_set_verification' ELSE 'scratch' END AS run_name
        FROM {events}""",
    "jobs": """
        SELECT DISTINCT user_id AS job_run_id, concat('/exp/', event_type) AS experiment FROM {events}
        UNION ALL
        SELECT c_custkey + 1000000 AS job_run_id, CASE WHEN c_acctbal < 0 THEN '/exp/none' ELSE '/exp/click' END AS experiment FROM {customer}""",
    "metric_facts": """
        SELECT user_id AS job_run_id, run_name, kind, key, CAST(MAX(event_id) AS BIGINT) AS n FROM (
            SELECT user_id, event_id,
                   CASE event_type WHEN 'view' THEN 'eval_set_realism' WHEN 'click' THEN 'eval_set_stability' WHEN 'purchase' THEN 'assistant_regression'
                        WHEN 'signup' THEN 'eval_set_quality' ELSE 'eval_set_verification' END AS run_name,
                   CASE WHEN event_type IN ('view', 'click') AND value >= 60 THEN 'param' ELSE 'metric' END AS kind,
                   CASE event_type
                       WHEN 'view' THEN CASE WHEN value >= 60 THEN 'leakage_risk' WHEN value >= 20 THEN 'p_at_h' WHEN value >= 5 THEN 'mean_nn_cosine' ELSE 'self_sim' END
                       WHEN 'click' THEN CASE WHEN value >= 60 THEN 'gateable' WHEN value >= 20 THEN 'rerun_agreement' ELSE 'n_units' END
                       WHEN 'purchase' THEN CASE WHEN value >= 60 THEN 'pass_rate_deterministic' WHEN value >= 30 THEN 'pass_rate_easy' WHEN value >= 20 THEN 'count_easy'
                                                 WHEN value >= 10 THEN 'pass_rate_ranking' ELSE 'count_ranking' END
                       WHEN 'signup' THEN CASE WHEN value >= 20 THEN 'question_clarity/mean' ELSE 'fraction_nonempty' END
                       ELSE CASE WHEN value >= 20 THEN 'gold_count' ELSE 'verified_fraction' END END AS key
            FROM {events}) e
        GROUP BY user_id, run_name, kind, key""",
    "checks": """
        SELECT user_id AS space_id, event_type AS area, concat('props ', props) AS assumption,
               CASE WHEN value < 5 THEN 'FAIL' WHEN value < 10 THEN 'WARN' WHEN value < 12 THEN 'NA' ELSE 'PASS' END AS status,
               CASE WHEN value < 2 THEN repeat(props, 50) WHEN value < 20 THEN props END AS detail
        FROM {events}""",
    "index_runs": """
        SELECT o_orderkey AS run_id, concat('index ', o_orderkey) AS run_name, concat('space ', o_custkey) AS space_id, '/exp/a' AS experiment_path,
               o_orderdate AS submitted_at, 'ann' AS submitted_by
        FROM {orders} WHERE o_orderstatus <> 'P'""",
    "session_runs": """
        SELECT o_orderkey AS run_id, concat('session ', o_orderkey) AS run_name, concat('space ', o_custkey) AS space_id, '/exp/b' AS experiment_path,
               o_orderdate AS submitted_at, 'bob' AS submitted_by
        FROM {orders} WHERE o_orderpriority <> '5-LOW'""",
    # a supplier is a space, a part one of its tables, a line number a column
    "fleet_columns": """
        SELECT l_suppkey AS space_id, concat('t', l_partkey) AS "table", l_linenumber AS position,
               CASE l_linenumber WHEN 1 THEN 'id' WHEN 2 THEN 'Status' ELSE concat('Col', l_linenumber, l_returnflag) END AS "column"
        FROM {lineitem}""",
}

_REF = re.compile(r"\{(\w+)\}")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


class LazyTables(Mapping):
    """The test tables, each opened when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._open = lambda name: table(spark, sf_dir, name)

    def __getitem__(self, name: str) -> DataFrame:
        return self._open(name)

    def __iter__(self):
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name].replace('"table"', "`table`").replace('"column"', "`column`")
    refs = {r: view(spark, sf_dir, r) if r in VIEWS else table(spark, sf_dir, r) for r in set(_REF.findall(text))}
    return spark.sql(text, **refs)


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the views, and those they use, for DuckDB."""
    order: list[str] = []

    def need(name: str) -> None:
        for r in _REF.findall(VIEWS[name]):
            if r in VIEWS:
                need(r)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    return "WITH " + ",\n".join(f"{n} AS ({_REF.sub(r'\1', VIEWS[n])})" for n in order) + "\n"
