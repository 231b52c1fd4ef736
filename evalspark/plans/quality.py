"""Item cleaning, validation and result-matching queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.cells import canon_cell, canon_rows, parse_rows
from ..functions.frames import spread
from ..functions.text import extract_sql, has_relative_time, is_readonly, norm_question, sql_skeleton, structural_difficulty
from ..operators import items as it
from ..operators import match as m
from ..operators import profile as pf
from ..operators import validate as va
from ..session import materialize
from ..sources import history as hist
from .common import table, tables, view, with_views
from .registry import big, query, r6

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def star_catalog(spark, d):
    return pf.column_catalog(tables(spark, d, STAR), spark)


# --- cleaning ----------------------------------------------------------------


@query("q1_norm_question", with_views("history") + r"""
    SELECT pos, norm, LENGTH(norm) AS n FROM (
        SELECT pos, RTRIM(TRIM(REGEXP_REPLACE(LOWER(concat(' ', question, '  ?! . ')), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')), '?.! ') AS norm FROM history) h""")
def norm(spark, d):
    n = norm_question(F.concat(F.lit(" "), "question", F.lit("  ?! . ")))
    return view(spark, d, "history").select("pos", n.alias("norm")).withColumn("n", F.length("norm").cast("bigint"))


@query("q2_contamination_filter", with_views("history") + """
    SELECT h.pos FROM history h WHERE NOT EXISTS (SELECT 1 FROM history p WHERE p.space_id = h.space_id AND p.pos = p.space_id * 100
        AND RTRIM(LOWER(TRIM(p.question)), '?.! ') = RTRIM(LOWER(TRIM(h.question)), '?.! '))""")
def contamination(spark, d):
    return it.drop_contaminated(view(spark, d, "history"), view(spark, d, "prior"), on=("space_id",)).select("pos")


_PLAN = """plan_in AS (SELECT c_custkey AS table_id, CAST(FLOOR(ABS(c_acctbal) / 100) AS INTEGER) AS n, CAST(c_nationkey AS INTEGER) AS min_hard FROM customer)"""


def plan_input(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("table_id"), F.floor(F.abs("c_acctbal") / 100).cast("int").alias("n"), F.col("c_nationkey").alias("min_hard"))


@query("q3_generation_plan", f"""WITH {_PLAN}, k AS (SELECT *, CASE WHEN n <= 12 THEN 1 ELSE LEAST(4, GREATEST(2, n // 10)) END AS k FROM plan_in),
    c AS (SELECT *, UNNEST(RANGE(0, k)) AS chunk, CAST(CEIL(n / k) AS BIGINT) AS per FROM k)
    SELECT table_id, CAST(chunk AS INTEGER) AS chunk, CAST(CASE WHEN k = 1 THEN n ELSE LEAST(per, n - chunk * per) END AS INTEGER) AS chunk_n,
           CAST(CASE WHEN k = 1 THEN min_hard ELSE GREATEST(1, min_hard // k) END AS INTEGER) AS chunk_hard,
           ['aggregation_filter', 'ranking_topn', 'window_cohort', 'ratio_delta_time'][chunk % 4 + 1] AS focus
    FROM c WHERE k = 1 OR LEAST(per, n - chunk * per) > 0""")
def plan(spark, d):
    return it.generation_plan(plan_input(spark, d)).select("table_id", "chunk", "chunk_n", "chunk_hard", "focus")


_PROMPT_TEMPLATE = "{{n}} for {{table}}, {{min_hard}} hard.\n{{schema}}\n{{column_samples}}\n{{space_context}}\n  7. Last rule.\nReturn ONLY a JSON object."


@query("q4_prompts", f"""WITH {_PLAN}, k AS (SELECT *, CASE WHEN n <= 12 THEN 1 ELSE LEAST(4, GREATEST(2, n // 10)) END AS k FROM plan_in),
    c AS (SELECT *, UNNEST(RANGE(0, k)) AS chunk, CAST(CEIL(n / k) AS BIGINT) AS per FROM k)
    SELECT table_id, CAST(chunk AS INTEGER) AS chunk, concat(CASE WHEN k = 1 THEN n ELSE LEAST(per, n - chunk * per) END, ' for ', c_name, ', ',
        CASE WHEN k = 1 THEN min_hard ELSE GREATEST(1, min_hard // k) END, ' hard.', chr(10), '  - ', lower(c_mktsegment), ': string', chr(10),
        CASE WHEN c_acctbal < 0 THEN '  (no low-cardinality columns)' ELSE '  - x: [''{{{{n}}}}'']' END, chr(10), 'about ', c_mktsegment, chr(10), chr(10),
        'SHAPE FOCUS for this batch: ', ['aggregation_filter', 'ranking_topn', 'window_cohort', 'ratio_delta_time'][chunk % 4 + 1],
        chr(10), '  7. Last rule.', chr(10), '  8. Be brief.', chr(10), 'Return ONLY a JSON object.') AS prompt
    FROM c JOIN customer ON c_custkey = table_id WHERE k = 1 OR LEAST(per, n - chunk * per) > 0""")
def prompts(spark, d):
    profiles = table(spark, d, "customer").select(
        F.col("c_custkey").alias("table_id"), F.col("c_name").alias("table"),
        F.concat(F.lit("  - "), F.lower("c_mktsegment"), F.lit(": string")).alias("schema_text"),
        F.when(F.col("c_acctbal") >= 0, F.lit("  - x: ['{{n}}']")).alias("column_samples"),
        F.concat(F.lit("about "), "c_mktsegment").alias("context"),
    )
    plan_rows = it.generation_plan(plan_input(spark, d))
    return it.prompts(plan_rows, profiles, ["table_id"], _PROMPT_TEMPLATE, "Be brief.").select("table_id", "chunk", "prompt")


def replies(spark, d):
    """Replies of up to three items as JSON; groups are bounded by construction of the reply id."""
    i = view(spark, d, "reply_items")
    item = F.struct("pos", "question", "expected_sql", F.lit("1 row").alias("expected_shape"), "category", "difficulty", F.lit("w").alias("why_non_trivial"))
    folded = i.groupBy("reply_id").agg(
        F.array_sort(F.collect_list(item)).alias("q"), F.max("kind").alias("top"), F.max("column_samples").alias("column_samples"), F.min("kind").alias("low")
    )
    slim = F.transform("q", lambda x: F.struct(*[x[f].alias(f) for f in it.ITEM_FIELDS]))
    text = F.to_json(F.struct(slim.alias("questions")))
    content = F.when(F.col("top") == 15, text).when(F.col("top") == 14, F.expr("substring(t, 1, length(t) - 5)")).when(F.col("top") != 13, text)
    return folded.withColumn("t", text).withColumn("content", content).drop("q", "t")


_REPLY = """replies AS (SELECT reply_id, MAX(kind) AS top, MIN(kind) AS low, MAX(column_samples) AS column_samples FROM reply_items GROUP BY reply_id)"""


@query("q5_parse_replies", with_views("reply_items") + f""", {_REPLY}
    SELECT reply_id, CAST(ROW_NUMBER() OVER (PARTITION BY reply_id ORDER BY pos) - 1 AS INTEGER) AS item_idx, question, expected_sql, category, difficulty
    FROM reply_items JOIN replies USING (reply_id) WHERE top NOT IN (13, 14)""")
def parse(spark, d):
    good, _ = it.parse_replies(replies(spark, d))
    return good.select("reply_id", "item_idx", "question", "expected_sql", "category", "difficulty")


@query("q5_reply_rejects", with_views("reply_items") + f""", {_REPLY}
    SELECT reply_id, CASE top WHEN 13 THEN 'reply is empty' ELSE 'reply is not the expected JSON' END AS error FROM replies WHERE top IN (13, 14)""")
def rejects(spark, d):
    return it.parse_replies(replies(spark, d))[1].select("reply_id", "error")


@query("q6_normalise_items", with_views("raw_items") + """
    SELECT pos, TRIM(question) AS question, TRIM(expected_sql) AS expected_sql, COALESCE(NULLIF(category, ''), 'uncategorized') AS category,
           COALESCE(NULLIF(difficulty, ''), 'medium') AS difficulty, '' AS expected_shape FROM raw_items WHERE kind NOT IN (0, 4)""")
def normalise(spark, d):
    return it.normalise_items(view(spark, d, "raw_items")).select("pos", "question", "expected_sql", "category", "difficulty", "expected_shape")


@query("q6_drop_counts", with_views("raw_items") + """
    SELECT space_id, COUNT(*) AS n_items, COUNT(*) FILTER (WHERE kind IN (0, 4)) AS n_malformed, COUNT(*) FILTER (WHERE kind IN (1, 2, 3, 5)) AS n_relative,
           COUNT(*) FILTER (WHERE kind IN (6, 7)) AS n_typed, COUNT(*) FILTER (WHERE kind > 7) - COUNT(DISTINCT CASE WHEN kind > 7 THEN kind END) AS n_duplicate
    FROM raw_items GROUP BY space_id""")
def drop_counts(spark, d):
    return it.drop_counts(view(spark, d, "raw_items"), ["space_id"], star_catalog(spark, d))


@query("q7_relative_time", with_views("raw_items") + "SELECT pos, kind IN (1, 2, 3, 5) AS relative FROM raw_items")
def relative(spark, d):
    return view(spark, d, "raw_items").select("pos", has_relative_time("question", "expected_sql").alias("relative"))


@query("q8_typed_aggregates", with_views("raw_items") + """
    SELECT pos, CASE kind WHEN 6 THEN 'c_name' WHEN 7 THEN 'c_mktsegment' ELSE '' END AS bad FROM raw_items""")
def typed(spark, d):
    raw = view(spark, d, "raw_items")
    return it.typed_aggregate_violations(raw, star_catalog(spark, d)).select("pos", F.array_join("bad_columns", ",").alias("bad"))


def clean(spark, d):
    """Reply items through all row rules, in their fixed order."""
    raw = view(spark, d, "raw_items")
    return it.drop_typed_violations(it.drop_relative_time(it.normalise_items(raw)), star_catalog(spark, d))


_CLEAN = "clean AS (SELECT * FROM raw_items WHERE kind NOT IN (0, 1, 2, 3, 4, 5, 6, 7))"


@query("q9_dedup_skeleton", with_views("raw_items") + f", {_CLEAN} SELECT space_id, MIN(pos) AS pos, kind FROM clean GROUP BY space_id, kind")
def dedup(spark, d):
    return it.dedup_skeleton(clean(spark, d), ["space_id"]).select("space_id", "pos", "kind")


@query("q9_skeleton_text", with_views("raw_items") + """
    SELECT pos, CASE kind WHEN 4 THEN ''
        WHEN 5 THEN 'select count(*)from orders where o_orderdate<current_date'
        WHEN 6 THEN 'select sum(c_name)from customer where c_custkey=0'
        WHEN 7 THEN 'select avg(case when(c_mktsegment=''?'')then c_acctbal end)from customer'
        WHEN 8 THEN 'delete from orders where o_custkey=0'
        WHEN 9 THEN '/*note*/select count(*)from orders where o_custkey=0'
        WHEN 10 THEN 'select c_mktsegment,count(*)from customer where c_nationkey=0 group by c_mktsegment'
        WHEN 11 THEN 'select o_orderkey from orders where o_custkey>0 order by o_totalprice desc limit 0'
        WHEN 12 THEN 'with t as(select o_custkey from orders where o_totalprice>0)select count(*)from t'
        WHEN 13 THEN 'select n_name,rank()over(order by n_nationkey)from nation where n_name<>''?'''
        WHEN 14 THEN 'select count(case when o_orderstatus=''?'' then 0 end)from orders where o_custkey=0'
        ELSE 'select count(*)from customer join nation on c_nationkey=n_nationkey where c_mktsegment=''?'' and n_name=''?''' END AS skeleton
    FROM raw_items""")
def skeleton(spark, d):
    return view(spark, d, "raw_items").select("pos", sql_skeleton("expected_sql").alias("skeleton"))


@query("q11_item_id", with_views("raw_items") + """
    SELECT pos, sha256(concat(COALESCE(CAST(space_id AS VARCHAR), ''), chr(1), pos, chr(1), question)) AS question_id FROM raw_items""")
def item_id(spark, d):
    return view(spark, d, "raw_items").select("pos", it.item_id(["space_id"]).alias("question_id"))


@query("q12_readonly", with_views("raw_items") + "SELECT pos, kind NOT IN (4, 8) AS readonly FROM raw_items")
def readonly(spark, d):
    return view(spark, d, "raw_items").select("pos", is_readonly("expected_sql").alias("readonly"))


@query("q13_extract_sql", with_views("raw_items") + """
    SELECT pos, CASE kind WHEN 4 THEN '' WHEN 8 THEN concat(expected_sql, ';') WHEN 9 THEN substring(expected_sql, 12) ELSE expected_sql END AS sql FROM raw_items""")
def extract(spark, d):
    raw = view(spark, d, "raw_items")
    wrapped = (
        F.when(F.col("kind") < 10, F.concat(F.lit("```sql\n"), "expected_sql", F.lit(";\n```")))
        .when(F.col("kind") < 12, F.concat(F.lit("The query you want:\n"), "expected_sql", F.lit("\n\nThis counts rows.")))
        .when(F.col("kind") < 14, F.concat("expected_sql", F.lit("; SELECT 2")))
        .otherwise(F.concat(F.lit("  "), "expected_sql", F.lit("  \n \nNote: done")))
    )
    return raw.select("pos", extract_sql(wrapped).alias("sql"))


@query("q14_structural_difficulty", with_views("raw_items") + """
    SELECT pos, CASE WHEN kind IN (7, 12, 13, 14) THEN 'hard' WHEN kind IN (0, 1, 2, 3, 10, 11, 15) THEN 'medium' ELSE 'easy' END AS difficulty_structural FROM raw_items""")
def structural(spark, d):
    return view(spark, d, "raw_items").select("pos", structural_difficulty("expected_sql").alias("difficulty_structural"))


@query("q15_label_agreement", with_views("raw_items") + """
    SELECT pos, COALESCE(LOWER(difficulty), '') = CASE WHEN kind IN (7, 12, 13, 14) THEN 'hard' WHEN kind IN (0, 1, 2, 3, 10, 11, 15) THEN 'medium' ELSE 'easy' END AS difficulty_label_matches
    FROM raw_items""")
def labels(spark, d):
    return it.structural_labels(view(spark, d, "raw_items")).select("pos", "difficulty_label_matches")


@query("q16_templated_items", """WITH v AS (SELECT DISTINCT c_mktsegment AS v FROM customer)
    SELECT category, difficulty, expected_sql FROM (
        SELECT 'aggregation' AS category, 'medium' AS difficulty, 'SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment' AS expected_sql FROM v
        UNION ALL SELECT 'filter', 'easy', concat('SELECT COUNT(*) AS n FROM customer WHERE c_mktsegment = ''', v, '''') FROM v
        UNION ALL SELECT 'ranking', 'hard', concat('SELECT c_mktsegment, COUNT(*) AS n FROM customer WHERE c_mktsegment <> ''', v, ''' GROUP BY c_mktsegment HAVING COUNT(*) > 1 ORDER BY n DESC, c_mktsegment LIMIT 3') FROM v
        UNION ALL SELECT 'ratio_or_delta', 'hard', concat('SELECT 100.0 * SUM(CASE WHEN c_mktsegment = ''', v, ''' THEN 1 ELSE 0 END) / COUNT(*) AS pct FROM customer') FROM v
        UNION ALL SELECT 'distinct_count', 'easy', concat('SELECT COUNT(DISTINCT c_mktsegment) AS n FROM customer WHERE c_mktsegment <> ''', v, '''') FROM v
        UNION ALL SELECT 'windowed', 'hard', concat('SELECT c_mktsegment, RANK() OVER (ORDER BY COUNT(*) DESC) AS rk FROM customer WHERE c_mktsegment <> ''', v, ''' GROUP BY c_mktsegment') FROM v)""")
def templated(spark, d):
    return customer_items(spark, d).select("category", "difficulty", "expected_sql")


def customer_items(spark, d):
    values = pf.low_card_values(table(spark, d, "customer")).where("column = 'c_mktsegment'")
    return it.templated_items(values.withColumn("table", F.lit("customer")))


def every_item(spark, d):
    """Items of every profiled column and date range of every table."""
    return it.profiled_items(*profiles(spark, d))


def profiles(spark, d) -> tuple[DataFrame, DataFrame]:
    """The values and the date ranges of every table."""
    opened = tables(spark, d)
    return pf.profile_tables(opened), pf.profile_ranges(opened)


@query("q17_distribution_check", with_views("raw_items") + """
    SELECT space_id, n_easy, n_hard, n_time_series, n_ratio_or_delta, n_multi_condition, n_ranking,
           n_easy <= 1 AND n_hard >= 5 AND n_time_series >= 1 AND n_ratio_or_delta >= 1 AND n_multi_condition >= 1 AND n_ranking >= 1 AS passed
    FROM (SELECT space_id, COUNT(*) FILTER (WHERE LOWER(difficulty) = 'easy') AS n_easy, COUNT(*) FILTER (WHERE LOWER(difficulty) = 'hard') AS n_hard,
                 COUNT(*) FILTER (WHERE category = 'time_series') AS n_time_series, COUNT(*) FILTER (WHERE category = 'ratio_or_delta') AS n_ratio_or_delta,
                 COUNT(*) FILTER (WHERE category = 'multi_condition') AS n_multi_condition, COUNT(*) FILTER (WHERE category = 'ranking') AS n_ranking
          FROM raw_items GROUP BY space_id) x""")
def distribution(spark, d):
    return it.distribution_check(view(spark, d, "raw_items"), ["space_id"])


# --- validation --------------------------------------------------------------


def star_views(spark, d) -> None:
    """The test tables under the names that statements use."""
    for name, df in tables(spark, d).items():
        df.createOrReplaceTempView(name)


@query("v2_determinism", with_views("expected_rows", "actual_rows") + """, d AS (
    (SELECT * FROM expected_rows EXCEPT ALL SELECT * FROM actual_rows) UNION ALL (SELECT * FROM actual_rows EXCEPT ALL SELECT * FROM expected_rows))
    SELECT TRUE AS same, (SELECT COUNT(*) FROM d) = 0 AS changed, (SELECT COUNT(*) FROM expected_rows) AS n_left, (SELECT COUNT(*) FROM actual_rows) AS n_right""")
def determinism(spark, d):
    twice = m.deterministic(view(spark, d, "expected_rows"), view(spark, d, "expected_rows"))
    other = m.deterministic(view(spark, d, "expected_rows"), view(spark, d, "actual_rows"))
    return other.select(
        twice.select("sql_deterministic").scalar().alias("same"), F.col("sql_deterministic").alias("changed"), "n_left", "n_right"
    )


@query("v3_health", with_views("captures") + """
    SELECT space_id, COUNT(*) AS n, ROUND(AVG(CAST(sql_executes AS INTEGER)), 6) AS fraction_sql_executes,
           ROUND(AVG(CAST(nonempty_result AS INTEGER)), 6) AS fraction_nonempty FROM captures GROUP BY space_id""")
def health(spark, d):
    return va.health(view(spark, d, "captures"), ["space_id"]).select("space_id", "n", r6("fraction_sql_executes"), r6("fraction_nonempty"))


@query("v4_grounded_literals", with_views("raw_items") + """
    SELECT pos, CASE WHEN column_samples <> '' THEN CASE kind WHEN 7 THEN FALSE WHEN 14 THEN FALSE WHEN 13 THEN segment <> 'MACHINERY' ELSE kind IN (4, 5, 6, 8, 9, 10, 11, 12) OR segment <> 'MACHINERY' END END AS grounded,
           CASE WHEN kind = 7 THEN 'X' WHEN kind = 14 THEN 'F' WHEN kind = 13 AND segment IN ('MACHINERY', 'AUTOMOBILE') THEN nation
                WHEN kind IN (0, 1, 2, 3, 15) AND segment IN ('MACHINERY', 'AUTOMOBILE') THEN concat(segment, ',', nation) ELSE '' END AS invented
    FROM raw_items""")
def grounded(spark, d):
    g = va.grounded_literals(view(spark, d, "raw_items"))
    return g.select("pos", "grounded", F.array_join("invented", ",").alias("invented"))


@query("v5_sql_validity", with_views("captures") + """
    SELECT pos, sql_error = '' AND n_result_rows > 0 AS valid, CASE WHEN sql_error <> '' THEN concat('SQL error: ', sql_error)
        WHEN n_result_rows = 0 THEN 'SQL runs but returns no rows' ELSE concat(n_result_rows, ' rows returned') END AS valid_reason FROM captures""")
def validity(spark, d):
    return va.sql_validity(view(spark, d, "captures")).select("pos", "valid", "valid_reason")


@query("v6_judge_means", with_views("votes") + """
    SELECT family AS judge, COUNT(verdict) AS n_evaluable, COUNT(*) AS n, ROUND(AVG(CAST(verdict AS INTEGER)), 6) AS mean_verdict FROM votes GROUP BY family""")
def judge_means(spark, d):
    v = view(spark, d, "votes").withColumnRenamed("family", "judge")
    return va.judge_means(v).withColumn("mean_verdict", F.round("mean_verdict", 6))


@query("v7_category_health", with_views("captures") + """
    SELECT category, COUNT(*) AS n, ROUND(AVG(CAST(sql_executes AS INTEGER)), 3) AS pct_sql_executes, ROUND(AVG(CAST(nonempty_result AS INTEGER)), 3) AS pct_nonempty
    FROM captures GROUP BY category""")
def category_health(spark, d):
    return va.category_health(view(spark, d, "captures"))


_READ = "CASE WHEN top NOT IN (13, 14) THEN {0} ELSE 0 END"


@query("v8_json_shape", with_views("reply_items") + f""", {_REPLY}
    SELECT reply_id, CAST({_READ.format('COUNT(*)')} AS BIGINT) AS n_items, ROUND({_READ.format("AVG(CASE WHEN expected_sql IS NOT NULL AND category IS NOT NULL AND difficulty IS NOT NULL THEN 1.0 ELSE 0.0 END)")}, 6)::DOUBLE AS json_shape
    FROM reply_items JOIN replies USING (reply_id) GROUP BY reply_id, top""")
def json_shape(spark, d):
    return scored(spark, d).select("reply_id", "n_items", r6("json_shape"))


def scored(spark, d):
    return va.score_replies(replies(spark, d).withColumn("min_hard", F.col("low") - 8))


# a null statement, a sum over names and a write do not run
@query("v9_executes_score", with_views("reply_items") + f""", {_REPLY}
    SELECT reply_id, ROUND(AVG(CASE WHEN kind NOT IN (4, 6, 8) THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS sql_parses FROM reply_items JOIN replies USING (reply_id)
    WHERE top NOT IN (13, 14) GROUP BY reply_id""")
def executes_score(spark, d):
    star_views(spark, d)
    good, _ = it.parse_replies(replies(spark, d))
    keyed = materialize(good.select("reply_id", "expected_sql", va.statement_id("expected_sql").alias("sql_id")), "replies")
    caps = va.run_statements(keyed, cap=0, check=False)
    return va.executes_score(keyed, caps, ["reply_id"], "sql_id").select("reply_id", r6("sql_parses"))


@query("v10_grounded_values", with_views("reply_items") + f""", {_REPLY},
    lits AS (SELECT i.reply_id, i.pos, COALESCE(BOOL_AND(contains(r.column_samples, concat('''', x, '''')) OR contains(r.column_samples, concat('"', x, '"')) OR regexp_matches(x, '^\\d+$')), TRUE) AS good
        FROM reply_items i JOIN replies r USING (reply_id) LEFT JOIN (SELECT pos, UNNEST(regexp_extract_all(expected_sql, '''([^'']+)''', 1)) AS x FROM reply_items) l USING (pos) GROUP BY ALL)
    SELECT reply_id, ROUND(CASE WHEN top IN (13, 14) THEN 0 WHEN MAX(r.column_samples) = '' THEN 1 ELSE AVG(CASE WHEN good THEN 1.0 ELSE 0.0 END) END, 6)::DOUBLE AS grounded_values
    FROM lits JOIN replies r USING (reply_id) GROUP BY reply_id, top""")
def grounded_values(spark, d):
    return scored(spark, d).select("reply_id", r6("grounded_values"))


@query("v11_hard_distribution", with_views("reply_items") + f""", {_REPLY}
    SELECT reply_id, ROUND(CASE WHEN top IN (13, 14) THEN 0 ELSE LEAST(COUNT(*) FILTER (WHERE difficulty = 'hard' AND kind IN (7, 13, 14)) / GREATEST(1, low - 8), 1) END, 6)::DOUBLE AS hard_distribution
    FROM reply_items JOIN replies USING (reply_id) GROUP BY reply_id, top, low""")
def hard_distribution(spark, d):
    return scored(spark, d).select("reply_id", r6("hard_distribution"))


# --- matching ----------------------------------------------------------------


@query("m1_parse_rows", with_views("pairs") + """
    SELECT question_id, CAST(CASE kind WHEN '3-MEDIUM/P' THEN NULL WHEN '4-NOT SPECIFIED/F' THEN 0 WHEN '5-LOW/P' THEN 51 ELSE 2 END AS INTEGER) AS n_expected,
           CAST(CASE kind WHEN '3-MEDIUM/O' THEN NULL WHEN '5-LOW/O' THEN NULL WHEN '4-NOT SPECIFIED/F' THEN 0 WHEN '3-MEDIUM/F' THEN 1 ELSE 2 END AS INTEGER) AS n_actual,
           CASE WHEN kind NOT IN ('3-MEDIUM/P', '4-NOT SPECIFIED/F') THEN CASE kind WHEN '5-LOW/P' THEN 'x' ELSE concat('C', o_custkey) END END AS first_cell
    FROM pairs JOIN orders ON o_orderkey = question_id""")
def rows_parser(spark, d):
    p = view(spark, d, "pairs").withColumn("e", parse_rows("expected_json")).withColumn("a", parse_rows("answer_json"))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return p.select("question_id", size("e").alias("n_expected"), size("a").alias("n_actual"), F.get(F.get("e", F.lit(0)), F.lit(0)).alias("first_cell"))


@query("m2_canon_cell", """WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders),
    c AS (SELECT *, RTRIM(RTRIM(CAST(p AS VARCHAR), '0'), '.') AS canon FROM o)
    SELECT o_orderkey, canon AS plain, concat('-', canon) AS negative, canon AS padded, CASE o_custkey WHEN 0 THEN '0E+3' ELSE CAST(o_custkey * 1000 AS VARCHAR) END AS scientific,
           concat('00', o_custkey) AS code, CASE WHEN o_custkey = 0 THEN '0' ELSE RTRIM(RTRIM(CAST(CAST(o_custkey AS DECIMAL(18,4)) / 10000 AS DECIMAL(18,4))::VARCHAR, '0'), '.') END AS small,
           canon AS typed FROM c""")
def canon(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    text = F.col("p").cast("string")
    return o.select(
        "o_orderkey",
        canon_cell(text).alias("plain"),
        canon_cell(F.concat(F.lit(" -"), text)).alias("negative"),
        canon_cell(F.concat(F.lit("+"), text, F.lit("000 "))).alias("padded"),
        canon_cell(F.concat("k", F.lit("E+3"))).alias("scientific"),
        canon_cell(F.concat(F.lit("00"), "k")).alias("code"),
        canon_cell(F.concat("k", F.lit(".0e-4"))).alias("small"),
        canon_cell("p").alias("typed"),
    )


@query("m3_cells_close", """WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS p, CAST(FLOOR(o_totalprice) AS DECIMAL(18,2)) AS w FROM orders)
    SELECT o_orderkey, p = w OR (p - w) <= p / 1000 AS floored, TRUE AS rounded, FALSE AS one_percent, FALSE AS next_whole FROM o""")
def close(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    c = lambda e: canon_cell(F.expr(e))
    return o.select(
        "o_orderkey",
        m.cells_close(c("p"), c("floor(p)")).alias("floored"),
        m.cells_close(c("p"), c("CAST(p AS DECIMAL(18,1))")).alias("rounded"),
        m.cells_close(c("p"), c("p * 1.01")).alias("one_percent"),
        m.cells_close(c("floor(p)"), c("floor(p) + 1")).alias("next_whole"),
    )


_EQUAL_BAG = "kind IN ('1-URGENT/F', '1-URGENT/O', '5-LOW/F', '4-NOT SPECIFIED/F')"


@query("m4_bag_equal", with_views("pairs") + f"""
    SELECT question_id, CASE WHEN kind IN ('3-MEDIUM/P', '3-MEDIUM/O', '5-LOW/O') THEN NULL ELSE {_EQUAL_BAG} OR (kind = '2-HIGH/O' AND price = price1) END AS equal
    FROM (SELECT question_id, kind, CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(o_totalprice AS DECIMAL(18,1)) AS price1 FROM pairs JOIN orders ON o_orderkey = question_id) x""")
def bag(spark, d):
    p = view(spark, d, "pairs").withColumn("e", canon_rows(parse_rows("expected_json"))).withColumn("a", canon_rows(parse_rows("answer_json")))
    return p.select("question_id", m.bag_equal("e", "a").alias("equal"))


@query("m5_column_permutation", with_views("pairs") + """
    SELECT question_id, kind IN ('1-URGENT/F', '1-URGENT/O', '1-URGENT/P', '2-HIGH/O', '5-LOW/F') AS verdict FROM pairs""")
def permutation(spark, d):
    p = spread(view(spark, d, "pairs"), "question_id").select("question_id", parse_rows("expected_json").alias("e"), parse_rows("answer_json").alias("a"))
    return m.match_permutation(p, "e", "a").select("question_id", "verdict")


def _near(a: str, b: str) -> str:
    return f"(ABS({a} - {b}) <= 1e-9 OR ABS({a} - {b}) <= GREATEST(ABS({a}), ABS({b})) / 1000)"


# each number of a row against the one that stands for it in the other row set
_PAIRED = " AND ".join(_near(a, b) for a, b in (("p", "p1"), ("2 * p", "2 * p1"), ("16.67", "16.666666666")))


@query("m6_tolerant_rows", f"""WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) + 0.01 AS p, CAST(o_totalprice AS DECIMAL(18,1)) AS p1 FROM orders)
    SELECT o_orderkey, {_PAIRED} AND {_near("0.333333", "0.33333")} AS rounded, {_PAIRED} AND {_near("0.333333", "0.34")} AS wrong FROM o""")
def tolerant(spark, d):
    o = spread(table(spark, d, "orders"), "o_orderkey").select(
        "o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"),
        F.col("o_totalprice").cast("decimal(18,1)").alias("p1"),
    )
    row = lambda *c: F.array(*[x.cast("string") for x in c])
    p, p1, s = F.col("p") + F.lit(0.01).cast("decimal(4,2)"), F.col("p1"), F.col("s")
    e = F.array(row(s, p, F.lit("0.333333")), row(F.lit("z"), p * 2, F.lit("16.67")))
    good = F.array(row(F.lit("16.666666666"), F.lit("z"), p1 * 2), row(F.lit("0.33333"), s, p1))
    wrong = F.array(row(F.lit("16.666666666"), F.lit("z"), p1 * 2), row(F.lit("0.34"), s, p1))
    both = m.match_permutation(o.select("o_orderkey", e.alias("e"), good.alias("g"), wrong.alias("w")), "e", "g", "rounded")
    return m.match_permutation(both, "e", "w", "wrong").select("o_orderkey", "rounded", "wrong")


@query("m7_rows_match", with_views("pairs") + """
    SELECT question_id, kind, CASE WHEN kind IN ('1-URGENT/F', '1-URGENT/O', '1-URGENT/P', '2-HIGH/O', '5-LOW/F') THEN TRUE
        WHEN kind IN ('3-MEDIUM/P', '4-NOT SPECIFIED/F', '5-LOW/P') THEN NULL ELSE FALSE END AS verdict FROM pairs""")
def rows_match(spark, d):
    return m.rows_match_json(spread(view(spark, d, "pairs"), "question_id"), "expected_json", "answer_json").select("question_id", "kind", "verdict")


@query("m8_multiset_diff", with_views("expected_rows", "actual_rows") + """, l AS (SELECT k, n, v, COUNT(*) AS c FROM expected_rows GROUP BY ALL),
    r AS (SELECT k, n, v, COUNT(*) AS c FROM actual_rows GROUP BY ALL)
    SELECT CAST(k AS VARCHAR) AS k, CAST(n AS VARCHAR) AS n, RTRIM(RTRIM(CAST(v AS VARCHAR), '0'), '.') AS v, COALESCE(l.c, 0) AS n_left, COALESCE(r.c, 0) AS n_right,
           GREATEST(COALESCE(l.c, 0) - COALESCE(r.c, 0), 0) AS only_left, GREATEST(COALESCE(r.c, 0) - COALESCE(l.c, 0), 0) AS only_right, LEAST(COALESCE(l.c, 0), COALESCE(r.c, 0)) AS "both"
    FROM l FULL JOIN r USING (k, n, v)""")
def diff(spark, d):
    return m.multiset_diff(view(spark, d, "expected_rows"), view(spark, d, "actual_rows"))


@query("m8_diff_summary", with_views("expected_rows", "actual_rows") + """
    SELECT (SELECT COUNT(*) FROM expected_rows) AS n_left, (SELECT COUNT(*) FROM actual_rows) AS n_right,
           (SELECT COUNT(*) FROM (SELECT * FROM expected_rows EXCEPT ALL SELECT * FROM actual_rows)) AS only_left,
           (SELECT COUNT(*) FROM (SELECT * FROM actual_rows EXCEPT ALL SELECT * FROM expected_rows)) AS only_right,
           (SELECT COUNT(*) FROM (SELECT * FROM actual_rows INTERSECT ALL SELECT * FROM expected_rows)) AS "both",
           (SELECT COUNT(*) FROM (SELECT * FROM expected_rows EXCEPT ALL SELECT * FROM actual_rows)) = 0 AND (SELECT COUNT(*) FROM (SELECT * FROM actual_rows EXCEPT ALL SELECT * FROM expected_rows)) = 0 AS equal""")
def summary(spark, d):
    return m.diff_summary(m.multiset_diff(view(spark, d, "expected_rows"), view(spark, d, "actual_rows")))
