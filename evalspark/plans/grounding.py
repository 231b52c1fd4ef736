"""Source, sink and profiling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.cells import ROW_CAP
from ..operators import gate, items as it, profile as pf, scorecard as sc
from ..operators import validate as va
from ..session import materialize, scratch_path, with_statistics
from ..sources import history as hist
from ..sources import spaces as sp
from .common import TABLES, table, table_path, tables, view, with_views
from .quality import every_item, profiles, star_catalog, star_views
from .registry import ORACLES, query, r6

# columns of the test tables by type, for the oracle texts
_SAMPLED = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"),
    "events": ("event_id", "user_id", "event_type", "props"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "embeddings": ("vec_id", "label"),
    "pages": ("page_id", "url", "html"),
    "benchmark": ("item_id", "text"),
    "labels": ("doc_id", "quality", "toxic"),
    "conversations": ("conv_id", "turn", "role", "text"),
}
_RANGED = {"orders": ("o_orderdate",), "lineitem": ("l_shipdate",), "events": ("ts",)}


def _items(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("question_id"), F.concat(F.lit("How was order "), "o_orderkey", F.lit("?")).alias("question"),
        F.col("o_orderpriority").alias("space_id"), F.lit("v1").alias("version"),
    )


# --- sources and sinks -------------------------------------------------------


# space ids that look like numbers, and one of each other kind
_IDS = "CASE o_orderpriority WHEN '1-URGENT' THEN '007' WHEN '2-HIGH' THEN '7' WHEN '3-MEDIUM' THEN '12e5' WHEN '4-NOT SPECIFIED' THEN '4/a b' ELSE o_orderpriority END"


def _odd_spaces(spark, d) -> DataFrame:
    return _items(spark, d).withColumn("space_id", F.expr(_IDS.replace("o_orderpriority", "space_id")))


@query("s1_space_read", """SELECT o_orderkey AS question_id, concat('How was order ', o_orderkey, '?') AS question, '7' AS space_id, 'v1' AS version
    FROM orders WHERE o_orderpriority = '2-HIGH'""")
def space_read(spark, d):
    path = scratch_path(spark, "items")
    sp.replace_space(_odd_spaces(spark, d), path)
    return sp.read_space(spark, path, "7").select("question_id", "question", "space_id", "version")


@query("s2_space_replace", f"""SELECT o_orderkey AS question_id, {_IDS} AS space_id, CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'v2' ELSE 'v1' END AS version
    FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' AND (o_orderpriority NOT IN ('1-URGENT', '5-LOW') OR o_orderstatus <> 'P')""")
def space_replace(spark, d):
    path = scratch_path(spark, "items")
    sp.replace_space(_odd_spaces(spark, d), path)
    live = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("question_id"))
    newer = _odd_spaces(spark, d).where(F.col("space_id").isin("007", "5-LOW")).join(live, "question_id", "left_semi")
    sp.replace_space(newer.withColumn("version", F.lit("v2")), path, ("007", "5-LOW", "4/a b"))
    return sp.read_items(spark, path).select("question_id", "space_id", "version")


@query("s3_question_log", """SELECT question_id, question, space_id, TRUE AS logged, COUNT(*) AS n FROM (
    SELECT o_orderkey AS question_id, concat('How was order ', o_orderkey, '?') AS question, o_orderpriority AS space_id FROM orders
    UNION ALL SELECT o_orderkey, concat('How was order ', o_orderkey, '?'), o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT') x GROUP BY ALL""")
def question_log(spark, d):
    path = scratch_path(spark, "log")
    sp.append_question_log(_items(spark, d), path)
    sp.append_question_log(_items(spark, d).where("space_id = '1-URGENT'"), path)
    log = spark.read.parquet(path)
    return log.groupBy("question_id", "question", "space_id", F.col("logged_at").isNotNull().alias("logged")).agg(F.count("*").alias("n"))


@query("s4_prior_questions", with_views("prior", "curated") + """
    SELECT DISTINCT space_id, TRIM(question) AS question FROM (SELECT space_id, question FROM prior UNION ALL SELECT space_id, text FROM curated) x WHERE TRIM(question) <> ''""")
def prior(spark, d):
    missing = sp.parquet_or_none(spark, f"{d}/no_such_table.parquet")
    return sp.prior_questions(view(spark, d, "prior"), view(spark, d, "curated").select("space_id", F.col("text").alias("question")), missing)


def conversation_docs(spark, d) -> DataFrame:
    """One document per message page; the first attachment carries no query, the second may."""
    c = table(spark, d, "conversations")
    q = lambda sql, desc: F.struct(F.struct(sql.alias("query"), desc.alias("description")).alias("query"))
    name = F.concat_ws("-", F.lpad(F.col("conv_id").cast("string"), 9, "0"), "turn")
    msg = F.struct(
        F.concat(F.lit(" "), "text", F.lit(" ")).alias("content"),
        F.expr("CASE turn WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'QUERY_RESULT_EXPIRED' WHEN 3 THEN 'RUNNING' ELSE 'COMPLETED' END").alias("status"),
        F.col("turn").alias("created_timestamp"),
        F.array(
            q(F.lit(""), F.lit("empty")),
            F.struct(F.lit(None).cast("struct<query:string,description:string>").alias("query")),
            q(F.when(F.col("turn") != 4, F.concat(F.lit("SELECT "), "turn")), F.when(F.col("turn") != 0, F.lit("second"))),
            q(F.lit("SELECT 99"), F.lit("third")),
        ).alias("attachments"),
    )
    return c.select(
        F.col("role").alias("space_id"),
        F.when(F.col("turn") != 1, name).when(F.col("conv_id") > 10, F.lit("")).alias("conversation_id"),
        F.when(F.col("turn") == 1, name).alias("id"),
        F.array(msg).alias("messages"),
    )


_HISTORY = r"""h AS (SELECT role AS space_id, concat(lpad(CAST(conv_id AS VARCHAR), 9, '0'), '-', turn) AS conversation_id,
        TRIM(text, ' ' || chr(10) || chr(9) || chr(13)) AS question, CASE WHEN turn = 4 THEN 'SELECT 99' ELSE concat('SELECT ', turn) END AS answer_sql,
        CASE turn WHEN 4 THEN 'third' WHEN 0 THEN '' ELSE 'second' END AS answer_description,
        CASE turn WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'QUERY_RESULT_EXPIRED' WHEN 3 THEN 'RUNNING' ELSE 'COMPLETED' END AS status, turn AS created_ts
    FROM conversations)"""
_HISTORY_OUT = "space_id, conversation_id, question, answer_sql, answer_description, status, created_ts"


def _written_docs(spark, d) -> DataFrame:
    path = scratch_path(spark, "conversations")
    conversation_docs(spark, d).write.json(path)
    return hist.read_conversations(spark, path)


@query("s5_history", f"WITH {_HISTORY} SELECT {_HISTORY_OUT} FROM h WHERE status <> 'RUNNING'")
def history(spark, d):
    return hist.history_messages(_written_docs(spark, d)).drop("msg_idx")


@query("s5_history_capped", f"""WITH {_HISTORY}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY space_id ORDER BY conversation_id) AS rn FROM h)
    SELECT {_HISTORY_OUT} FROM r WHERE rn <= 50 AND status <> 'RUNNING'""")
def history_capped(spark, d):
    return hist.history_messages(_written_docs(spark, d), hist.MAX_CONVERSATIONS).drop("msg_idx")


_CORPUS = """hist AS (SELECT space_id, 0 AS origin, pos, question FROM history WHERE COALESCE(question, '') <> ''),
    cur AS (SELECT space_id, 1 AS origin, MIN(pos) AS pos, TRIM(text) AS question FROM curated c WHERE TRIM(text) <> '' GROUP BY space_id, TRIM(text)),
    corpus AS (SELECT * FROM hist UNION ALL SELECT * FROM cur c WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.space_id = c.space_id AND h.question = c.question))"""


@query("s6_reference_corpus", with_views("history", "curated") + f", {_CORPUS} SELECT space_id, CAST(origin AS INTEGER) AS origin, pos, question FROM corpus")
def corpus(spark, d):
    return hist.reference_corpus(view(spark, d, "history"), view(spark, d, "curated"), ["space_id"])


@query("s6_corpus_counts", with_views("history", "curated") + f""", {_CORPUS}
    SELECT space_id, CAST(COUNT(*) FILTER (WHERE w = 'h') AS BIGINT) AS n_history, CAST(COUNT(*) FILTER (WHERE w = 'c') AS BIGINT) AS n_curated, CAST(COUNT(*) FILTER (WHERE w = 'r') AS BIGINT) AS n_ref FROM (
        SELECT space_id, 'h' AS w FROM hist UNION ALL SELECT space_id, 'c' FROM curated WHERE TRIM(text) <> '' UNION ALL SELECT space_id, 'r' FROM corpus) x GROUP BY space_id""")
def corpus_counts(spark, d):
    h, c = view(spark, d, "history"), view(spark, d, "curated")
    return hist.corpus_counts(h, c, hist.reference_corpus(h, c, ["space_id"]), ["space_id"])


@query("s6_curated_text", """SELECT conv_id, turn, CASE WHEN role = 'user' THEN text WHEN turn > 2 THEN role ELSE '' END AS text FROM conversations""")
def curated_text(spark, d):
    c = table(spark, d, "conversations").withColumn("a", F.when(F.col("role") == "user", F.col("text"))).withColumn("b", F.lit(""))
    c = c.withColumn("c", F.when(F.col("turn") > 2, F.col("role")))
    return c.select("conv_id", "turn", hist.curated_text("a", "b", "c").alias("text"))


@query("s7_label_csv", with_views("judge_labels") + "SELECT CAST(item_id AS VARCHAR) AS item_id, judge, judge_label, human_label FROM judge_labels")
def label_csv(spark, d):
    path = scratch_path(spark, "labels")
    view(spark, d, "judge_labels").write.option("ignoreLeadingWhiteSpace", False).csv(path, header=True)
    return hist.read_labels(spark, path)


_TYPE = """CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
    WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' END"""


@query("s8_column_metadata", " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", CAST(ROW_NUMBER() OVER () - 1 AS INTEGER) AS position, column_name AS "column", {_TYPE} AS "type", '' AS comment,
        (SELECT COUNT(*) FROM {t}) AS row_count FROM (DESCRIBE {t})""" for t in TABLES))
def column_metadata(spark, d):
    all_tables = tables(spark, d)
    return pf.column_catalog(all_tables, spark).join(pf.table_counts(all_tables, spark), "table")


@query("s9_runs_index", with_views("index_runs") + """
    SELECT run_id, run_name, space_id, experiment_path, submitted_at, submitted_by, concat('v', run_id) AS k FROM index_runs ORDER BY submitted_at DESC, run_id DESC LIMIT 50""")
def runs_index(spark, d):
    path = scratch_path(spark, "runs-index")
    runs = view(spark, d, "index_runs").withColumn("params_json", F.concat(F.lit('{"k": "v'), "run_id", F.lit('", "m": 3}')))
    for part in ("submitted_at < '1998-01-01'", "submitted_at >= '1998-01-01'"):
        sp.append_run(runs.where(part), path)
    recent = sp.recent_runs(spark.read.parquet(path), 50)
    return recent.select("run_id", "run_name", "space_id", "experiment_path", F.col("submitted_at").cast("timestamp_ntz").alias("submitted_at"), "submitted_by", F.col("params")["k"].alias("k"))


@query("s10_metric_log", with_views("votes") + """, t AS (SELECT family, COUNT(verdict) AS n_votes, COUNT(*) FILTER (WHERE verdict) AS n_match FROM votes GROUP BY family)
    SELECT family, 'eval_set_verification' AS run_name, 'metric' AS kind, 'n_votes' AS key, CAST(n_votes AS DOUBLE) AS value FROM t
    UNION ALL SELECT family, 'eval_set_verification', 'metric', 'n_match', n_match FROM t
    UNION ALL SELECT family, 'eval_set_verification', 'param', 'k', 5 FROM t""")
def metric_log(spark, d):
    path = scratch_path(spark, "metrics")
    s = view(spark, d, "votes").groupBy("family").agg(F.count("verdict").alias("n_votes"), F.count_if("verdict").alias("n_match"))
    s = s.withColumn("none", F.lit(None).cast("double")).withColumn("k", F.lit(5))
    rows = sc.metric_rows(s, ["family"], sc.VERIFICATION, {"n_votes": "n_votes", "n_match": "n_match", "absent": "none"}, {"k": "k"})
    sp.append_metrics(rows, path)
    return spark.read.parquet(path).withColumn("value", F.col("value").cast("double"))


@query("s11_preview", with_views("captures", "raw_items") + """
    SELECT question, c.expected_sql, c.category, difficulty, sql_executes, n_result_rows FROM captures c JOIN raw_items r USING (pos) ORDER BY c.pos LIMIT 200""")
def preview(spark, d):
    items = view(spark, d, "captures").join(view(spark, d, "raw_items").select("pos", "question", "difficulty"), "pos")
    return sp.preview_items(items.orderBy("pos"), 200)


@query("s12_capture", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 51""")
def capture(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return va.capture(o.orderBy(F.desc("o_totalprice"), "o_orderkey"))


@query("s13_space_inventory", """SELECT CASE WHEN c_acctbal < 0 THEN concat('data-', c_custkey) WHEN c_acctbal < 5000 THEN CAST(c_custkey AS VARCHAR) ELSE concat('s-', c_custkey) END AS space_id,
    CASE WHEN c_mktsegment = 'BUILDING' THEN '(untitled)' ELSE c_name END AS title, CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE c_mktsegment END AS description,
    CAST(CASE WHEN c_mktsegment = 'FURNITURE' THEN 0 ELSE 2 END AS BIGINT) AS n_tables, '' AS warehouse_id FROM customer""")
def space_inventory(spark, d):
    c = table(spark, d, "customer")
    return sp.space_inventory(c.select(
        F.when(F.col("c_acctbal").between(0, 4999.99), F.col("c_custkey")).alias("id"),
        F.when(F.col("c_acctbal") >= 5000, F.concat(F.lit("s-"), "c_custkey")).alias("space_id"),
        F.concat(F.lit("data-"), "c_custkey").alias("data_room_id"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).otherwise("").alias("title"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("description"),
        F.when(F.col("c_mktsegment") != "FURNITURE", F.array(F.lit("a"), F.lit("b"))).alias("table_identifiers"),
        F.lit(None).cast("string").alias("warehouse_id"),
    ))


@query("s14_counts_per_space", with_views("curated", "history") + """
    SELECT space_id, n_curated, n_messages FROM (SELECT space_id, COUNT(*) AS n_curated FROM curated GROUP BY space_id) c
    FULL JOIN (SELECT space_id, COUNT(*) AS n_messages FROM history GROUP BY space_id) h USING (space_id)""")
def counts_per_space(spark, d):
    c = sp.count_per_space(view(spark, d, "curated"), "n_curated")
    return c.join(sp.count_per_space(view(spark, d, "history"), "n_messages"), "space_id", "full_outer")


# --- profiling ---------------------------------------------------------------


@query("p1_row_counts", " UNION ALL ".join(f"""SELECT '{t}' AS "table", COUNT(*) AS row_count FROM {t}""" for t in TABLES) + """ UNION ALL SELECT 'absent', -1""")
def row_counts(spark, d):
    found = pf.open_tables(spark, {**{t: f"{d}/{t}.parquet" for t in TABLES}, "absent": f"{d}/absent.parquet"})
    return pf.table_counts(found, spark)


_FLEET = """asked AS (SELECT DISTINCT l_suppkey AS space_id, l_partkey AS "table" FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45),
    reg AS (SELECT DISTINCT l_suppkey AS space_id, l_partkey AS "table" FROM lineitem),
    resolved AS (SELECT x.space_id, x."table", COALESCE(p_size >= 10, FALSE) AS kept FROM (
        SELECT * FROM asked UNION ALL SELECT * FROM reg WHERE space_id NOT IN (SELECT space_id FROM asked)) x LEFT JOIN part ON p_partkey = x."table")"""


def _resolved(spark, d):
    l = table(spark, d, "lineitem")
    reg = l.select(F.col("l_suppkey").alias("space_id"), F.col("l_partkey").alias("table"), "l_returnflag", "l_quantity")
    seen = table(spark, d, "part").select(F.col("p_partkey").alias("table"), F.when(F.col("p_size") < 10, -1).otherwise(F.col("p_size")).alias("row_count"))
    return pf.resolve_tables(reg.where("l_returnflag = 'A' AND l_quantity > 45"), reg, seen, ["space_id"])


@query("p2_table_resolution", f"""WITH {_FLEET} SELECT space_id, "table", kept FROM resolved""")
def resolution(spark, d):
    return _resolved(spark, d)


@query("p2_required_tables", f"""WITH {_FLEET} SELECT space_id, "table", '' AS error FROM resolved WHERE kept
    UNION ALL SELECT space_id, NULL, 'no readable table left' FROM resolved GROUP BY space_id HAVING NOT BOOL_OR(kept)""")
def required(spark, d):
    return pf.require_tables(materialize(_resolved(spark, d), "resolved"), ["space_id"], fail=False)


_KINDS = "['decimal(12,2)', 'array<string>', 'timestamp', 'boolean', 'map<string,int>', 'date', 'struct<a:int>']"


@query("p3_column_eligibility", f"""WITH t AS (SELECT l_orderkey, l_linenumber, ({_KINDS})[l_linenumber] AS "type" FROM lineitem)
    SELECT l_orderkey, l_linenumber, "type", l_linenumber IN (1, 4, 6) AS sampled, l_linenumber IN (3, 6) AS ranged FROM t""")
def eligibility(spark, d):
    kinds = F.expr("array('decimal(12,2)', 'array<string>', 'timestamp', 'boolean', 'map<string,int>', 'date', 'struct<a:int>')")
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(kinds, F.col("l_linenumber")).alias("type"))
    return pf.column_eligibility(l)


@query("p4_low_card_values", " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{t}' AS "table", '{c}' AS "column", CAST({c} AS VARCHAR) AS value FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY COUNT(*) OVER () <= 30) q"""
    for t, cols in _SAMPLED.items() for c in cols))
def low_card(spark, d):
    return pf.profile_tables(tables(spark, d))


@query("p5_date_ranges", " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", CAST(MIN({c}) AS VARCHAR) AS lo, CAST(MAX({c}) AS VARCHAR) AS hi FROM {t}""" for t, cols in _RANGED.items() for c in cols))
def ranges(spark, d):
    return pf.profile_ranges(tables(spark, d))


# Every item that profiled columns and date ranges give, with what it is made of: its values (raw, x2, y), column pair (c, c2) and date column (d).
_ITEMS = f"""WITH v AS ({ORACLES["p4_low_card_values"]}), r AS ({ORACLES["p5_date_ranges"]}),
    c AS (SELECT "table" AS t, "column" AS c, MIN(value) AS least FROM v GROUP BY ALL),
    w AS (SELECT *, COALESCE(LEAD(c) OVER (PARTITION BY t ORDER BY c), FIRST_VALUE(c) OVER (PARTITION BY t ORDER BY c)) AS c2 FROM c),
    p AS (SELECT w.t, w.c, w.c2, n.least AS x2, replace(value, '''', '''''') AS x, value AS raw,
                 COALESCE(LEAD(value) OVER (PARTITION BY w.t, w.c ORDER BY value), FIRST_VALUE(value) OVER (PARTITION BY w.t, w.c ORDER BY value)) AS y
          FROM v JOIN w ON v."table" = w.t AND v."column" = w.c JOIN c n ON n.t = w.t AND n.c = w.c2),
    d AS (SELECT "table" AS t, "column" AS d, concat("column", ' BETWEEN ''', lo, ''' AND ''', hi, '''') AS span FROM r WHERE lo IS NOT NULL),
    items AS MATERIALIZED (SELECT DISTINCT * FROM (
        SELECT 'aggregation' AS fam, t, c, NULL AS raw, NULL AS c2, NULL AS x2, NULL AS y, NULL AS d, 'aggregation' AS category, 'medium' AS difficulty,
            concat('SELECT ', c, ', COUNT(*) AS n FROM ', t, ' GROUP BY ', c) AS expected_sql FROM p
        UNION ALL SELECT 'filter', t, c, raw, NULL, NULL, NULL, NULL, 'filter', 'easy', concat('SELECT COUNT(*) AS n FROM ', t, ' WHERE ', c, ' = ''', x, '''') FROM p
        UNION ALL SELECT 'ranking', t, c, raw, NULL, NULL, NULL, NULL, 'ranking', 'hard', concat('SELECT ', c, ', COUNT(*) AS n FROM ', t, ' WHERE ', c, ' <> ''', x, ''' GROUP BY ', c, ' HAVING COUNT(*) > 1 ORDER BY n DESC, ', c, ' LIMIT 3') FROM p
        UNION ALL SELECT 'ratio', t, c, raw, NULL, NULL, NULL, NULL, 'ratio_or_delta', 'hard', concat('SELECT 100.0 * SUM(CASE WHEN ', c, ' = ''', x, ''' THEN 1 ELSE 0 END) / COUNT(*) AS pct FROM ', t) FROM p
        UNION ALL SELECT 'distinct', t, c, raw, NULL, NULL, NULL, NULL, 'distinct_count', 'easy', concat('SELECT COUNT(DISTINCT ', c, ') AS n FROM ', t, ' WHERE ', c, ' <> ''', x, '''') FROM p
        UNION ALL SELECT 'windowed', t, c, raw, NULL, NULL, NULL, NULL, 'windowed', 'hard', concat('SELECT ', c, ', RANK() OVER (ORDER BY COUNT(*) DESC) AS rk FROM ', t, ' WHERE ', c, ' <> ''', x, ''' GROUP BY ', c) FROM p
        UNION ALL SELECT 'pair', t, c, raw, c2, x2, NULL, NULL, 'multi_condition', 'medium', concat('SELECT ', c, ', COUNT(*) AS n FROM ', t, ' WHERE ', c, ' = ''', x, ''' AND ', c2, ' = ''', replace(x2, '''', ''''''), ''' GROUP BY ', c) FROM p WHERE c <> c2
        UNION ALL SELECT 'rest', t, c, raw, NULL, NULL, y, NULL, 'multi_condition', 'medium', concat('SELECT ', c, ', COUNT(*) AS n FROM ', t, ' WHERE ', c, ' <> ''', x, ''' AND ', c2, ' <> ''', replace(y, '''', ''''''), ''' GROUP BY ', c) FROM p WHERE c = c2 AND raw <> y
        UNION ALL SELECT 'series', t, NULL, NULL, NULL, NULL, NULL, d, 'time_series', 'medium', concat('SELECT date_trunc(''month'', ', d, ') AS month, COUNT(*) AS n FROM ', t, ' WHERE ', span, ' GROUP BY date_trunc(''month'', ', d, ')') FROM d
        UNION ALL SELECT 'cohort', t, c, NULL, NULL, NULL, NULL, d, 'cohort', 'hard', concat('WITH c AS (SELECT ', c, ' AS k, MIN(', d, ') AS start FROM ', t, ' WHERE ', span, ' GROUP BY ', c, ') SELECT date_trunc(''month'', start) AS cohort, date_trunc(''month'', ', d,
            ') AS month, COUNT(DISTINCT k) AS n_values, COUNT(*) AS n FROM ', t, ' JOIN c ON ', c, ' = k WHERE ', span, ' GROUP BY date_trunc(''month'', start), date_trunc(''month'', ', d, ')') FROM c JOIN d USING (t)
        UNION ALL SELECT 'funnel', t, c, raw, NULL, NULL, y, d, 'funnel', 'hard', concat('WITH f AS (SELECT MIN(', d, ') AS start FROM ', t, ' WHERE ', c, ' = ''', replace(y, '''', ''''''), ''') SELECT COUNT(*) AS step_1, COUNT(CASE WHEN ', c, ' = ''', x,
            ''' THEN 1 END) AS step_2, COUNT(CASE WHEN ', c, ' = ''', x, ''' AND ', d, ' > start THEN 1 END) AS step_3 FROM ', t, ' CROSS JOIN f WHERE ', span) FROM p JOIN d USING (t) WHERE raw <> y) i)
    """


@query("q16_profiled_items", _ITEMS + 'SELECT DISTINCT t AS "table", category, difficulty, expected_sql FROM items')
def profiled_items(spark, d):
    return every_item(spark, d).select("table", "category", "difficulty", "expected_sql")


def _cells_sql() -> str:
    """Every row of every table as (t, rid, day) with a (c, v) for each of its columns that values are sampled of."""
    parts = []
    for t, names in _SAMPLED.items():
        day = f"CAST({_RANGED[t][0]} AS TIMESTAMP)" if t in _RANGED else "CAST(NULL AS TIMESTAMP)"
        cells = ", ".join(f"{{'c': '{n}', 'v': CAST({n} AS VARCHAR)}}" for n in names)
        parts.append(f"SELECT '{t}' AS t, rid, day, x.c, x.v FROM (SELECT row_number() OVER () AS rid, {day} AS day, UNNEST([{cells}]) AS x FROM {t})")
    return " UNION ALL ".join(parts)


_MONTH = "strftime(date_trunc('month', {}), '%Y-%m-%d %H:%M:%S')"
# what each kind of item returns, as rows of text, worked out from the cells and not by running its statement
_RESULTS = f""",
    cell AS MATERIALIZED (SELECT x.* FROM ({_cells_sql()}) x JOIN c USING (t, c)),
    g AS MATERIALIZED (SELECT t, c, v, COUNT(*) AS n FROM cell GROUP BY ALL),
    total AS (SELECT t, c, SUM(n) AS n FROM g GROUP BY ALL),
    ranks AS (SELECT i.expected_sql, g.v, g.n, ROW_NUMBER() OVER (PARTITION BY i.expected_sql ORDER BY g.n DESC, TRY_CAST(g.v AS BIGINT), g.v) AS place, RANK() OVER (PARTITION BY i.expected_sql ORDER BY g.n DESC) AS rk
              FROM items i JOIN g USING (t, c) WHERE i.fam IN ('ranking', 'windowed') AND g.v <> i.raw AND (i.fam = 'windowed' OR g.n > 1)),
    days AS (SELECT DISTINCT t, rid, day FROM cell WHERE day IS NOT NULL),
    starts AS (SELECT t, c, v, MIN(day) AS start FROM cell WHERE day IS NOT NULL GROUP BY ALL),
    made AS (
        SELECT expected_sql, concat(COALESCE(g.v, '∅'), '|', g.n) AS line FROM items i JOIN g USING (t, c) WHERE fam = 'aggregation'
        UNION ALL SELECT expected_sql, CAST(COALESCE(g.n, 0) AS VARCHAR) FROM items i LEFT JOIN g ON g.t = i.t AND g.c = i.c AND g.v = i.raw WHERE fam = 'filter'
        UNION ALL SELECT expected_sql, concat(v, '|', r.n) FROM items i JOIN ranks r USING (expected_sql) WHERE fam = 'ranking' AND place <= 3
        UNION ALL SELECT expected_sql, concat(q // 100000000000000, '.', lpad(CAST(q % 100000000000000 AS VARCHAR), 14, '0')) FROM (
            SELECT i.expected_sql, (2 * 100::HUGEINT * 100000000000000 * COALESCE(g.n, 0) + o.n) // (2 * o.n) AS q
            FROM items i JOIN total o USING (t, c) LEFT JOIN g ON g.t = i.t AND g.c = i.c AND g.v = i.raw WHERE fam = 'ratio') z
        UNION ALL SELECT expected_sql, CAST(COUNT(g.v) AS VARCHAR) FROM items i LEFT JOIN g ON g.t = i.t AND g.c = i.c AND g.v <> i.raw WHERE fam = 'distinct' GROUP BY expected_sql
        UNION ALL SELECT expected_sql, concat(v, '|', rk) FROM items i JOIN ranks r USING (expected_sql) WHERE fam = 'windowed'
        UNION ALL SELECT expected_sql, concat(i.raw, '|', COUNT(*)) FROM items i JOIN cell a ON a.t = i.t AND a.c = i.c AND a.v = i.raw JOIN cell b ON b.t = i.t AND b.rid = a.rid AND b.c = i.c2 AND b.v = i.x2
            WHERE fam = 'pair' GROUP BY expected_sql, i.raw
        UNION ALL SELECT expected_sql, concat(g.v, '|', g.n) FROM items i JOIN g ON g.t = i.t AND g.c = i.c AND g.v <> i.raw AND g.v <> i.y WHERE fam = 'rest'
        UNION ALL SELECT expected_sql, concat({_MONTH.format("day")}, '|', COUNT(*)) FROM items i JOIN days USING (t) WHERE fam = 'series' GROUP BY expected_sql, date_trunc('month', day)
        UNION ALL SELECT expected_sql, concat({_MONTH.format("start")}, '|', {_MONTH.format("day")}, '|', COUNT(DISTINCT v), '|', COUNT(*))
            FROM items i JOIN cell USING (t, c) JOIN starts USING (t, c, v) WHERE fam = 'cohort' AND day IS NOT NULL GROUP BY expected_sql, date_trunc('month', start), date_trunc('month', day)
        UNION ALL SELECT expected_sql, concat(COUNT(*), '|', COUNT(CASE WHEN cell.v = i.raw THEN 1 END), '|', COUNT(CASE WHEN cell.v = i.raw AND day > start THEN 1 END))
            FROM items i JOIN cell USING (t, c) LEFT JOIN starts s ON s.t = i.t AND s.c = i.c AND s.v = i.y WHERE fam = 'funnel' AND day IS NOT NULL GROUP BY expected_sql),
    sums AS (SELECT expected_sql, COUNT(*) AS n, STRING_AGG(line, ';' ORDER BY line) AS lines FROM made GROUP BY expected_sql)
    SELECT i.expected_sql, TRUE AS sql_executes, '' AS sql_error, LEAST(COALESCE(n, 0), 51) AS n_result_rows, COALESCE(n, 0) > 0 AS nonempty_result, TRUE AS sql_deterministic,
           CASE WHEN COALESCE(n, 0) <= 50 THEN COALESCE(lines, '') END AS sorted_rows
    FROM (SELECT DISTINCT expected_sql FROM items) i LEFT JOIN sums USING (expected_sql)"""


@query("v1_execute_and_capture", _ITEMS.rstrip() + _RESULTS)
def execute(spark, d):
    """Captures of the statements of all items; rows in any order, of results that the cap left whole."""
    star_views(spark, d)
    values, ranges = profiles(spark, d)
    made = materialize(it.profiled_items(values, ranges).select(va.statement_id("expected_sql").alias("question_id"), "expected_sql").distinct(), "statements")
    # cohorts join a table that has dates with the groups of its columns; one row for each such table
    dated = values.join(ranges.select("table").distinct(), "table", "left_semi").groupBy("table").agg(F.sort_array(F.collect_set("column")).alias("columns"))
    grouped = {r["table"]: r["columns"] for r in dated.collect()}
    with with_statistics(spark, {t: table_path(d, t) for t in grouped}, grouped):
        got = va.execute_items(made, "question_id")
    got = got.join(made, "question_id")
    rows = F.from_json("expected_rows_json", "array<array<string>>")
    lines = F.array_sort(F.transform(rows, lambda r: F.array_join(r, "|", "∅")))
    whole = F.when(F.col("n_result_rows") <= ROW_CAP, F.array_join(lines, ";"))
    return got.select("expected_sql", "sql_executes", "sql_error", "n_result_rows", "nonempty_result", "sql_deterministic", whole.alias("sorted_rows"))


@query("p6_declared_fks", """SELECT o_orderstatus AS table_schema, concat('orders', o_orderkey) AS table_name, concat('col', l_linenumber) AS fk_col,
    concat_ws('.', 'cat', c_mktsegment, c_name) AS ref_table, concat('key', c_nationkey) AS ref_col
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority <> '5-LOW'""")
def declared_fks(spark, d):
    o, l, c = (table(spark, d, t) for t in ("orders", "lineitem", "customer"))
    cat, sch = F.lit("cat").alias("constraint_catalog"), F.lit("s").alias("constraint_schema")
    fk = F.concat(F.lit("fk"), "o_orderkey").alias("constraint_name")
    tc = o.select(cat, sch, fk, F.col("o_orderstatus").alias("table_schema"), F.concat(F.lit("orders"), "o_orderkey").alias("table_name"),
                  F.when(F.col("o_orderpriority") == "5-LOW", "PRIMARY KEY").otherwise("FOREIGN KEY").alias("constraint_type"))
    kcu = l.select(cat, sch, F.concat(F.lit("fk"), "l_orderkey").alias("constraint_name"), F.concat(F.lit("col"), "l_linenumber").alias("column_name"))
    rc = o.select(cat, sch, fk, F.lit("cat").alias("unique_constraint_catalog"), F.lit("u").alias("unique_constraint_schema"),
                  F.concat(F.lit("pk"), "o_custkey").alias("unique_constraint_name"))
    ccu = c.select(cat, F.lit("u").alias("constraint_schema"), F.concat(F.lit("pk"), "c_custkey").alias("constraint_name"), F.lit("cat").alias("table_catalog"),
                   F.col("c_mktsegment").alias("table_schema"), F.col("c_name").alias("table_name"), F.concat(F.lit("key"), "c_nationkey").alias("column_name"))
    return pf.declared_fks(tc, kcu, rc, ccu)


@query("p7_shared_columns", with_views("fleet_columns") + """, c AS (SELECT space_id, LOWER("column") AS "column", "table", position FROM fleet_columns WHERE LOWER("column") NOT IN ('id', 'name', 'date', 'value', 'type', 'status')),
    first AS (SELECT space_id, "column", "table" AS t0, position AS p0, ROW_NUMBER() OVER (PARTITION BY space_id, "column" ORDER BY "table", position) AS k FROM c),
    per AS (SELECT space_id, "column", COUNT(DISTINCT "table") AS n_tables FROM c GROUP BY ALL HAVING COUNT(DISTINCT "table") >= 2),
    ranked AS (SELECT per.*, ROW_NUMBER() OVER (PARTITION BY space_id ORDER BY t0, p0, "column") AS rn FROM per JOIN (SELECT * FROM first WHERE k = 1) f USING (space_id, "column"))
    SELECT DISTINCT space_id, "column", n_tables, "table" FROM ranked JOIN c USING (space_id, "column") WHERE rn <= 15""")
def shared_columns(spark, d):
    return pf.shared_columns(view(spark, d, "fleet_columns"), ["space_id"])


_USED = """uses(kind, "column") AS (VALUES (5, 'o_orderdate'), (6, 'c_name'), (6, 'c_custkey'), (7, 'c_mktsegment'), (7, 'c_acctbal'), (8, 'o_custkey'), (9, 'o_custkey'),
    (10, 'c_mktsegment'), (10, 'c_nationkey'), (11, 'o_orderkey'), (11, 'o_custkey'), (11, 'o_totalprice'), (12, 'o_custkey'), (12, 'o_totalprice'),
    (13, 'n_name'), (13, 'n_nationkey'), (14, 'o_orderstatus'), (14, 'o_custkey'), (15, 'c_nationkey'), (15, 'n_nationkey'), (15, 'c_mktsegment'), (15, 'n_name')),
    used AS (SELECT DISTINCT "column" FROM uses JOIN (SELECT DISTINCT CASE WHEN kind < 4 THEN 15 ELSE kind END AS kind FROM raw_items) USING (kind)),
    known AS (""" + " UNION ALL ".join(
    f"""SELECT column_name AS "column" FROM (DESCRIBE {t})""" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")) + ")"


@query("p8_used_columns", with_views("raw_items") + f""", {_USED} SELECT "column", "column" IN (SELECT "column" FROM used) AS used FROM known""")
def used_columns(spark, d):
    return pf.used_columns(view(spark, d, "raw_items"), star_catalog(spark, d))


@query("p8_column_coverage", with_views("raw_items") + f""", {_USED}
    SELECT COUNT(*) AS n_columns, COUNT(*) FILTER (WHERE "column" IN (SELECT "column" FROM used)) AS n_used,
           ROUND(AVG(CASE WHEN "column" IN (SELECT "column" FROM used) THEN 1.0 ELSE 0.0 END), 3)::DOUBLE AS column_coverage FROM known""")
def column_coverage(spark, d):
    return pf.column_coverage(view(spark, d, "raw_items"), star_catalog(spark, d))


def _space_rows(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.groupBy(F.col("conv_id").alias("space_id")).agg(
        F.count("*").alias("n_tables"), F.max(F.when(F.col("role") == "system", F.col("text"))).alias("instructions")
    ).withColumn("title", F.concat(F.lit("Space "), "space_id")).withColumn("description", F.lit(None).cast("string"))


_NL = "chr(10)"


@query("p9_context_document", with_views("history", "curated") + f""", s AS (SELECT conv_id AS space_id, COUNT(*) AS n_tables, MAX(CASE WHEN role = 'system' THEN text END) AS ins FROM conversations GROUP BY conv_id),
    c AS (SELECT space_id, STRING_AGG(concat('  - ', text), {_NL} ORDER BY rn) AS b FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY space_id ORDER BY pos) AS rn FROM curated) x WHERE rn <= 20 AND COALESCE(text, '') <> '' GROUP BY space_id),
    h AS (SELECT space_id, STRING_AGG(CASE WHEN done = 0 THEN concat('  - [KNOWN GAP] ', q) ELSE concat('  - ', q, '  -- answered with: ', a) END, {_NL} ORDER BY rn) AS b FROM (
        SELECT space_id, done, substring(question, 1, 200) AS q, substring(trim(regexp_replace(answer_sql, '\\s+', ' ', 'g')), 1, 160) AS a, ROW_NUMBER() OVER (PARTITION BY space_id ORDER BY done, pos) AS rn
        FROM (SELECT *, CASE status WHEN 'FAILED' THEN 0 ELSE 1 END AS done FROM history WHERE status IN ('FAILED', 'COMPLETED')) y) x WHERE rn <= 5 GROUP BY space_id),
    f AS (SELECT conv_id AS space_id, STRING_AGG(concat('  - t', turn, '.k → u.', role), {_NL} ORDER BY turn) AS b FROM conversations WHERE turn >= 4 GROUP BY conv_id),
    j AS (SELECT conv_id AS space_id, STRING_AGG(concat('  - `c', turn, '` appears in: a, b'), {_NL} ORDER BY turn) AS b FROM conversations WHERE turn BETWEEN 1 AND 3 GROUP BY conv_id)
    SELECT s.space_id, concat_ws({_NL} || {_NL}, concat('Space title: Space ', s.space_id), 'Space description: ', CASE WHEN COALESCE(ins, '') <> '' THEN concat('Space instructions:', {_NL}, ins) END,
        CASE WHEN n_tables > 1 AND c.b <> '' THEN concat('CURATED QUESTIONS (style to follow, not to copy):', {_NL}, c.b) END,
        CASE WHEN h.b <> '' THEN concat('Questions from history (vocabulary only):', {_NL}, h.b) END,
        CASE WHEN f.b <> '' THEN concat('Declared join paths:', {_NL}, f.b) WHEN n_tables > 1 AND j.b <> '' THEN concat('Join columns inferred from shared names:', {_NL}, j.b) END,
        concat('Extra instructions:', {_NL}, 'be brief'),
        CASE WHEN n_tables = 1 THEN '{pf.SINGLE_TABLE_NOTE}' END) AS context
    FROM s LEFT JOIN c USING (space_id) LEFT JOIN h USING (space_id) LEFT JOIN f USING (space_id) LEFT JOIN j USING (space_id)""")
def context(spark, d):
    return pf.context_document(*_context_parts(spark, d), extra="be brief")


def _context_parts(spark, d):
    c = table(spark, d, "conversations").withColumn("space_id", F.col("conv_id"))
    fks = c.where("turn >= 4").select("space_id", F.concat(F.lit("t"), "turn").alias("from_table"), F.lit("k").alias("fk_col"), F.lit("u").alias("ref_table"), F.col("role").alias("ref_col"))
    shared = c.where("turn BETWEEN 1 AND 3").select("space_id", F.concat(F.lit("c"), "turn").alias("column"), F.explode(F.array(F.lit("b"), F.lit("a"))).alias("table"))
    return _space_rows(spark, d), ["space_id"], view(spark, d, "curated"), view(spark, d, "history"), fks, shared


def _lines_of(name: str) -> str:
    """The lines of the documents that another query gives, in order."""
    return f"""SELECT space_id, UNNEST(RANGE(1, len(l) + 1)) AS line_no, UNNEST(l) AS line FROM (SELECT space_id, string_split(context, chr(10)) AS l FROM ({ORACLES[name]}) x) y"""


@query("p9_context_sections", _lines_of("p9_context_document"))
def context_sections(spark, d):
    return pf.document_lines(pf.context_sections(*_context_parts(spark, d), extra="be brief"), ["space_id"])


@query("p10_solver_context", with_views("curated") + f""", t AS (SELECT o_custkey AS space_id, STRING_AGG(concat('TABLE ', o_orderkey, {_NL}, '  - a: string  -- ', o_orderstatus, {_NL}, '  - b: int', {_NL}, 'sample values:', {_NL}, '  - a: [''', o_orderpriority, ''']'), {_NL} || {_NL} ORDER BY CAST(o_orderkey AS VARCHAR)) AS b
        FROM orders GROUP BY o_custkey),
    c AS (SELECT space_id, STRING_AGG(concat('  - ', text), {_NL} ORDER BY rn) AS b FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY space_id ORDER BY pos) AS rn FROM curated) x WHERE rn <= 20 AND COALESCE(text, '') <> '' GROUP BY space_id)
    SELECT t.space_id, concat_ws({_NL} || {_NL}, t.b, concat('SPACE INSTRUCTIONS:', {_NL}, c_mktsegment), CASE WHEN c.b <> '' THEN concat('CURATED EXAMPLE QUESTIONS:', {_NL}, c.b) END) AS context
    FROM t LEFT JOIN customer ON c_custkey = t.space_id LEFT JOIN c ON c.space_id = t.space_id""")
def solver_context(spark, d):
    return pf.solver_context(*_solver_parts(spark, d))


def _solver_parts(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("space_id"), F.col("o_orderkey").cast("string").alias("table"), "o_orderstatus", "o_orderpriority"
    )
    cols = o.select("space_id", "table", F.inline(F.array(
        F.struct(F.lit(0).alias("position"), F.lit("a").alias("column"), F.lit("string").alias("type"), F.col("o_orderstatus").alias("comment")),
        F.struct(F.lit(1).alias("position"), F.lit("b").alias("column"), F.lit("int").alias("type"), F.lit("").alias("comment")),
    )))
    key = ["space_id", "table"]
    values = o.select(*key, F.lit("a").alias("column"), F.col("o_orderpriority").alias("value"))
    spans = spark.createDataFrame([], "space_id bigint, table string, column string, lo string, hi string")
    profiles = pf.schema_text(cols, key).join(pf.sample_lines(values, spans, key), key)
    instructions = table(spark, d, "customer").select(F.col("c_custkey").alias("space_id"), F.col("c_mktsegment").alias("instructions"))
    return profiles, ["space_id"], instructions, view(spark, d, "curated")


@query("p10_solver_sections", _lines_of("p10_solver_context"))
def solver_sections(spark, d):
    return pf.document_lines(pf.solver_sections(*_solver_parts(spark, d)), ["space_id"])
