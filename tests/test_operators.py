import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame, functions as F

from evalspark.functions.stats import n_for_half, wilson_half
from evalspark.operators import calibrate as cal
from evalspark.operators import gate, items as it, profile as pf, regress, reliability as rel, scorecard as sc, validate as va

T, N, X = True, None, False
VOTES = [
    ([("gen", T), ("judge", T)], "gold"), ([("gen", T), ("judge", T), ("gen", X)], "verified"),
    ([("gen", T), ("gen", T), ("gen", T), ("judge", X), ("judge", X)], "quarantine"),
    ([("gen", T), ("judge", X), ("gen", X), ("judge", T)], "quarantine"),
    ([("gen", T), ("judge", N), ("judge", T)], "gold"), ([("gen", N), ("judge", N)], "not_evaluable"),
]


@pytest.mark.parametrize("seed", [None, 1])
def test_verify_tier(spark, seed):
    rows = [(i, s, f, v) for i, (vs, _) in enumerate(VOTES) for s, (f, v) in enumerate(vs)]
    if seed:
        random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, "question_id int, solver_idx int, family string, verdict boolean")
    got = {r["question_id"]: r["verify_tier"] for r in gate.verify_tier(df).collect()}
    assert [got[i] for i in range(len(VOTES))] == [w for _, w in VOTES]


def test_empirical_difficulty(spark):
    cases = [(0, 5, "suspect"), (1, 5, "hard"), (2, 5, "medium"), (4, 5, "easy"), (5, 5, "easy"), (0, 0, "unknown")]
    df = spark.createDataFrame(cases, "m int, v int, want string")
    assert df.where(gate.empirical_difficulty("m", "v") != F.col("want")).count() == 0


def test_panel_plan(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 2, 5, 9)], "k int")
    n = {r["k"]: r["count"] for r in gate.panel_plan(df, F.col("k")).groupBy("k").count().collect()}
    assert n == {2: 2, 5: 5, 9: 5}


def test_repair_needs_a_changed_question_and_a_trusted_revote(spark):
    gated = spark.createDataFrame(
        [(1, "a", "quarantine", 0.4, "medium"), (2, "b", "quarantine", 0.0, "suspect"), (3, "c", "gold", 1.0, "easy"), (4, "d", "quarantine", 0.2, "hard")],
        "question_id int, question string, verify_tier string, verify_agreement double, difficulty_empirical string")
    rewrites = spark.createDataFrame([(1, "a2"), (2, "b"), (3, "c2"), (4, "d2")], "question_id int, new_question string")
    rv = [(q, s, "gen" if s % 2 == 0 else "judge", True) for q in (1, 2, 3) for s in range(3)] + [(4, 0, "gen", True), (4, 1, "judge", False), (4, 3, "judge", True)]
    revotes = spark.createDataFrame(rv, "question_id int, solver_idx int, family string, verdict boolean")
    got = {r["question_id"]: (r["question"], r["verify_tier"], r["question_orig"], r["verify_repaired"]) for r in gate.repair_merge(gated, rewrites, revotes, ["question_id"]).collect()}
    assert got == {1: ("a2", "gold", "a", True), 2: ("b", "quarantine", "", False), 3: ("c", "gold", "", False), 4: ("d", "quarantine", "", False)}


def half(p, n, z=1.96):
    return z * ((p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n) if n else 0.0


def test_wilson(spark):
    df = spark.createDataFrame([(p / 1000, 42) for p in range(100, 901)] + [(0.5, 0), (0.5, 50), (0.5, 200)], "p double, n int")
    got = {(r["p"], r["n"]): r["h"] for r in df.select("p", "n", wilson_half("p", F.col("n")).alias("h")).collect()}
    assert abs(got[0.5, 42] - 0.144743) < 2e-5 and got[0.5, 0] == 0 and got[0.5, 50] > got[0.5, 200]
    floor = min(h for (_, n), h in got.items() if n == 42)
    assert abs(floor - 0.09314) < 1e-4 and floor > 0.07


def test_sample_size_is_the_smallest(spark):
    rng = random.Random(5)
    cases = [(rng.random(), rng.choice([0.03, 0.05, 0.1, 0.2, 0.6]), rng.choice([0, 2, 30, 400])) for _ in range(60)] + [(0.5, 0.10, 2), (0.0, 0.1, 2), (1.0, 0.1, 2)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p double, t double, f int")
    got = {r["i"]: r["n"] for r in df.select("i", n_for_half("p", F.col("t"), "f").alias("n")).collect()}
    for i, (p, t, f) in enumerate(cases):
        n = max(f, 2)
        while half(p, n) > t and n < 100000:
            n += 1
        assert got[i] == n, cases[i]
    assert 90 <= got[60] <= 100
    big = spark.range(1).select(n_for_half(F.lit(0.5), F.lit(0.0001), 2).alias("a"), n_for_half(F.lit(0.5), F.lit(0.0001), 200000).alias("b")).first()
    assert (big["a"], big["b"]) == (100000, 200000)


def matrix(spark, rows):
    return spark.createDataFrame([(q, r, v) for q, vs in enumerate(rows) for r, v in enumerate(vs)], "question_id int, run_idx int, passed int")


def test_rerun_agreement(spark):
    get = lambda m: rel.rerun_agreement(matrix(spark, m), ["question_id"]).first()
    r = get([[1, 1, 1]] * 13 + [[1, 0, 1]])
    assert (r["n_unanimous"], r["n_judgeable"]) == (13, 14) and r["rerun_agreement"] == pytest.approx(13 / 14)
    assert get([[1, 1], [0, 0]])["rerun_agreement"] == 1.0
    r = get([[1, None], [1, 0]])
    assert (r["n_judgeable"], r["rerun_agreement"]) == (1, 0.0)
    assert get([[1, None], [None, None]])["rerun_agreement"] is None


def test_concordance(spark):
    get = lambda m: rel.question_concordance(matrix(spark, m), ["question_id"]).first()
    assert (get([[1, 0]])["n_units"], get([[1, 0]])["concordance"]) == (1, 0.0)
    r = get([[1, 1, 1]] * 13 + [[0, 0, 1]])
    assert r["n_units"] == 14 and r["concordance"] == pytest.approx(13 / 14)


def test_gate_decision(spark):
    r = rel.reliability(matrix(spark, [[1, 1]] * 60 + [[0, 0]] * 60), ["question_id"]).first()
    assert r["gateable"] and r["pooled"] == 0.5 and r["n_needed"] == 120
    assert not rel.reliability(matrix(spark, [[1, 1]] * 120), ["question_id"]).first()["gateable"]  # degenerate
    empty = rel.reliability(matrix(spark, [[None, None]]), ["question_id"]).first()
    assert (empty["n_units"], empty["ci_low"], empty["ci_high"], empty["gateable"]) == (0, 0.0, 0.0, False)


def labels(spark, pairs, judge="j"):
    return spark.createDataFrame([(str(i), judge, a, b) for i, (a, b) in enumerate(pairs)], "item_id string, judge string, judge_label string, human_label string")


def test_kappa(spark):
    k = lambda p: cal.calibrate(labels(spark, p)).first()["kappa"]
    assert k([("1", "1"), ("1", "1"), ("0", "0"), ("0", "0")]) == 1.0
    assert k([("1", "0"), ("0", "1"), ("1", "0"), ("0", "1")]) == -1.0
    assert k([("PASS", "yes")] * 4) == 1.0
    row = spark.createDataFrame([("PASS",), ("fail",), (" T ",), ("maybe",)], "s string").select(cal.to_binary("s").alias("b")).collect()
    assert [r["b"] for r in row] == [1, 0, 1, None]


def test_calibration_verdicts(spark):
    mixed = [("1", "1")] * 6 + [("0", "0")] * 6
    below = [("1", "0")] * 6 + [("0", "1")] * 6
    df = labels(spark, mixed, "a").union(labels(spark, below, "b")).union(labels(spark, mixed[:4], "c")).union(labels(spark, [("1", "1")] * 12, "d"))
    stats = cal.calibrate(df)
    got = {r["judge"]: r["verdict"] for r in stats.collect()}
    assert got == {"a": "OK", "b": "BELOW κ 0.6", "c": "—", "d": "not calibratable (single-class human labels)"}
    assert cal.calibration_passes(stats).first()["n_below"] == 1
    bad = labels(spark, [("maybe", "1")])
    with pytest.raises(Exception, match="unrecognised label"):
        cal.calibrate(bad).collect()
    assert cal.code_labels(bad)[1].count() == 1


def test_monotonicity(spark):
    rows = [("s1", "easy", 0.9, 9), ("s1", "medium", 0.95, 9), ("s1", "hard", 0.96, 4), ("s2", "easy", 0.9, 5), ("s2", "medium", 0.5, 5), ("s2", "hard", 0.5, 5), ("s3", "easy", 0.1, 9)]
    df = spark.createDataFrame(rows, "space_id string, difficulty string, pass_rate double, n int")
    got = {r["space_id"]: (r["violations"], r["monotonic"]) for r in regress.monotonicity(df, ["space_id"]).collect()}
    assert got == {"s1": (1, False), "s2": (0, True), "s3": (None, None)}


def test_eligible_with_missing_columns(spark):
    df = spark.createDataFrame([(1, "gold", None), (2, None, True), (3, "quarantine", True), (4, "verified", False)], "question_id int, verify_tier string, sql_deterministic boolean")
    assert sorted(r[0] for r in regress.eligible(df).collect()) == [1, 2]
    assert regress.eligible(df.select("question_id")).count() == 4


def test_generation_plan(spark):
    df = spark.createDataFrame([(1, 12, 5), (2, 14, 5), (3, 45, 9), (4, 41, 2), (5, 0, 1)], "t int, n int, min_hard int")
    got = {}
    for r in it.generation_plan(df).orderBy("t", "chunk").collect():
        got.setdefault(r["t"], []).append((r["chunk_n"], r["chunk_hard"], r["focus"]))
    assert got[1] == [(12, 5, "aggregation_filter")]
    assert got[2] == [(7, 2, "aggregation_filter"), (7, 2, "ranking_topn")]
    assert [c[0] for c in got[3]] == [12, 12, 12, 9] and [c[0] for c in got[4]] == [11, 11, 11, 8]


def test_templates():
    with pytest.raises(ValueError):
        it.check_template("{{n}} only")
    assert "  3. Be brief" in it.add_rule(it.DEFAULT_TEMPLATE, " Be brief ")


def test_parse_replies(spark):
    rows = [(1, '{"questions": [{"question": "a", "expected_sql": "b"}, {"question": 5}]}'), (2, None), (3, '{"questions": [{"qu'), (4, "{}"), (5, "no json")]
    df = spark.createDataFrame(rows, "reply_id int, content string")
    good, bad = it.parse_replies(df)
    assert [(r["reply_id"], r["item_idx"], r["question"]) for r in good.orderBy("item_idx").collect()] == [(1, 0, "a"), (1, 1, "5")]
    assert {r["reply_id"]: r["error"] for r in bad.collect()} == {2: "reply is empty", 3: "reply is not the expected JSON", 5: "reply is not the expected JSON"}


def test_reply_scores(spark):
    item = '{"question":"q","expected_sql":"SELECT RANK( x WHERE a = \'x\'","expected_shape":"s","category":"c","difficulty":"Hard","why_non_trivial":"w"}'
    poor = '{"question":"q","expected_sql":"SELECT 1 WHERE a = \'zz\'","difficulty":"hard"}'
    rows = [(1, '{"questions":[%s,%s]}' % (item, poor), "- a: ['x']", 2), (2, '{"questions":[%s]}' % poor, "", 1), (3, '{"questions":[]}', "- a: ['x']", 1), (4, "{", "", 1), (5, '{"questions":[%s]}' % item, "- a: ['x']", 0)]
    df = spark.createDataFrame(rows, "r int, content string, column_samples string, min_hard int")
    got = {r["r"]: (r["json_shape"], r["grounded_values"], r["hard_distribution"]) for r in va.score_replies(df).collect()}
    assert got == {1: (0.5, 0.5, 0.5), 2: (0.0, 1.0, 0.0), 3: (0.0, 0.0, 0.0), 4: (0.0, 0.0, 0.0), 5: (1.0, 1.0, 1.0)}


def test_execute_items(spark):
    spark.createDataFrame([(i, i % 3) for i in range(200)], "a int, b int").createOrReplaceTempView("exec_t")
    rows = [("ok", "SELECT b, count(*) FROM exec_t GROUP BY b"), ("wide", "SELECT a FROM exec_t"), ("none", "SELECT a FROM exec_t WHERE a < 0"),
            ("write", "DROP TABLE exec_t"), ("bad", "SELECT nope FROM exec_t"), ("random", "SELECT rand() AS r FROM exec_t"), ("one", "SELECT uuid() AS u")]
    df = spark.createDataFrame(rows, "question_id string, expected_sql string")
    got = {r["question_id"]: r for r in va.execute_items(df, "question_id", batch=3).collect()}
    flags = {k: (r["sql_executes"], r["n_result_rows"], r["nonempty_result"], r["sql_deterministic"]) for k, r in got.items()}
    assert flags == {"ok": (True, 3, True, True), "wide": (True, 51, True, True), "none": (True, 0, False, True), "write": (False, 0, False, True),
                     "bad": (False, 0, False, True), "random": (True, 51, True, False), "one": (True, 1, True, False)}
    assert got["write"]["sql_error"].startswith("not run") and "nope" in got["bad"]["sql_error"]


def test_low_card_and_ranges(spark):
    df = spark.sql("SELECT id, CAST(id % 3 AS STRING) AS s, id % 2 = 0 AS b, CAST(NULL AS INT) AS n, CAST(id AS DOUBLE) AS d, date_add(DATE'2024-01-01', CAST(id AS INT)) AS dt, CAST(id % 31 AS INT) AS m FROM range(1000)")
    got = {}
    for r in pf.low_card_values(df).collect():
        got.setdefault(r["column"], []).append(r["value"])
    assert {k: sorted(v) for k, v in got.items()} == {"s": ["0", "1", "2"], "b": ["false", "true"]}
    assert [tuple(r) for r in pf.date_ranges(df).collect()] == [("dt", "2024-01-01", "2026-09-26")]


def test_describe_stops_at_first_header(spark):
    spark.sql("DROP TABLE IF EXISTS describe_t")
    spark.sql("CREATE TABLE describe_t (a INT COMMENT 'key', p STRING) USING parquet PARTITIONED BY (p) COMMENT 'about'")
    rows = pf.describe_columns(spark, "describe_t").collect()
    spark.sql("DROP TABLE describe_t")
    assert [(r["column"], r["type"], r["comment"]) for r in rows] == [("a", "int", "key"), ("p", "string", "")] and rows[0]["table_comment"] == "about"


def test_scorecard_prefers_current_keys(spark):
    rows = [(1, sc.REALISM, "metric", "p_at_h", "0.5"), (1, sc.REALISM, "metric", "mean_nn_cosine", "0.7"), (2, sc.REALISM, "metric", "p_at_h", "0.5"), (2, sc.STABILITY, "param", "gateable", "True")]
    df = spark.createDataFrame(rows, "job_run_id int, run_name string, kind string, key string, value string")
    got = {r["job_run_id"]: r for r in sc.scorecard(df, ["job_run_id"]).collect()}
    assert (got[1]["diversity_mean_nn_cosine"], got[2]["diversity_mean_nn_cosine"]) == (0.7, 0.5)
    assert got[2]["reliability_gateable"] == "True" and got[2]["reliability_computed"] and not got[1]["reliability_computed"]


def test_typed_aggregates_per_space(spark):
    items = spark.createDataFrame([(1, 1, "SELECT SUM(x) FROM t"), (2, 2, "SELECT SUM(x) FROM t"), (3, 3, "SELECT SUM(x) FROM t")], "pos int, space_id int, expected_sql string")
    cat = spark.createDataFrame([(1, "t", 0, "X", "string"), (2, "t", 0, "x", "int"), (2, "u", 0, "x", "string")], "space_id int, table string, position int, column string, type string")
    assert sorted(r["pos"] for r in it.drop_typed_violations(items, cat, ["space_id"]).collect()) == [2, 3]


def test_columns_belong_to_the_tables_of_their_statement(spark):
    cat = spark.createDataFrame([("cat.sch.Orders", 0, "total", "double"), ("Orders", 1, "note", "string"), ("people", 0, "Total", "string"), ("people", 1, "age", "int"), ("people", 2, "vip", "boolean")],
                                "table string, position int, column string, type string")
    bad = {
        "SELECT SUM(total) FROM orders": "", "SELECT SUM(total) FROM people": "total", "SELECT SUM(p.total) FROM orders o JOIN people AS p ON o.k = p.k": "total",
        "SELECT SUM(o.total) FROM orders o JOIN people AS p ON o.k = p.k": "", "SELECT SUM(orders.total), AVG(people.total) FROM orders, people": "total",
        "SELECT SUM(people.total) FROM sch.orders , sch.people p WHERE 1 = 1": "total", "SELECT AVG(note), STDDEV(age) FROM orders CROSS JOIN people": "note",
        "SELECT SUM(x) FROM (SELECT total AS x FROM people) s": "", "SELECT a FROM (SELECT SUM(total) AS a FROM `people`) s": "total",
        "WITH t AS (SELECT SUM(vip) AS n FROM people GROUP BY age) SELECT n FROM t": "vip", "SELECT SUM(total) FROM nowhere": "", "SELECT 1": "",
        "SELECT SUM(CASE WHEN total > 'x' THEN 1 END) FROM people -- FROM orders": "total", "SELECT AVG(COALESCE(MAX(note), note)) FROM orders WHERE note = 'FROM people'": "note",
    }
    items = spark.createDataFrame([(i, s) for i, s in enumerate(bad)] + [(99, None)], "pos int, expected_sql string")
    got = {r["expected_sql"]: ",".join(r["bad_columns"]) for r in it.typed_aggregate_violations(items, cat).collect()}
    assert got == bad | {None: ""}


def test_profiled_items_cover_all_categories(spark):
    rows = "SELECT id, CASE id % 3 WHEN 0 THEN 'it''s' WHEN 1 THEN 'b' ELSE 'c' END AS kind, id % 2 = 0 AS flag, date_add(DATE'2024-01-01', CAST(id AS INT)) AS day FROM range(100)"
    one = "SELECT id, CAST(id % 2 AS INT) AS half, TIMESTAMP'2024-01-01 10:00:00' + make_interval(0, 0, 0, CAST(id AS INT)) AS moment FROM range(100)"
    made = {"two_t": spark.sql(rows), "one_t": spark.sql(one), "same_t": spark.sql("SELECT 'x' AS only_c FROM range(3)")}
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    named = lambda fn: reduce(DataFrame.unionByName, [fn(df).withColumn("table", F.lit(t)) for t, df in made.items()])
    items = it.profiled_items(named(pf.low_card_values), named(pf.date_ranges))
    got = items.collect()
    assert len(got) == len({r["expected_sql"] for r in got})
    has = {t: {r["category"] for r in got if r["table"] == t} for t in made}
    assert has["two_t"] == has["one_t"] == set(it.CATEGORIES)
    # one value and no date: nothing to combine
    assert has["same_t"] == set(it.CATEGORIES) - {"time_series", "multi_condition", "cohort", "funnel"}
    runs = {r["expected_sql"]: [tuple(x) for x in spark.sql(r["expected_sql"]).collect()] for r in got}
    funnels = {s: v for s, v in runs.items() if s.startswith("WITH f")}
    # 50 of each; the first true day is the first, the first false one the second
    assert [v for s, v in funnels.items() if "flag = 'true' THEN" in s] == [[(100, 50, 49)]]
    assert [v for s, v in funnels.items() if "flag = 'false' THEN" in s] == [[(100, 50, 50)]]
    assert [r[1] for s, v in runs.items() if s.startswith("SELECT date_trunc") and "two_t" in s for r in sorted(v)] == [31, 29, 31, 9]
    assert [v for s, v in runs.items() if "kind = 'it''s' AND" in s and "GROUP BY" in s] == [[("it's", 17)]]
    # no more than one easy item: the batch keeps to the required mix
    batch = items.where("category NOT IN ('filter', 'distinct_count')")
    assert {r["table"]: r["passed"] for r in it.distribution_check(batch, ["table"]).collect()}["two_t"]


def test_execute_runs_the_items_of_every_table(spark, monkeypatch):
    from evalspark.plans import grounding

    asked = []
    run = grounding.va.execute_items
    monkeypatch.setattr(grounding.va, "execute_items", lambda made, key: asked.append(made) or run(made.limit(1), key))
    grounding.execute(spark, "/root/testdata/sf0.001")
    statements = [r["expected_sql"] for r in asked[0].collect()]
    assert len(statements) == len(set(statements)) == grounding.every_item(spark, "/root/testdata/sf0.001").select("expected_sql").distinct().count()
    for column in ("r_name", "c_mktsegment", "o_orderstatus", "l_shipdate", "event_type", "toxic", "role"):
        assert any(column in s for s in statements)
    for s in statements:
        spark.sql(s)


def test_no_result_of_an_item_passes_the_driver(spark, monkeypatch):
    """Only errors, here none, are made into rows by the driver."""
    made = []
    create = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: made.extend(data) or create(self, data, *a, **k))
    items = spark.range(1).selectExpr("'k' AS question_id", "'SELECT 1 AS a UNION ALL SELECT 2' AS expected_sql")
    got = [r.asDict() for r in va.execute_items(items, "question_id").collect()]
    assert made == [] and got[0]["n_result_rows"] == 2 and got[0]["expected_rows_json"] == '[["1"],["2"]]'
