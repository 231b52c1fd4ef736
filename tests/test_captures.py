"""Batched execution, the capture store, and Spark's parser as guard."""

import json

import pytest
from pyspark.sql import functions as F

from evalspark.operators import captures as cp
from evalspark.operators import profile as pf
from evalspark.operators import validate as va
from evalspark.plans import grounding
from evalspark.session import scratch_path


@pytest.fixture(scope="module", autouse=True)
def numbers(spark):
    spark.createDataFrame([(i, i % 3, f"n{i}") for i in range(200)], "a int, b int, name string").createOrReplaceTempView("cap_t")


def run(spark, statements, **options):
    df = spark.createDataFrame([(s,) for s in statements], "expected_sql string")
    got = cp.run_statements(df, **options).join(df.select(cp.statement_id("expected_sql").alias("sql_id"), "expected_sql").distinct(), "sql_id")
    return {r["expected_sql"]: r for r in got.collect()}


WRITES = [
    "WITH t AS (SELECT 1) UPDATE x AS a SET b = 1",
    "WITH t AS (SELECT 1) UPDATE `x` AS `a` SET b = 1",
    "MERGE WITH SCHEMA EVOLUTION INTO x USING y ON x.a = y.a WHEN MATCHED THEN DELETE",
    "WITH t AS (SELECT 1 AS a) INSERT INTO x SELECT * FROM t",
    "WITH t AS (SELECT 1 AS a) INSERT/**/INTO x SELECT * FROM t",
    "WITH t AS (SELECT 1) DELETE FROM x",
    "WITH t AS (SELECT 1 AS a), u AS (SELECT 2 AS a) MERGE INTO x USING u ON x.a = u.a WHEN MATCHED THEN DELETE",
    "DROP TABLE cap_t", "CREATE VIEW v AS SELECT 1", "SET spark.sql.ansi.enabled = false", "FROM cap_t INSERT OVERWRITE TABLE x SELECT a",
    "EXPLAIN SELECT 1", "CACHE TABLE cap_t", "USE default", "SHOW TABLES", "SELECT TRANSFORM(a) USING 'cat' AS (b) FROM cap_t",
    "SELECT * FROM (SELECT TRANSFORM(a) USING 'cat' AS (b) FROM cap_t) s",
]
QUERIES = [
    "SELECT 1", "WITH t AS (SELECT 1 AS a) SELECT * FROM t", "(SELECT 1) UNION ALL (SELECT 2)", "VALUES (1), (2)", "SELECT 'DROP TABLE x' AS s", "-- note\nSELECT 1", "/* INSERT INTO x */ SELECT 1",
    "SELECT a FROM cap_t JOIN cap_t u USING (a)", "SELECT update AS set FROM VALUES (1) v(update)", "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r",
    "SELECT * FROM nowhere", "SELECT (SELECT MAX(a) FROM cap_t) AS m",
]


@pytest.mark.parametrize("sql", WRITES)
def test_writes_are_refused(spark, sql):
    assert cp.query_fault(spark, sql) is not None


def test_nothing_refused_is_run(spark):
    got = run(spark, WRITES)
    assert len(got) == len(WRITES) and not any(r["sql_executes"] for r in got.values())
    assert spark.table("cap_t").count() == 200


@pytest.mark.parametrize("sql", QUERIES)
def test_queries_pass(spark, sql):
    assert cp.query_fault(spark, sql) is None


@pytest.mark.parametrize("sql", [None, "", "  ", "SELEKT 1", "SELECT 1; DROP TABLE x", "SELECT a FROM (t", "SELECT 1) UNION (SELECT 2"])
def test_no_statement_at_all(spark, sql):
    assert cp.query_fault(spark, sql) is not None


GOOD = [f"SELECT b, COUNT(*) AS n FROM cap_t WHERE a < {k} GROUP BY b" for k in range(40)]
FAILING = [f"SELECT SUM(name) FROM cap_t WHERE a = {k}" for k in range(5)]


def test_a_failing_statement_stands_alone(spark):
    got = run(spark, GOOD + FAILING + ["SELECT nope FROM cap_t"], batch=64, threads=1)
    assert len(got) == 46
    assert all(got[s]["sql_executes"] and got[s]["sql_deterministic"] for s in GOOD)
    assert [got[s]["n_result_rows"] for s in GOOD[:5]] == [0, 1, 2, 3, 3]
    assert all(not got[s]["sql_executes"] and "CAST_INVALID_INPUT" in got[s]["sql_error"] for s in FAILING)
    assert "nope" in got["SELECT nope FROM cap_t"]["sql_error"]


def test_one_job_for_a_batch(spark, monkeypatch):
    written = []
    write = cp._Store.write
    monkeypatch.setattr(cp._Store, "write", lambda self, df, part: written.append(part) or write(self, df, part))
    run(spark, GOOD, batch=64, threads=1)
    assert [p for p in written if p == "first"] == ["first"] * 2 and written.count("again") == 2  # the empty part of a new store, and one batch


def test_a_store_runs_what_it_lacks(spark, monkeypatch):
    store, ran = scratch_path(spark, "store"), []
    each = cp._run
    monkeypatch.setattr(cp, "_run", lambda kept, statements, jobs: ran.extend(s for _, s in statements) or each(kept, statements, jobs))
    first = run(spark, GOOD[:10] + FAILING[:1], store=store)
    assert sorted(set(ran)) == sorted(GOOD[:10] + FAILING[:1])
    ran.clear()
    again = run(spark, GOOD[5:15] + FAILING[:2], store=store)
    assert sorted(set(ran)) == sorted(GOOD[10:15] + FAILING[1:2])
    assert set(again) == set(GOOD[5:15] + FAILING[:2])
    assert all(first[s] == again[s] for s in GOOD[5:10] + FAILING[:1])


def test_replies_share_statements(spark):
    rows = [(1, GOOD[9]), (1, FAILING[0]), (2, GOOD[9]), (2, None), (3, FAILING[0]), (4, "DROP TABLE cap_t")]
    replies = spark.createDataFrame(rows, "reply int, expected_sql string").withColumn("sql_id", cp.statement_id("expected_sql"))
    got = va.executes_score(replies, cp.run_statements(replies, cap=0, check=False), ["reply"], "sql_id")
    assert {r["reply"]: r["sql_parses"] for r in got.collect()} == {1: 0.5, 2: 0.5, 3: 0.0, 4: 0.0}


def test_determinism_of_long_results(spark):
    got = run(spark, ["SELECT a, rand() AS r FROM cap_t", "SELECT a FROM cap_t", "SELECT uuid() AS u"])
    assert [got[s]["sql_deterministic"] for s in ("SELECT a, rand() AS r FROM cap_t", "SELECT a FROM cap_t", "SELECT uuid() AS u")] == [False, True, False]


@pytest.mark.parametrize("rows", [400, 300_000])
def test_30_and_31_values(spark, rows):
    df = spark.range(0, rows, 1, 8).select(
        "id", (F.col("id") % 30).cast("string").alias("v30"), (F.col("id") % 31).alias("v31"),
        # the 31st value is one row, in the last task
        F.when(F.col("id") == rows - 1, 30).otherwise(F.col("id") % 30).alias("late31"), F.lit(None).cast("string").alias("none"),
        F.when(F.col("id") % 2 == 0, "x").alias("half"), F.lit("y").alias("odd name"),
    )
    got = {}
    for r in pf.low_card_values(df).collect():
        got.setdefault(r["column"], []).append(r["value"])
    assert {k: len(v) for k, v in got.items()} == {"v30": 30, "half": 1, "odd name": 1}
    assert sorted(got["v30"]) == sorted(map(str, range(30)))


def test_plan_does_not_grow_with_tables(spark):
    tables = {f"t{k}": spark.range(50).select((F.col("id") % (k + 2)).alias("c"), F.current_date().alias("d")) for k in range(24)}
    plans = []
    for n in (2, 24):
        part = dict(list(tables.items())[:n])
        for df in (pf.profile_tables(part), pf.profile_ranges(part), pf.table_counts(part, spark)):
            plans.append(df._jdf.queryExecution().analyzed().treeString().count("\n"))
    assert plans[:3] == plans[3:]
    assert pf.profile_tables(tables).where("column = 'c'").groupBy("table").count().where("table = 't22'").first()["count"] == 24
    assert {r["table"]: r["row_count"] for r in pf.table_counts(tables | {"gone": None}, spark).collect()} == {t: 50 for t in tables} | {"gone": -1}


def test_lost_groups(spark):
    rows = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "c", False)], "space_id int, table string, kept boolean")
    got = {tuple(r) for r in pf.require_tables(rows, ["space_id"], fail=False).collect()}
    assert got == {(1, "a", ""), (2, None, "no readable table left")}
    with pytest.raises(Exception, match="no readable table left"):
        pf.require_tables(rows, ["space_id"]).collect()
    assert [tuple(r) for r in pf.require_tables(rows.where("space_id = 1"), ["space_id"]).collect()] == [(1, "a", "")]


ALIKE = [
    [f"SELECT COUNT(*) AS n FROM cap_t WHERE b = 2 AND a > {k}" for k in range(0, 400, 9)],
    [f"SELECT a, name FROM cap_t WHERE name = 'n{k}' -- not 'n1'\n" for k in range(190, 210)],
    [f"WITH c AS (SELECT b FROM cap_t WHERE a < {k}) SELECT b, COUNT(*) AS n FROM c GROUP BY b HAVING COUNT(*) > 1" for k in range(30)],
    [f"SELECT 'x = {k}' AS s, 1 AS one FROM cap_t GROUP BY b HAVING MAX(a) >= {k}" for k in range(190, 203)],
    [f"SELECT COUNT(CASE WHEN b = 1 THEN a END) AS n, COUNT(CASE WHEN name <> 'n{k}' THEN 1 END) AS m FROM cap_t" for k in range(9)],
    [f"SELECT a, COUNT(*) AS n FROM cap_t WHERE a <> {k} GROUP BY a ORDER BY a DESC LIMIT 4" for k in range(190, 202)],
]


@pytest.mark.parametrize("alike", ALIKE)
def test_statements_of_one_form_share_a_plan(spark, monkeypatch, alike):
    """Each statement's capture is what it gives alone."""
    got = run(spark, alike)
    monkeypatch.setattr(cp, "LEAST", len(alike) + 1)
    alone = run(spark, alike)
    assert set(got) == set(alike)
    bag = lambda r: (sorted(json.loads(r["expected_rows_json"])), r["n_result_rows"], r["sql_executes"], r["sql_deterministic"])
    assert {s: bag(r) for s, r in got.items()} == {s: bag(r) for s, r in alone.items()}
    if "ORDER" in alike[0]:
        assert [r["expected_rows_json"] for r in got.values()] == [alone[s]["expected_rows_json"] for s in got]


def test_plans_do_not_grow_with_values(spark, monkeypatch):
    """120 statements of one form are one write and one check by the parser, not batches of 120 plans."""
    written, looked = [], []
    write, fault = cp._Store.write, cp.query_fault
    monkeypatch.setattr(cp._Store, "write", lambda self, df, part: written.append(part) or write(self, df, part))
    monkeypatch.setattr(cp, "query_fault", lambda spark, sql: looked.append(sql) or fault(spark, sql))
    got = run(spark, [f"SELECT COUNT(*) AS n FROM cap_t WHERE a = {k}" for k in range(120)], cap=0, check=False)
    assert len(got) == 120 and all(r["sql_executes"] and r["n_result_rows"] == 1 for r in got.values())
    assert written.count("first") == 2 and len(looked) == 1


def test_a_form_with_failing_values(spark):
    """One value's failure is its own, in a form that is run together and in one that cannot be."""
    casts = [f"SELECT CAST(name AS INT) AS n FROM cap_t WHERE a = 5 AND b = {k}" for k in range(20)]
    sums = [f"SELECT SUM(a) / {k} AS n FROM cap_t WHERE b = {k}" for k in range(3)]
    wrong = [f"SELECT nope FROM cap_t WHERE a = {k}" for k in range(10)]
    deleted = [f"DELETE FROM cap_t WHERE a = {k}" for k in range(10)]
    got = run(spark, casts + sums + wrong + deleted, cap=0, check=False)
    assert [got[s]["sql_executes"] for s in casts] == [k != 2 for k in range(20)]
    assert [got[s]["sql_executes"] for s in sums] == [False, True, True]
    assert all("nope" in got[s]["sql_error"] for s in wrong)
    assert not any(got[s]["sql_executes"] for s in deleted) and spark.table("cap_t").count() == 200


@pytest.mark.parametrize("sql", [
    "SELECT 1", "SELECT f(x => 5)", "SELECT a FROM t WHERE b = 'it''s'", "SELECT a FROM t WHERE b = 'x' 'y'", "SELECT a FROM t WHERE b = 5.5",
    "SELECT a FROM t WHERE b = 5L", "SELECT 'b = 5'", "SELECT `b = 5` FROM t -- b = 5", "SELECT a /* = 5 */ FROM t LIMIT 5", "SELECT a FROM t WHERE b = DATE '2024-01-01'",
    r"SELECT a FROM t WHERE b = 'x\'' OR a = 5", 'SELECT "x = 5" = 5', "SELECT transform(x, y -> 5)", "SELECT a FROM t WHERE b = -5", "SELECT a FROM t WHERE b = ${x} OR a = 5",
])
def test_values_that_stay(sql):
    assert cp.form_of(sql) is None


def test_forms():
    assert cp.form_of("SELECT 'a = 1' FROM t WHERE a=1 AND b <> 'x' GROUP BY 2") == ("SELECT 'a = 1' FROM t WHERE a= asked.p0n AND b <> asked.p1s GROUP BY 2", ("1", "'x'"))


COHORT = "WITH c AS (SELECT {c} AS k, MIN({d}) AS start FROM {t} GROUP BY {c}) SELECT start, {d}, COUNT(DISTINCT k) AS n_values, COUNT(*) AS n FROM {t} JOIN c ON {c} = k GROUP BY start, {d}"


def test_cohorts_do_not_shuffle_their_table(spark, monkeypatch, tmp_path):
    """A table joined with its own groups is sent the groups; the views, the setting and the catalog are as before."""
    days = "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(id % 50)"
    for t in grounding.TABLES:
        spark.sql(f"SELECT id, CASE WHEN id % 9 > 0 THEN concat('v', id % 3) END AS `a b`, {days} AS day FROM range(5000)").coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    sql, seen = COHORT.format(t="orders", c="`a b`", d="day"), []

    def joins():
        plan = spark.sql(sql)._jdf.queryExecution().executedPlan().toString()
        return "BroadcastHashJoin" in plan, "SortMergeJoin" in plan

    def execute_items(items, key):
        seen.append((joins(), sorted(map(tuple, spark.sql(sql).collect()))))
        return items.select(key, *[F.lit(None).cast(x).alias(c) for c, x in [
            ("sql_executes", "boolean"), ("sql_error", "string"), ("n_result_rows", "bigint"), ("nonempty_result", "boolean"), ("expected_rows_json", "string"), ("sql_deterministic", "boolean")]])

    monkeypatch.setattr(grounding.va, "execute_items", execute_items)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
        assert grounding.execute(spark, str(tmp_path)).count() > 0
        assert joins() == (False, True)  # what Spark does without statistics
        plain = sorted(map(tuple, spark.sql(sql).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        left = [x.name for x in spark.catalog.listTables() if not x.isTemporary]
        for t in grounding.TABLES:
            spark.catalog.dropTempView(t)
    assert seen == [((True, False), plain)] and len(plain) > 1
    assert not left and spark.conf.get("spark.sql.cbo.enabled") == "false"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, rows that come twice, no number at some keys."""
    rows = [(k % 40 if k % 7 else None, float("nan") if k == 11 else k / 2 if k % 5 else None, f"n{k % 6}" if k % 4 else str(k), None) for k in range(300)]
    spark.createDataFrame(rows * 2, "k int, x double, name string, empty string").createOrReplaceTempView("cap_odd")


IN_ONE_PASS = [
    [f"SELECT SUM(name) AS s, COUNT(*) AS n FROM cap_odd WHERE k = {k}" for k in range(14)],
    [f"SELECT AVG(CASE WHEN x > 3 THEN name END) FROM cap_odd WHERE 'n1' <> name AND k = {k}" for k in range(2, 14)],
    [f"SELECT MIN(CAST(name AS INT)), MAX(x), SUM(k), COUNT(x) FROM cap_odd WHERE x <= {v}" for v in (0, 2, 1, 8, 9, 40, 140, 141, 150, 151)],
    [f"SELECT 10 / (COUNT(*) - 2) AS share FROM cap_odd WHERE x > {v}" for v in range(142, 151)],
    [f"WITH t AS (SELECT k AS kk FROM cap_odd WHERE x < {v}) SELECT COUNT(*), COUNT(kk), MAX(kk) FROM t" for v in range(12)],
    [f"SELECT name, x, k FROM cap_odd WHERE k >= {v} ORDER BY x DESC NULLS LAST, name LIMIT 3" for v in range(32, 42)],
    [f"SELECT * FROM cap_odd WHERE k < {v} ORDER BY x NULLS FIRST, k, name" for v in range(12)],
    [f"SELECT k + 1 AS k1, name FROM cap_odd WHERE name = 'n{v}' ORDER BY k, x" for v in range(9)],
    [f"SELECT SUM(x), MAX(empty) FROM cap_odd WHERE k = {v} AND name = 'n{v % 7}'" for v in range(4, 16)],
]


@pytest.mark.parametrize("alike", IN_ONE_PASS)
def test_statements_in_one_pass(spark, odd, alike):
    """Every statement's outcome is what it is alone, failures too."""
    for sql, rows, bad in cp.forms.together(spark, *cp._asked([(s, s, 1) for s in alike])).collect():
        try:
            alone = [[None if c is None else c for c in r] for r in spark.sql(sql).limit(1).select([F.col(c).cast("string") for c in spark.sql(sql).columns]).collect()]
        except Exception:
            alone = None
        assert (None if bad else rows) == alone, sql


def test_failures_are_told_in_one_pass(spark, odd, monkeypatch):
    """No join of values with rows is made, and one failing statement is run alone."""
    joined, written = [], []
    together, write = cp._Job.together, cp._Store.write
    monkeypatch.setattr(cp._Job, "together", lambda self, *x: joined.append(x) or together(self, *x))
    monkeypatch.setattr(cp._Store, "write", lambda self, df, part: written.append(part) or write(self, df, part))
    got = run(spark, [f"SELECT SUM(name) AS s FROM cap_odd WHERE k = {k}" for k in range(40)], cap=0, check=False)
    # a new store's empty part, the failure and the form
    assert len(got) == 40 and not joined and written.count("first") == 3
    assert {r["sql_executes"] for r in got.values()} == {True, False}
    assert all(r["sql_executes"] or "CAST_INVALID_INPUT" in r["sql_error"] for r in got.values())


OTHERWISE = [
    [f"SELECT COUNT(*) AS n FROM cap_odd WHERE k = {k} AND k > 3 AND k + 1 < 900000000" for k in range(9)],
    [f"SELECT name, COUNT(*) AS n FROM cap_odd WHERE k > {k} GROUP BY name HAVING COUNT(*) > 90" for k in range(9)],
    [f"SELECT AVG(x) AS m FROM cap_odd WHERE k > {k} AND x < 9" for k in range(9)],
    [f"SELECT COUNT(*) AS n FROM cap_odd WHERE k = {k} OR x < 3" for k in range(9)],
    [f"SELECT COUNT(*) AS n FROM cap_odd WHERE NOT (k > {k})" for k in range(9)],
    [f"SELECT COUNT(DISTINCT name) AS n FROM cap_odd WHERE k = {k}" for k in range(9)],
    [f"SELECT MAX(k) AS m FROM cap_odd WHERE k < (SELECT MAX(a) FROM cap_t WHERE a < {k})" for k in range(9)],
]


@pytest.mark.parametrize("alike", OTHERWISE)
def test_forms_that_are_not_one_pass(spark, odd, alike):
    assert cp.forms.together(spark, *cp._asked([(s, s, 1) for s in alike])) is None


def test_an_equal_value_decides_nothing_else(spark, odd):
    got = run(spark, OTHERWISE[0], cap=0, check=False)
    assert [json.loads(got[s]["expected_rows_json"])[0][0] == "0" for s in OTHERWISE[0]] == [k <= 3 for k in range(9)]
