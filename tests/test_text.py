import pytest
from pyspark.sql import functions as F

from evalspark.functions import text as tx


def run(spark, fn, cases):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    got = {r["i"]: r["k"] for r in df.select("i", fn("c").alias("k")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_norm_question(spark):
    run(spark, tx.norm_question, [
        ("  Show ME the top 5? ", "show me the top 5"), ("Revenue by region.", "revenue by region"), ("a   b\tc", "a b c"),
        ("a  b ?! .", "a b"), (None, ""), ("?", ""), ("Größe ÉTÉ!", "größe été"),
    ])


def test_structural_difficulty(spark):
    run(spark, tx.structural_difficulty, [
        ("SELECT count(*) FROM t WHERE a = 'x'", "easy"), ("SELECT a, sum(b) FROM t GROUP BY a", "medium"),
        ("SELECT * FROM a JOIN b ON a.id = b.id", "medium"), ("WITH c AS (SELECT 1) SELECT * FROM c", "hard"),
        ("SELECT RANK() OVER (ORDER BY x) FROM t", "hard"), ("SELECT a FROM t HAVING count(*) > 1", "hard"),
        ("WITH\nc AS (SELECT 1) SELECT 1", "easy"), ("select percent_rank() over(order by x) from t", "hard"),
        ("SELECT a FROM t ORDER BY a", "easy"), ("SELECT a FROM t ORDER BY a LIMIT 3", "medium"), (None, "easy"),
    ])


def test_readonly(spark):
    run(spark, tx.is_readonly, [
        ("SELECT 1", True), ("  with x as (select 1) select 1", True), ("/* note */ SELECT 1", True), ("-- a\n-- b\nselect 1", True),
        ("-- a\n/* b\nc */\n  SELECT 1", True), ("DELETE FROM orders", False), ("/* SELECT */ DROP TABLE t", False), (None, False), ("", False),
        ("-- select 1", False),
    ])


def test_extract_sql(spark):
    run(spark, tx.extract_sql, [
        ("```sql\nSELECT 1;\n```", "SELECT 1"), ("Sure!\nselect a\nfrom t\n\nThis counts.", "select a\nfrom t"),
        ("SELECT 1; SELECT 2", "SELECT 1"), ("WITH a AS (SELECT 1)\n\nSELECT * FROM a", "WITH a AS (SELECT 1)\n\nSELECT * FROM a"), ("WITH a AS (SELECT 1)\n \nSelect * FROM a", "WITH a AS (SELECT 1)"), ("no query", "no query"), (None, ""),
        ("SELECT 1\n\nselect", "SELECT 1\n\nselect"),
    ])


def test_relative_time(spark):
    cases = [("Sales this month", "SELECT 1", True), ("in the last 30 days", "SELECT 1", True), ("next 2 weeks", "x", True), ("This Quarter?", "x", True),
             ("last day", "x", False), ("in March 2024", "SELECT CURRENT_DATE", True), ("q", "select NOW ()", True), ("q", "select getdate()", True),
             ("q", "select known(1)", False), (None, None, False), ("thisyear", "x", False)]
    df = spark.createDataFrame([(i, q, s) for i, (q, s, _) in enumerate(cases)], "i int, q string, s string")
    got = {r["i"]: r["k"] for r in df.select("i", tx.has_relative_time("q", "s").alias("k")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for *_, w in cases]


def test_skeleton(spark):
    pairs = [
        ("SELECT region, SUM(sales) FROM t WHERE year = 2023 AND region = 'East' GROUP BY region",
         "select region,  sum(sales) from t where year=2024 and region = 'We''st' group by region;", True),
        ("SELECT region, SUM(profit) FROM t", "SELECT region, SUM(sales) FROM t", False),
        ("SELECT a1 FROM t2", "SELECT a2 FROM t2", False),
        ("SELECT 1.5e3, .5", "SELECT 2, 7.", True),
        ("SELECT 'a'", "SELECT 1", False),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: r["k"] for r in df.select("i", (tx.sql_skeleton("a") == tx.sql_skeleton("b")).alias("k")).collect()}
    assert [got[i] for i in range(len(pairs))] == [w for *_, w in pairs]


def test_aggregate_identifiers(spark):
    fn = lambda c: F.array_join(F.array_sort(tx.numeric_aggregate_identifiers(c)), ",")
    run(spark, fn, [
        ("SELECT SUM(c_name), MAX(x) FROM t", "c_name"), ("SELECT avg( coalesce(a, (b + (c))) ) FROM t", "a,b,c,coalesce"),
        ("SELECT count(a) FROM t WHERE b = 'SUM(z)'", ""), ("SELECT SUM(CASE WHEN s = 'x' THEN v END)", "case,end,s,then,v,when"),
    ])


def test_invented_literals(spark):
    df = spark.createDataFrame(
        [(0, "SELECT 1 WHERE a = 'x' AND b = 'y' AND c = '2024-01-01' AND d = '12.5'", "- a: ['x']\n- b: [\"z\"]"), (1, "w = 'q'", "")], "i int, s string, p string")
    got = [r["k"] for r in df.orderBy("i").select(tx.invented_literals("s", tx.sample_literals("p")).alias("k")).collect()]
    assert got == [["y"], ["q"]]


def test_long_texts_and_deep_nesting(spark):
    long = "x" * 100_000
    rows = [
        (f"SELECT '{long}', SUM(a) FROM t", None, ["a"]),
        ("SELECT SUM(" + "a + " * 25_000 + "b) FROM t", None, ["a", "b"]),
        ("SELECT SUM(" + "f(" * 50 + "c_name" + ")" * 51, None, ["f", "c_name"]),
        ("SELECT '" + "''" * 50_000 + "' FROM t", None, []),
        ("SELECT AVG(a + SUM(b)), c, STDDEV (d) FROM t", None, ["a", "sum", "b", "d"]),
        ("SELECT SUM(open FROM t", None, []),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, s string")
    got = {r["i"]: r for r in df.select("i", tx.mask_literals("s").alias("m"), tx.numeric_aggregate_identifiers("s").alias("x"), F.length(tx.sql_skeleton("s")).alias("n")).collect()}
    assert got[0]["m"] == "SELECT '?', SUM(a) FROM t" and got[3]["m"] == "SELECT '?' FROM t"
    assert [got[i]["x"] for i in range(len(rows))] == [r[2] for r in rows]


def test_writes_in_disguise_are_refused(spark):
    rows = [
        ("WITH t AS (SELECT 1 AS a) INSERT INTO x SELECT * FROM t", False),
        ("WITH t AS (SELECT 1 AS a) /* c */ MERGE INTO x USING t ON a = b WHEN MATCHED THEN DELETE", False),
        ("SELECT 'INSERT INTO x' AS s FROM t -- DROP TABLE t", True),
        ("SELECT last_update, `delete from` FROM t", True),
        ("/*" + "*" * 50_000 + "*/ SELECT 1", True),
        ("CREATE TABLE x AS SELECT 1", False),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, s string")
    assert [r["ok"] for r in df.select("i", tx.is_readonly("s").alias("ok")).orderBy("i").collect()] == [r[1] for r in rows]
