from evalspark.operators import match as m
from evalspark.sources import spaces as sp


def test_ids_that_look_alike_stay_apart(spark, tmp_path):
    path = str(tmp_path / "items")
    ids = ["007", "7", "12e5", "a/b c", "x=y"]
    sp.replace_space(spark.createDataFrame([(i, s) for i, s in enumerate(ids)], "question_id int, space_id string"), path)
    for i, s in enumerate(ids):
        assert [(r["question_id"], r["space_id"]) for r in sp.read_space(spark, path, s).collect()] == [(i, s)]


def test_replacing_with_nothing_empties_the_named_space_only(spark, tmp_path):
    path = str(tmp_path / "items")
    rows = spark.createDataFrame([(1, "007"), (2, "7"), (3, "a/b c")], "question_id int, space_id string")
    sp.replace_space(rows, path)
    sp.replace_space(rows.where("question_id = 2"), path, ("7", "007", "a/b c"))
    assert [tuple(r) for r in sp.read_items(spark, path).collect()] == [(2, "7")]


def test_a_varying_statement_is_seen(spark):
    # which value comes first differs from run to run
    spark.range(0, 4000, 1, 8).selectExpr("id", "id % 3 AS k").createOrReplaceTempView("vary")
    twice = [spark.sql("SELECT k, first(u) AS u FROM (SELECT k, uuid() AS u FROM vary) GROUP BY k") for _ in range(2)]
    assert not m.deterministic(*twice).first()["sql_deterministic"]
    same = [spark.sql("SELECT k, count(*) AS n, CAST(NULL AS STRING) AS x FROM vary GROUP BY k") for _ in range(2)]
    assert tuple(m.deterministic(*same).first()) == (True, 3, 3)
    other = spark.sql("SELECT k, count(*) AS n, '' AS x FROM vary GROUP BY k")
    assert not m.deterministic(same[0], other).first()["sql_deterministic"]
