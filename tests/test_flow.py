from pyspark.sql import functions as F

from evalspark import flow
from evalspark.functions.cells import parse_rows


def test_items_to_grades(spark):
    spark.createDataFrame([(i, ["x", "y"][i % 2], float(i)) for i in range(20)], "k int, s string, v double").createOrReplaceTempView("flow_t")
    raw = spark.createDataFrame(
        [
            (0, "How many x?", "SELECT COUNT(*) AS n FROM flow_t WHERE s = 'x'", "easy"),
            (1, "How many y?", "SELECT COUNT(*) AS n FROM flow_t WHERE s = 'y'", "easy"),  # same skeleton
            (2, "Sum of names?", "SELECT SUM(s) FROM flow_t", "easy"),
            (3, "Sales this month?", "SELECT 1", "easy"),
            (4, "Sum per s?", "SELECT s, SUM(v) AS t FROM flow_t GROUP BY s", "medium"),
            (5, "Drop it?", "DROP TABLE flow_t", "easy"),
            (6, "  ", "SELECT 1", "easy"),
        ],
        "pos int, question string, expected_sql string, difficulty string",
    ).withColumn("space_id", F.lit(1))
    catalog = spark.createDataFrame([("flow_t", 0, "k", "int"), ("flow_t", 1, "s", "string"), ("flow_t", 2, "v", "double")], "table string, position int, column string, type string")
    items = flow.validate_items(flow.build_items(raw, catalog, ["space_id"]))
    got = {r["pos"]: r for r in items.collect()}
    assert {p: r["sql_executes"] for p, r in got.items()} == {0: True, 4: True, 5: False}
    assert got[4]["difficulty_structural"] == "medium" and got[4]["difficulty_label_matches"]

    votes = items.select("question_id", F.explode(F.array(F.lit("gen"), F.lit("judge"))).alias("family")).withColumn("verdict", F.lit(True))
    gated = flow.verify_items(items, votes)
    assert {r["pos"]: r["verify_tier"] for r in gated.collect()} == {0: "gold", 4: "gold", 5: "not_evaluable"}

    answers = gated.select(
        "question_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("run_idx"),
        parse_rows(F.when(F.col("pos") == 0, "[[11]]").otherwise('[[90.0, "x"], [100.0, "y"]]')).alias("answer_rows"), F.lit("").alias("answer_error"))
    graded = {r["pos"]: (r["result_match"], r["match_indeterminate"]) for r in flow.grade_items(gated, answers).collect()}
    assert graded == {0: (False, False), 4: (True, False)}
