import numpy as np
import pytest
from pyspark.sql import functions as F

import evalspark.operators.near as near
from evalspark.functions.stats import exact_quantile
from evalspark.operators.diversity import greedy_dedup, leakage, nearest_reference, nn_summary, self_similarity, unit


def make(spark, arr, by=None, start=0):
    rows = [(start + i, [float(x) for x in v]) if by is None else (int(by[i]), start + i, [float(x) for x in v]) for i, v in enumerate(arr)]
    ddl = "id bigint, embedding array<float>" if by is None else "space int, id bigint, embedding array<float>"
    return spark.createDataFrame(rows, ddl)


def norm(a):
    a = np.asarray(a, dtype=np.float32)
    return a / (np.linalg.norm(a, axis=1, keepdims=True) + 1e-9)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(near, "BLOCK_FLOATS", 24 * 12)
    monkeypatch.setattr(near, "PRODUCT_CELLS", 14)
    monkeypatch.setattr(near, "FANOUT", 4)


def clustered(rng, n, hot=True):
    centres = rng.normal(size=(5, 12))
    a = centres[rng.integers(0, 5, n)] + 0.15 * rng.normal(size=(n, 12))
    if hot:
        a[: n // 3] = a[0]  # a third are exact copies
        a[n // 3 : n // 2] = a[0] + 0.02 * rng.normal(size=(n // 2 - n // 3, 12))  # near copies
        a = a[rng.permutation(n)]
    a[3] = 0
    return a


def test_nearest_by_space(spark):
    rng = np.random.default_rng(1)
    g, h = clustered(rng, 60), clustered(rng, 90)
    gb, hb = rng.integers(0, 3, 60), rng.integers(0, 3, 90)
    got = {
        r["id"]: (r["nn_sim"], r["nn_id"])
        for r in nearest_reference(unit(make(spark, g, gb), by=["space"]), unit(make(spark, h, hb), by=["space"]), ["space"]).collect()
    }
    G, H = norm(g).astype(float), norm(h).astype(float)
    for i in range(60):
        sims = np.where(hb == gb[i], H @ G[i], -9)
        assert abs(got[i][0] - sims.max()) < 1e-6
        assert sims[got[i][1]] > sims.max() - 1e-6


def test_self_similarity(spark):
    rng = np.random.default_rng(2)
    a = clustered(rng, 50)
    A = norm(a).astype(float)
    want = (A @ A.T - np.eye(50)).max(axis=1).mean()
    assert abs(self_similarity(unit(make(spark, a))).first()["self_similarity"] - want) < 1e-5
    assert self_similarity(unit(make(spark, a[:1]))).first()["self_similarity"] == 0.0
    pair = np.array([[1.0, 0], [-1.0, 0]])
    assert abs(self_similarity(unit(make(spark, pair))).first()["self_similarity"]) < 1e-6


def test_rows_without_a_vector_are_no_neighbours(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, None]), (4, [1.0, 0.1])], "id long, embedding array<float>")
    got = nearest_reference(unit(df), unit(df.where("id > 1"))).collect()
    assert {(r["id"], r["nn_id"]) for r in got} == {(1, 4), (4, 4)}
    assert sorted(r["id"] for r in near.greedy_keep(unit(df), [], 0.92).collect()) == [1]


@pytest.mark.parametrize("first", [30, None])
def test_greedy_dedup(spark, first):
    rng = np.random.default_rng(3)
    a = clustered(rng, 90)
    A = norm(a)
    kept = []
    for i in range(len(A)):
        if not kept or (A[kept] @ A[i]).max() < 0.92:
            kept.append(i)
    keep = near.greedy_keep(unit(make(spark, a)), [], 0.92, first=first)
    assert sorted(r["id"] for r in keep.collect()) == kept
    df = greedy_dedup(make(spark, a), [], "id", "embedding", 0.92)
    assert df.count() == len(kept)


def test_leakage_share(spark):
    nn = spark.createDataFrame([(i, s) for i, s in enumerate([0.98, 0.97, 0.9699, 0.6])], "id int, nn_sim double")
    r = leakage(nn).first()
    assert (r["leakage_fraction"], r["leakage_risk"]) == (0.5, True)
    few = spark.createDataFrame([(i, 0.99 if i == 0 else 0.5) for i in range(20)], "id int, nn_sim double")
    assert leakage(few).first()["leakage_risk"] is False


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_exact_quantile(spark, q):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=3000), np.zeros(2000)])
    k = rng.integers(0, 3, 5000)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(k, x)], "k int, x double").unionAll(
        spark.createDataFrame([(0, None)], "k int, x double")
    )
    for r in exact_quantile(df, "x", q, ["k"], "p", accuracy=100).collect():
        assert r["p"] == pytest.approx(np.quantile(x[k == r["k"]], q), abs=1e-12)
    assert exact_quantile(df, "x", q).first()["quantile"] == pytest.approx(np.quantile(x, q), abs=1e-12)


def test_nn_summary(spark):
    nn = spark.createDataFrame([(i, i / 10) for i in range(7)], "id int, nn_sim double")
    r = nn_summary(nn).first()
    assert r["nn_cosine_p10"] == pytest.approx(np.percentile(np.arange(7) / 10, 10))


def test_tree_of_every_group(spark):
    rng = np.random.default_rng(8)
    a = clustered(rng, 400)
    rows = unit(make(spark, a, np.arange(400) % 2), by=["space"])
    tree = near.build_tree(rows, ["space"])
    assert len(tree.levels) > 1
    assert sorted(r["id"] for r in tree.placed.collect()) == list(range(400))
    # equal vectors share a leaf; of other leaves none holds more than a block
    sizes = tree.placed.groupBy("space", "node").agg(F.count("*").alias("n"), F.count_distinct("v").alias("kinds")).collect()
    assert all(r["n"] <= 24 or r["kinds"] == 1 for r in sizes)
    assert near.build_tree(rows.where("false"), ["space"]) is None


@pytest.mark.parametrize("threshold", [0.97, 0.1])
def test_near_pairs_at_all_thresholds(spark, threshold):
    rng = np.random.default_rng(9)
    a = clustered(rng, 80)
    A = norm(a).astype(float)
    rows = unit(make(spark, a))
    got = {r["id"] for r in near.earlier_neighbours(rows, rows.withColumn("kept", F.lit(True)), [], threshold).collect()}
    sims = A @ A.T
    edge = {i for i in range(80) if any(abs(sims[i, j] - threshold) < 1e-5 for j in range(i))}
    assert got - edge == {i for i in range(80) if any(sims[i, j] >= threshold for j in range(i))} - edge


def test_search_cost_skips_and_bounds_copies(spark):
    rng = np.random.default_rng(10)
    a = rng.normal(size=(6, 12))[np.arange(300) % 6] + 0.05 * rng.normal(size=(300, 12))
    rows = unit(make(spark, a))
    cost = near.search_cost(rows, rows, [], 0.92).first()
    assert cost["pairs"] == 300 * 300 and cost["n_leaves"] > 6
    assert 0.5 < cost["share_skipped"] < 1
    # six families of 50: a source meets the shards (of 24 rows) of its own family, not of all 300 targets
    assert cost["copies_max"] <= 5
    assert near.search_cost(rows, rows.where("false")).first()["pairs"] == 0.0
