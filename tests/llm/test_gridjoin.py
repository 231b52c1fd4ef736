"""Vector links and components against all pairs."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_llm import bag

from evalspark.llm import gridjoin, queries

COLUMNS = ("vec_id", "n_links", "component_id", "kept")


def joined(rows, threshold=0.93):
    """Rows wanted of (vec_id, embedding, label)."""
    fine = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and g is not None for _, v, g in rows]
    n, parent, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    kinds = {}
    for k, (_, v, g) in enumerate(rows):
        if fine[k]:
            kinds.setdefault((g, len(v)), []).append(k)
    for members in kinds.values():
        x = np.array([rows[k][1] for k in members], np.float64)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        for i, j in zip(*np.nonzero(near)):
            links[members[i]] += 1
            a, b = find(members[i]), find(members[j])
            parent[max(a, b)] = min(a, b)
    least = {}
    for k in range(n):
        i = rows[k][0]
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(rows[k][0], links[k], least.get(find(k)), rows[k][0] == least.get(find(k))) for k in range(n)]


def made(path, rows):
    table = {"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())}
    extra = {c: pa.array([1] * len(rows), pa.int64()) for c in ("g", "i", "at", "rank", "k1", "u", "len", "n_links")}
    pq.write_table(pa.table(table | extra), f"{path}/embeddings.parquet", row_group_size=100)
    return str(path)


def vectors(seed, n, dims, families=0, noise=0.1, labels=3):
    """Random vectors, and families of near copies in them."""
    rnd = np.random.default_rng(seed)
    out = rnd.normal(size=(n, dims))
    for k in range(families):
        some = rnd.integers(0, n, max(2, n // 9))
        out[some] = rnd.normal(size=dims) + noise * rnd.normal(size=(len(some), dims))
    return [(int(i), [float(x) for x in v.astype(np.float32)], int(rnd.integers(0, labels))) for i, v in enumerate(out)]


A = [0.5, -1.0, 2.0, 0.25]
ODD = [
    (1, A, 1), (2, A, 1), (2, A, 1), (3, [2 * x for x in A], 1), (4, A, None), (5, None, 1), (6, [0.0] * 4, 1), (7, [None, 1.0, 1.0, 1.0], 1), (8, [float("nan"), 1.0, 1.0, 1.0], 1),
    (9, [float("inf"), 1.0, 1.0, 1.0], 1), (10, [], 1), (11, A + [0.0], 1), (12, A[:2], 1), (None, A, 1), (None, [1.0, 1.0, -1.0, 1.0], 1), (14, A, 2), (-3, [1e30 * x for x in A], 1),
    (16, [1e-40 * x for x in A], 1), (17, [-0.0, 1.0, 0.0, 0.0], 3), (18, [0.0, 1.0, 0.0, 0.0], 3), (None, None, None), (20, [-x for x in A], 1), (21, A[:1], 1), (22, [-0.5], 1),
]
CASES = {
    "odd": ODD,
    "one": ODD[:1],
    "bad": ODD[4:10],
    "plane": vectors(1, 900, 3, labels=1),
    "random": vectors(2, 700, 16, 4),
    "families": vectors(3, 1500, 64, 3, 0.12, 2),
    "tight": vectors(4, 2600, 8, 2, 0.02, 1),
    "copies": [(i, A, 1) for i in range(1500)] + vectors(5, 300, 4, labels=2),
}


@pytest.mark.parametrize("case", list(CASES))
def test_links(spark, tmp_path, monkeypatch, case):
    monkeypatch.setattr(gridjoin, "_BLOCK", "rank div 40")  # many blocks, several levels
    rows = CASES[case]
    got = queries.QUERIES["op12_embedding_near_dedup"](spark, made(tmp_path, rows)).collect()
    assert bag(tuple(r[c] for c in COLUMNS) for r in got) == bag(joined(rows))


def test_blocks_of_all_sizes(spark, tmp_path):
    rows = CASES["families"] + [(i + 10**6, v, 7) for i, v, _ in vectors(6, 60, 3000)]
    got = queries.QUERIES["op12_embedding_near_dedup"](spark, made(tmp_path, rows)).collect()
    assert bag(tuple(r[c] for c in COLUMNS) for r in got) == bag(joined(rows))


def test_empty_and_shuffled(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert queries.QUERIES["op12_embedding_near_dedup"](spark, made(tmp_path / "none", [])).collect() == []
    rows = CASES["random"]
    got = gridjoin.near_vectors(spark.read.parquet(f"{made(tmp_path, rows)}/embeddings.parquet").repartition(11)).collect()
    assert bag(tuple(r[c] for c in COLUMNS) for r in got) == bag(joined(rows))


@pytest.mark.parametrize("seed", range(4))
def test_bounds_settle_nothing_wrongly(seed):
    rnd = np.random.default_rng(seed)
    a, b = (gridjoin._units(rnd.normal(size=(150, 6)) * 0.3 + rnd.normal(size=6)) for _ in range(2))
    wa, wb = rnd.integers(1, 5, 150), rnd.integers(1, 5, 150)
    near = a @ b.T >= 0.93
    got = gridjoin._join(a, b, a, b, wa, wb, 0.93, False)
    assert (got[0] == near @ wb).all() and (got[1] == wa @ near).all()
    own = a @ a.T >= 0.93
    got = gridjoin._join(a, a, a, a, wa, wa, 0.93, True)
    assert (got[0] + got[1] == own @ wa).all()
