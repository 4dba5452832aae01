"""The pivot-permutation index: order, shared pivots, split lists, recall, awkward rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import embedding_dedup as ed
from ledgerloom.session import Scratch


def planted(n: int, d: int, seed: int) -> np.ndarray:
    """Clusters whose members are 0.90 to 1.0 similar to their centres, among unrelated vectors."""
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=(n // 2, d))]
    while sum(map(len, out)) < n:
        centre = rng.normal(size=d)
        size = int(rng.integers(2, 30))
        noise = rng.normal(size=(size, d))
        out.append(centre + noise * rng.uniform(0.02, 0.3, size=(size, 1)))
    return np.concatenate(out)[:n]


def truth(x: np.ndarray) -> np.ndarray:
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= ed.THRESHOLD
    np.fill_diagonal(near, False)
    return near


def run(spark, x, extra=()):
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + list(extra)
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    return {r["vec_id"]: r for r in ed.near_duplicates(docs, Scratch(spark, "t")).collect()}


def test_order_is_part_of_a_description():
    points = np.eye(3)
    one, two = ed.nearest(np.array([[1.0, 0.9, 0.1], [0.9, 1.0, 0.1]]), points).tolist()
    assert sorted(one) == sorted(two) and one != two == [1, 0, 2]
    # the lists follow the order: other first pivots, other lists
    near = np.array([[5, 9, 2, 7, 1, 4], [9, 5, 2, 7, 1, 4], [4, 1, 7, 2, 9, 5]])
    keys = ed.keys_of(near, np.zeros(3, np.int64))
    sets = [set(k[k >= 0].tolist()) for k in keys]
    assert len(sets[0] & sets[1]) == 3 and sets[0] != sets[1] and not sets[0] & sets[2]


@pytest.mark.parametrize("long", [2048, 20])
def test_recall_and_precision_on_planted_vectors(spark, monkeypatch, long):
    monkeypatch.setattr(ed, "LONG", long)
    monkeypatch.setattr(ed, "TILE", 16)
    x = planted(1500, 24, 3)
    x[700:720] = x[699]
    near = truth(x)
    got = run(spark, x)
    found, want = sum(got[k]["n_links"] for k in range(len(x))), int(near.sum())
    assert all(got[k]["n_links"] <= near[k].sum() for k in range(len(x)))
    assert want > 3000 and found >= 0.98 * want


def test_sql_and_numpy_agree_on_keys(spark):
    rng = np.random.default_rng(1)
    near = np.array([rng.permutation(50)[:8] for _ in range(40)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(near)], "k long, near array<int>")
    rows = df.select("k", F.expr(f"inline({ed._lists('near')})")).collect()
    for longs in (0, 0b1010):
        keys = ed.keys_of(near, np.full(40, longs))
        for k in range(40):
            mine = {r["list"] + c + 1 for r in rows if r["k"] == k and longs >> r["place"] & 1 for c in r["next"]} | {r["list"] for r in rows if r["k"] == k and not longs >> r["place"] & 1}
            assert mine == set(keys[k][keys[k] >= 0].tolist())


def test_awkward_vectors(spark):
    big = np.full(8, 1e300)
    extra = [(100, None), (101, []), (102, [float("nan")] * 8), (103, [0.0] * 8), (104, (big * 2).tolist()), (105, big.tolist()), (None, big.tolist()), (106, [1.0]), (107, [2.0]), (108, [3.0, 1.0]), (104, (big * 2).tolist())]
    got = run(spark, np.random.default_rng(2).normal(size=(40, 8)), extra)
    assert got[105]["component_id"] == got[104]["component_id"] == 104 and got[104]["kept"] and not got[105]["kept"]
    assert got[106]["n_links"] == 1 and got[107]["component_id"] == 106 and got[108]["n_links"] == 0
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (100, 101, 102, 103))


def test_split_lists_lose_no_candidate(spark):
    rng = np.random.default_rng(5)
    # nearest first, these agree in the pair and in three pivots that come last
    some = [[0, 1, 2, 3, 4, 5, 6, 7], [0, 1, 8, 9, 10, 5, 6, 7]]
    some += [[0, 1, *(rng.permutation(9)[:6] + 2)] for _ in range(200)]
    near = np.array(some)
    posts = [set(k[k >= 0].tolist()) for k in ed.keys_of(near, np.ones(len(near), np.int64))]
    assert all(a & b for k, a in enumerate(posts) for j, b in enumerate(posts) if len(set(some[k]) & set(some[j])) >= ed.SHARED)
    # a split entry's places are those that its keys say
    rows = spark.createDataFrame([(some[0],)], "near array<int>").selectExpr(f"inline({ed._lists('near')})").collect()
    told = {r["list"] + c + 1 for r in rows for c in r["next"]}
    assert told == {k for k in ed.keys_of(near[:1], np.array([15]))[0].tolist() if k >= 0}


def test_a_long_list_of_the_only_pivot_stays_whole(spark, monkeypatch):
    monkeypatch.setattr(ed, "LONG", 4)
    rng = np.random.default_rng(6)
    x = np.concatenate([np.ones((12, 1)), rng.normal(size=(12, 7)) * 0.01], axis=1)
    assert {r["n_links"] for r in run(spark, x).values()} == {11}
