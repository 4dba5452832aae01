"""Vectors of every length are linked, each length by itself."""

from __future__ import annotations

import numpy as np

from ledgerloom.llm import embedding_dedup
from ledgerloom.session import Scratch


def test_each_length_is_indexed(spark):
    rng, rows = np.random.default_rng(3), []
    for d, n in ((8, 60), (5, 40), (3, 1)):
        for _ in range(n):
            x = rng.normal(size=d)
            rows += [(len(rows) + k, (x + k * 0.01 * rng.normal(size=d)).tolist()) for k in range(2 if n > 1 else 1)]
    rows += [(1000, [1.0, 0.0]), (1001, [1.0, 0.0]), (1002, None), (1003, [0.0, 0.0])]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and any(v)}
    near = lambda i, j: i != j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95
    want = {i: sum(near(i, j) for j in unit) if i in unit else 0 for i, _ in rows}
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Scratch(spark, "t")).collect()}
    assert {i: r.n_links for i, r in got.items()} == want
    assert sum(want[i] > 0 for i, v in rows if v and len(v) == 5) >= 80
    assert not got[1001].kept and got[1001].component_id == 1000
