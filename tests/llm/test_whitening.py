"""Whitening against plain linear algebra on whole numbers."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import whitening
from ledgerloom.session import Scratch


def plain(vectors):
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    d = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in x]
    centred = np.array(d, dtype=float) / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:8]
    return n, [sum(c * c for c in v) for v in d], centred @ parts[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def check(rows, vectors, ids):
    n, deviations, whitened, explained = plain(vectors)
    by = defaultdict(dict)
    for r in rows:
        by[r["vec_id"]][r["component"]] = r
    k = len(explained)
    assert len(rows) == len(ids) * k
    got = np.array([[by[i][c + 1]["whitened"] for c in range(k)] for i in ids])
    signs = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got - whitened * signs).max() < 1e-8
    for i, deviation in zip(ids, deviations, strict=True):
        for c in range(k):
            r = by[i][c + 1]
            assert (r["n"], int(r["deviation"])) == (n, deviation) and math.isclose(r["explained"], explained[c], rel_tol=1e-9)
            assert r["identity_error"] < 1e-9
    measured = np.abs(np.cov(got.T, bias=True) - np.eye(k)).max()
    assert measured < 1e-9


def test_equals_plain_algebra(spark):
    rng = np.random.default_rng(1)
    good = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) / 7).round(4)
    rows = [(k, [float(c) for c in v], "x", 1, 2.0) for k, v in enumerate(good)]
    bad = [None, [None] + [0.1] * 11, [float("nan")] + [0.1] * 11, [0.1] * 11 + [float("-inf")], [1e300] * 12, [], [0.5] * 5]
    rows += [(1000 + k, v, "x", 1, 2.0) for k, v in enumerate(bad)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, component int, w double").repartition(3)
    got = whitening.whitened(table.select("vec_id", "embedding"), Scratch(spark, "t")).collect()
    check(got, good.tolist(), range(300))
    assert sorted(map(str, whitening.whitened(table, Scratch(spark, "t")).collect())) == sorted(map(str, got))


def test_input_table(spark, data):
    got = whitening.query(spark, data).collect()
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    check(got, [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


def test_few_rows_equal_rows_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    run = lambda rows: whitening.whitened(spark.createDataFrame(rows, schema), Scratch(spark, "t"))
    assert run([]).count() == 0 and run([(1, None), (2, [None])]).count() == 0
    one = run([(1, [0.5, 0.25])]).collect()
    assert [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one)] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    two = run([(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.5, 0.75])]).collect()
    assert len(two) == 6 and [r["whitened"] is None for r in two if r["component"] == 2] == [True] * 3
    first = sorted(abs(r["whitened"]) for r in two if r["component"] == 1)
    assert np.allclose(first, [2**-0.5, 2**-0.5, 2**0.5]) and {r["explained"] for r in two if r["component"] == 1} == {1.0}


def test_exact_beyond_64_bits():
    d = np.array([[2**55 + 12345, -(2**54) - 7], [3, -4]])
    a = np.abs(d)
    top, low = a >> 31, a & (2**31 - 1)
    parts = zip(whitening._total(top, top), whitening._total(top, low), whitening._total(low, low), strict=True)
    assert [(a << 62) + (b << 32) + c for a, b, c in parts] == [sum(int(v) ** 2 for v in row) for row in d]


def test_too_wide_is_refused(spark, monkeypatch):
    monkeypatch.setattr(whitening, "WIDEST", 3)
    with pytest.raises(ValueError):
        whitening.whitened(spark.createDataFrame([(1, [0.1] * 4)], "vec_id long, embedding array<float>"), Scratch(spark, "t"))
    assert whitening.whitened(spark.createDataFrame([(1, [0.1] * 3)], "vec_id long, embedding array<float>"), Scratch(spark, "t")).filter(F.col("whitened").isNotNull()).count() == 0
