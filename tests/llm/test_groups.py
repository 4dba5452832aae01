"""Groups of near copies: hot vertices, repeated ids, awkward columns and texts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerloom.llm import components, minhash_dedup
from ledgerloom.session import Scratch


def test_hot_vertices_join_without_a_shuffle_of_their_edges(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT", 5)
    monkeypatch.setattr(components, "MOST", 4)
    monkeypatch.setattr(components, "CHUNK", 3)
    edges = [(0, k) for k in range(1, 200)] + [(k, k + 1000) for k in range(1, 50)] + [(5000, 5001), (5001, 5002), (5002, 60), (-7, 5002)]
    found = components.components(spark.createDataFrame(edges, "a long, b long").repartition(20), Scratch(spark, "t")).collect()
    got = {r["a"]: r["b"] for r in found}
    assert set(got.values()) == {-7} and len(got) == 200 + 49 + 3


def test_rows_that_share_an_id_are_told_apart(spark):
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(n))
    a, b, c = text(60), text(60), text(60)
    long = text(150_000)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, c), (4, c), (None, c), (None, None), (5, ""), (5, ""), (6, None), (7, long), (8, long + " end"), (9, "one"), (10, "one")]
    docs = spark.createDataFrame([(i, t, k, "id", 1, 2, "k") for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int, id string, _n int, h int, key string").repartition(4)
    got = minhash_dedup.near_duplicates(docs, Scratch(spark, "t"))
    found = {(r["doc_id"], r["component_id"]) for r in got.collect()}
    assert got.count() == len(rows)
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (7, 7), (8, 7), (9, 9), (10, 9), (5, 5), (6, 6), (None, None)} == found
    one = minhash_dedup.one_of_each(docs, Scratch(spark, "t"))
    assert one.columns == docs.columns
    left = sorted(((r["doc_id"], r["text"]) for r in one.collect()), key=str)
    assert left == sorted([(1, a), (1, b), (4, c), (None, c), (None, None), (5, ""), (5, ""), (6, None), (7, long), (9, "one")], key=str)
    none = docs.filter(F.lit(False))
    assert minhash_dedup.one_of_each(none, Scratch(spark, "t")).count() == 0


def test_a_text_that_many_are_compared_with_goes_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SALT", 3)
    rng = random.Random(2)
    base = ["".join(rng.choices("abcdef", k=5)) for _ in range(120)]
    rows = []
    for k in range(60):
        words = base[:]
        words[rng.randrange(120)] = f"w{k}"
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash_dedup.near_duplicates(docs, Scratch(spark, "t")).collect()
    assert {r["component_id"] for r in got} == {0}
