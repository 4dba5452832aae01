"""The two classifiers against plain loops, and rows that are awkward to learn from."""

from __future__ import annotations

import math
import random
import zlib
from itertools import product

import numpy as np
import zstandard
from pyspark.sql import functions as F

from ledgerloom.llm import quality, toxicity
from ledgerloom.session import table

SF = "/root/testdata/sf0.01"


def test_quality_is_the_size_difference_on_a_curve(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels").filter(~quality.held_out())
    model = quality.fit(docs, labels)
    assert len(model.weights) == 3
    sizes = {}
    for name, raw in (("good", model.good), ("bad", model.bad)):
        own = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes[name] = lambda b, c=own: len(c.compress(b))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for r in docs.select("doc_id", "text").collect():
        data, gains = (r["text"] or "").encode(), []
        for k in range(0, len(data), 512):
            b = data[k : k + 512]
            gains.append((sizes["bad"](b) - sizes["good"](b), len(b)))
        whole = 20 * sum(g for g, _ in gains) / len(data) if data else 0.0
        long = [x for x in gains if x[1] >= 256] or gains
        worst = 20 * min((g / n for g, n in long), default=0.0)
        x = model.weights[0] + model.weights[1] * whole + model.weights[2] * worst
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-max(-30, min(30, x))))) < 1e-9
    # more of the good dictionary's wording never lowers the score
    assert model.weights[1] > 0 and model.weights[2] > 0
    held = labels.sparkSession.createDataFrame([(k, v) for k, v in got.items()], "doc_id long, score double").join(table(spark, SF, "labels").filter(quality.held_out()), "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in held]) > 0.95


def plain_chain(rows):
    """The chain by loops over dictionaries, each model by gradient steps to the end."""
    names = sorted({f for _, t, _ in rows for f in toxicity.features(t) if sum(f in toxicity.features(u) for _, u, _ in rows) >= toxicity.LEAST})
    has = [[f in toxicity.features(t) for f in names] for _, t, _ in rows]

    def model(use, earlier, y):
        pos, neg = [k for k in use if y[k]], [k for k in use if not y[k]]
        if min(len(pos), len(neg)) < 10:
            return math.log((len(pos) + 0.5) / (len(neg) + 0.5)), [], [], [0.0] * len(earlier[0])
        ranked = []
        for j in range(len(names)):
            a, b = sum(has[k][j] for k in pos), sum(has[k][j] for k in neg)
            p = (a + b) / len(use)
            z = abs(a / len(pos) - b / len(neg)) / math.sqrt(p * (1 - p) * (1 / len(pos) + 1 / len(neg)) + 1e-12)
            if a + b >= toxicity.LEAST and z > toxicity.APART:
                ranked.append((-z, j))
        chosen = [j for _, j in sorted(ranked)[: toxicity.WORDS]]
        x = np.array([[float(has[k][j]) for j in chosen] + list(earlier[k]) + [1.0] for k in use])
        t, w = np.array([float(y[k]) for k in use]), np.zeros(len(chosen) + len(earlier[0]) + 1)
        hold = np.array([toxicity.HOLD] * (len(w) - 1) + [1e-6])
        for _ in range(200):
            p = 1 / (1 + np.exp(-x @ w))
            g, h = x.T @ (t - p) - hold * w, (x.T * (p * (1 - p))) @ x + np.diag(hold)
            d = np.linalg.solve(h, g)
            w = w + d * min(1.0, 2 / max(1e-12, np.abs(d).max()))
        return w[-1], chosen, w[: len(chosen)], list(w[len(chosen) : -1])

    def odds(m, k, before):
        base, chosen, weights, more = m
        x = base + sum(w for j, w in zip(chosen, weights, strict=True) if has[k][j]) + sum(a * b for a, b in zip(more, before, strict=True))
        return max(-20.0, min(20.0, x))

    every, models = range(len(rows)), []
    earlier = [[] for _ in rows]
    for c in range(len(toxicity.CATEGORIES)):
        y = [cats[c] for _, _, cats in rows]
        models.append(model(list(every), earlier, y))
        out = [0.0] * len(rows)
        for fold in range(toxicity.FOLDS):
            m = model([k for k in every if rows[k][0] != fold], earlier, y)
            for k in every:
                if rows[k][0] == fold:
                    out[k] = odds(m, k, earlier[k])
        earlier = [[*e, o] for e, o in zip(earlier, out, strict=True)]
    result = []
    for k in every:
        before = []
        for m in models:
            before.append(odds(m, k, before))
        result.append(before)
    return result


def small():
    rng = random.Random(4)
    rows = []
    for i in range(160):
        toxic, fine = int(rng.random() < 0.45), int(rng.random() < 0.5)
        words = rng.choices(["lamp", "door", "tree", "road", "mill", "corn"], k=6) + rng.choices(["junk", "zzz"] if not fine else ["story", "chapter"], k=2)
        words += rng.choices(["trash", "scum"] if fine else ["moron", "scum"], k=1) if toxic and rng.random() < 0.85 else []
        rows.append((zlib.crc32(str(i).encode()) % toxicity.FOLDS, " ".join(words), toxicity.marks(toxic, fine)))
    return rows


def test_the_chain_is_that_of_plain_loops():
    rows = small()
    want, chain = plain_chain(rows), toxicity.train(rows)
    for (_, text, _), odds in zip(rows, want, strict=True):
        before = []
        for link in chain:
            before.append(link.of(toxicity.features(text), before))
        assert np.allclose(before, odds, atol=1e-4)


def test_the_verdict_comes_out_of_the_chain():
    chain = toxicity.train(small())
    last = chain[-1]
    assert toxicity.CATEGORIES[-1] == "toxic" and len(last.earlier) == 2 and max(last.earlier) > 0.1
    words = toxicity.features("lamp door")
    low, high = last.of(words, [-8.0, -8.0]), last.of(words, [8.0, 8.0])
    assert low < 0 < high
    for fluent, poor in product((-3.0, 3.0), repeat=2):
        assert math.isclose(last.of(words, [fluent, poor]) - last.of(words, [0.0, 0.0]), last.earlier[0] * fluent + last.earlier[1] * poor, abs_tol=1e-9)


def test_awkward_rows_and_columns(spark):
    long = "word " * 400_000
    rows = [(k, f"good text number {k} with words", 7, 8) for k in range(60)] + [(100 + k, "xx " * 30 + str(k), 7, 8) for k in range(60)] + [(None, "no id", 7, 8), (300, None, 7, 8), (300, "twice", 7, 8), (301, "", 7, 8), (302, long, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, t int")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(100 + k, 0, k % 2) for k in range(60)] + [(100, 0, 1), (None, 1, 1), (300, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert len(model.weights) == 3
    assert quality.keep(docs, model).columns == docs.columns
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).filter("doc_id < 200").collect()}
    assert np.mean([scores[k] for k in range(60)]) > np.mean([scores[100 + k] for k in range(60)])
    chain = toxicity.fit(docs, labels)
    assert toxicity.score(docs, chain).count() == quality.score(docs, model).count() == len(rows)
    none = docs.filter(F.lit(False))
    assert toxicity.score(none, chain).count() == quality.keep(none, model).count() == 0
    assert quality.fit(none, labels).good == b"" and len(toxicity.fit(none, labels)) == 3
