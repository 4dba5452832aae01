"""Toxicity categories by a chain of linear models.

The categories are predicted one after the other. Each model is a logistic regression on
words and beginnings of words that tell the category's labels apart, and on the log-odds of all earlier categories.
A later model is trained with out-of-fold figures of the earlier ones, so that it learns from
what it will be given when scoring; scoring uses the models fitted on the whole sample.

``labels`` has a toxic mark and a quality mark, and no finer kinds. Crossed, they give two
kinds that are written differently and never hold together: toxic in fluent text, and toxic
in poor text (junk, repeats). These come first. The general mark, their union, comes last
and is fed by both, so the verdict ``is_toxic`` is the chain's last link and moves with the
earlier probabilities. Folds are crc32 of the id modulo ``FOLDS``; rows with crc32(doc_id)
mod 3 = 1 are held out of training altogether.

Fitting sees a bounded sample of labelled rows (``SAMPLE`` toxic and as many others, lowest
by a seeded hash). Its features are found on the executors; the driver gets the names of
those in ``LEAST`` rows or more and their numbers in each row, never a text. Scoring reads
every whole text once, without a shuffle.

Cases: a null text counts as empty and gets the curve's value without words; labels that are
null are not learnt from; of rows that share an id the lowest text trains; repeated rows are
scored alike; an empty table gives no rows; other columns are not read; a category with
fewer than ten labelled rows on either side gets its share as a constant.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.quality import held_out
from ledgerloom.session import Scratch, table

CATEGORIES = ("toxic_fluent", "toxic_poor", "toxic")
SAMPLE = 3000
SEED = "toxicity-1"
FOLDS = 5
#: Words a model may look at, each in so many documents of the sample at least.
WORDS, LEAST = 300, 4
#: Standard errors by which a feature's shares in the two classes differ at least.
APART = 3
HOLD = 1.0
#: Lengths of the beginnings of words that count as features of their own.
STEMS = (3, 4, 5, 6)
WORD = re.compile(r"[^\W\d_]+").findall


@dataclass(frozen=True)
class Link:
    """One model: the log-odds are base + words' weights + weights of earlier log-odds."""

    base: float
    words: dict[str, float]
    earlier: tuple[float, ...]

    def of(self, words: set[str], before: list[float]) -> float:
        x = self.base + sum(map(self.words.__getitem__, self.words.keys() & words)) + sum(w * p for w, p in zip(self.earlier, before, strict=True))
        return max(-20.0, min(20.0, x))


def features(text: str) -> set[str]:
    """The words of a text in lower case, and the beginnings of the longer ones, marked."""
    words = set(WORD(text.lower()))
    return words.union(*({w[:k] + "*" for w in words if len(w) > k} for k in STEMS))


class Sample:
    """Which row has which feature, for features of ``LEAST`` rows or more."""

    def __init__(self, texts: list[str]):
        found = [features(t) for t in texts]
        seen = Counter(f for fs in found for f in fs)
        names = sorted(f for f, n in seen.items() if n >= LEAST)
        at = {f: k for k, f in enumerate(names)}
        self._set(names, [[at[f] for f in fs if f in at] for fs in found])

    @classmethod
    def of(cls, names: list[str], own: list) -> Sample:
        """own: the numbers of each row's features among ``names``."""
        out = cls.__new__(cls)
        out._set(names, own)
        return out

    def _set(self, names: list[str], own: list) -> None:
        self.names, self.size = names, len(own)
        self.rows = np.repeat(np.arange(len(own)), [len(x) for x in own])
        self.cols = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, dtype=np.int64) for x in own)])

    def matrix(self, chosen: np.ndarray) -> np.ndarray:
        """Rows by the chosen features, 1 where a row has one."""
        place = np.full(len(self.names), -1)
        place[chosen] = np.arange(len(chosen))
        keep = place[self.cols] >= 0
        out = np.zeros((self.size, len(chosen)))
        out[self.rows[keep], place[self.cols[keep]]] = 1
        return out

    def telling(self, use: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The features whose shares in the two classes differ most, in standard errors."""
        n1, n0 = y[use].sum(), (1 - y[use]).sum()
        count = lambda weight: np.bincount(self.cols, weights=(weight * use)[self.rows], minlength=len(self.names))
        a, b = count(y), count(1 - y)
        p = (a + b) / (n1 + n0)
        z = np.abs(a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
        z[(a + b < LEAST) | (z <= APART)] = 0
        best = np.lexsort((np.arange(len(z)), -z))[:WORDS]
        return best[z[best] > 0]


def _link(sample: Sample, use: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> tuple[Link, np.ndarray]:
    """A model from the rows in ``use``, and the log-odds it gives to all rows."""
    k, some = earlier.shape[1], y[use]
    if min(some.sum(), len(some) - some.sum()) < 10:
        p = (some.sum() + 0.5) / (len(some) + 1)
        link = Link(math.log(p / (1 - p)), {}, (0.0,) * k)
        return link, np.full(len(y), link.base)
    chosen = sample.telling(use, y)
    whole = np.hstack([sample.matrix(chosen), earlier, np.ones((len(y), 1))])
    m, x = len(chosen), whole[use]
    w, hold = np.zeros(m + k + 1), np.array([HOLD] * (m + k) + [1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(hold), x.T @ (some - p) - hold * w)
        w += step * min(1.0, 5 / np.abs(step).max(initial=1e-9))
        if np.abs(step).max(initial=0) < 1e-6:
            break
    words = dict(zip((sample.names[c] for c in chosen), map(float, w), strict=False))
    return Link(float(w[-1]), words, tuple(map(float, w[m:-1]))), np.clip(whole @ w, -20, 20)


def chain_of(sample: Sample, folds: np.ndarray, y: np.ndarray) -> list[Link]:
    """y: a row's marks, a column for each category in order."""
    chain, earlier = [], np.zeros((len(y), 0))
    for c in range(y.shape[1]):
        chain.append(_link(sample, folds >= 0, earlier, y[:, c])[0])
        out = np.zeros(len(y))
        for fold in range(FOLDS):
            out[folds == fold] = _link(sample, folds != fold, earlier, y[:, c])[1][folds == fold]
        earlier = np.column_stack([earlier, out])
    return chain


def train(rows: list[tuple[int, str, tuple[int, ...]]]) -> list[Link]:
    """rows: (fold, text, a 0 or 1 for each category)."""
    y = np.array([c for _, _, c in rows], float).reshape(len(rows), len(CATEGORIES))
    return chain_of(Sample([t for _, t, _ in rows]), np.array([f for f, _, _ in rows]), y)


def marks(toxic: int, quality: int) -> tuple[int, ...]:
    """The categories' marks, from the labels."""
    return toxic * quality, toxic * (1 - quality), toxic


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(features(t or "")) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names[1:], "features"])


def fit(docs: DataFrame, labels: DataFrame) -> list[Link]:
    own = labels.select(F.col("doc_id").alias("id"), "toxic", "quality").filter("toxic IN (0, 1) AND quality IN (0, 1) AND doc_id IS NOT NULL")
    order = F.md5(F.concat(F.lit(SEED), F.col("id").cast("string")))
    some = [own.filter(F.col("toxic") == k).orderBy(order, "id").limit(SAMPLE) for k in (0, 1)]
    ids = some[0].unionByName(some[1]).withColumn("at", order).select(F.col("id").cast("long").alias("id"), F.col("toxic").cast("int"), F.col("quality").cast("int"), "at")
    scratch = Scratch(docs.sparkSession, "toxicity")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("t")).join(F.broadcast(ids.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.min("t").alias("t"))
    rows = texts.join(F.broadcast(ids), "id").select("t", "id", "toxic", "quality", "at")
    rows = scratch.keep("sample", rows.mapInArrow(_featured, "id long, toxic int, quality int, at string, features array<string>"))
    seen = rows.select(F.explode("features").alias("f")).groupBy("f").count().filter(F.col("count") >= LEAST)
    names = sorted(r["f"] for r in seen.select("f").collect())

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {f: k for k, f in enumerate(names)}
        for batch in batches:
            found = [[at[f] for f in fs if f in at] for fs in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.list_(pa.int32()))], names=batch.schema.names)

    found = rows.mapInArrow(numbered, "id long, toxic int, quality int, at string, features array<int>").collect()
    scratch.drop("sample")
    found.sort(key=lambda r: (r["at"], r["id"], r["toxic"], r["quality"]))
    folds = np.array([zlib.crc32(str(r["id"]).encode()) % FOLDS for r in found], np.int64)
    y = np.array([marks(r["toxic"], r["quality"]) for r in found], float).reshape(len(found), len(CATEGORIES))
    return chain_of(Sample.of(names, [np.array(r["features"], np.int32) for r in found]), folds, y)


def score(docs: DataFrame, chain: list[Link]) -> DataFrame:
    """doc_id and a probability for each category, for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[float]] = [[] for _ in chain]
            for text in batch.column(1):
                words, before = features(text.as_py() or ""), []
                for k, link in enumerate(chain):
                    before.append(link.of(words, before))
                    out[k].append(1 / (1 + math.exp(-before[-1])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.float64()) for x in out)], names=["doc_id", *CATEGORIES])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} double" for c in CATEGORIES))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, a probability for each category, and is_toxic (the last category at 0.5 or more)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels.filter(~held_out())))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), *CATEGORIES, (F.col(CATEGORIES[-1]) >= 0.5).alias("is_toxic"))
